"""Plan helpers against brute force, with one key holding most rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochlens.operators import ranking
from epochlens.plans import components, scoring
from epochlens.plans.ordered import ordered
from epochlens.plans.quantiles import exact_quantiles
from epochlens.plans.scoring import topk_batch


def test_ordered_matches_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(0, 40) * 43_200_000_000, f"i{n:04d}") for n in range(600)]
    df = spark.createDataFrame(rows, "k string, us long, id string").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: r for r in ordered(df, ["k"], "ts", "id", rank="rn", prev="p", next="n", first="f").collect()}
    for key in {r[0] for r in rows}:
        own = sorted((us, i) for k, us, i in rows if k == key)
        for at, (_, i) in enumerate(own):
            r = got[i]
            assert r["rn"] == at + 1 and r["f"]["id"] == own[0][1]
            assert (r["p"]["id"] if r["p"] else None) == (own[at - 1][1] if at else None)
            assert (r["n"]["id"] if r["n"] else None) == (own[at + 1][1] if at + 1 < len(own) else None)


def test_ordered_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([("k", None, "a"), ("k", 5, "b"), ("k", None, "c")], "k string, us long, id string").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: (r["rn"], r["p"] and r["p"]["id"]) for r in ordered(df, ["k"], "ts", "id", rank="rn", prev="p").collect()}
    assert got == {"a": (1, None), "c": (2, "a"), "b": (3, "c")}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {
        "flat": np.full(500, 2.5), "hot": np.concatenate([np.zeros(3000), rng.normal(size=500)]), "two": np.array([1.0, 4.0]), "one": np.array([7.0]),
        "outlier": np.concatenate([rng.random(4000), [1e12, -1e12]]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = {"a": 0.02, "b": 0.5, "c": 0.98, "z": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for k, vs in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, p * 100), abs=1e-12)


def test_quantiles_of_a_whole_table(spark):
    got = exact_quantiles(spark.range(1, 102).select(F.col("id").cast("double").alias("v")), [], "v", {"m": 0.5, "p": 0.95}).first()
    assert (got["m"], got["p"]) == (51.0, 96.0)


def _components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_connected_rounds(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 230)]
    df = spark.createDataFrame([(1, a, b) for a, b in edges], "k int, a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df, ["k"]).collect()}
    nodes = {x for e in edges for x in e}
    want = _components(nodes, edges)
    assert all(got.get(n, n) == want[n] for n in nodes)


@pytest.mark.parametrize("connectivity,block", [(8, 5), (4, 5), (8, 2), (4, 64)])
def test_labels_across_blocks(spark, connectivity, block):
    rng = np.random.default_rng(7)
    grid = rng.random((24, 31)) < 0.45
    cells = [(int(r), int(c)) for r, c in zip(*np.nonzero(grid))]
    df = spark.createDataFrame([(1, r, c) for r, c in cells], "pair_id int, row int, col int")
    got = {(r["row"], r["col"]): r["label"] for r in components.label_pixels(df, "pair_id", connectivity, block).collect()}
    reach = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    code = {rc: (rc[0] << 32) | rc[1] for rc in cells}
    edges = [(code[r, c], code[r + dr, c + dc]) for r, c in cells for dr, dc in reach if (r + dr, c + dc) in code]
    want = _components(set(code.values()), edges)
    assert all(got[rc] == want[code[rc]] for rc in cells)


def test_one_component_winds_through_all_blocks(spark):
    """A snake of one pixel's width, every bend in another block, beside a raster of a single pixel."""
    snake = [(r, c) for r in range(33) for c in range(33) if r % 2 == 0 or c == (32 if r % 4 == 1 else 0)]
    rows = [(1, r, c) for r, c in snake] + [(2, 40, 7)]
    labels = components.label_pixels(spark.createDataFrame(rows, "pair_id int, row int, col int"), "pair_id", 4, block=4)
    assert {(r["pair_id"], r["label"]) for r in labels.select("pair_id", "label").distinct().collect()} == {(1, 0), (2, (40 << 32) | 7)}
    assert labels.count() == len(rows)


@pytest.mark.parametrize("blocks_of", [(7, 11), (512, 20_000)])
def test_topk_and_ranks_match_brute_force(spark, blocks_of):
    rng = np.random.default_rng(11)
    m = rng.integers(-2, 3, size=(60, 4)).astype(float)  # many exact ties
    labels = [0 if i % 3 else i % 7 for i in range(60)]
    rows = [(i, labels[i], [float(x) for x in m[i]]) for i in range(60)]
    q = spark.createDataFrame(rows, "query_id long, label int, v array<double>")
    g = q.withColumnRenamed("query_id", "gallery_id")
    unit = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) < 1e-12, 1, np.linalg.norm(m, axis=1, keepdims=True))
    sims = np.round(unit @ unit.T, 6)
    got = {}
    for r in topk_batch(q, g, 5, exclude_self=True, blocks_of=blocks_of).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["gallery_id"]
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [got[i][k] for k in range(1, 6)] == want
    ranks = {}
    for r in ranking.relevant_ranks(q, g, exclude_self=True, blocks_of=blocks_of, chunk=7).collect():
        ranks.setdefault(r["query_id"], []).append((r["relevant_rank"], r["rank"]))
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-np.round(sims[i, j], 6), j))
        want = [at + 1 for at, j in enumerate(order) if labels[j] == labels[i]]
        assert [r for _, r in sorted(ranks.get(i, []))] == want


@pytest.mark.parametrize("few", [0, 1_000])
def test_ranks_write_no_pairs_and_are_the_same_either_way(spark, monkeypatch, few):
    """Neither dealing writes a row for a relevant pair, and the gallery is copied by part, not by block of queries."""
    monkeypatch.setattr(ranking, "FEW_QUERIES", few)
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, size=(300, 3)).astype(float)
    m[0] = 0
    rows = [(f"t{i:03d}", None if i % 9 == 0 else i % 4, [float(x) for x in m[i]]) for i in range(300)]
    q = spark.createDataFrame(rows, "query_id string, label int, v array<double>")
    length = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(length < 1e-12, 1, length)
    sims = np.round(unit @ unit.T, 9)
    want = {}
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], j))
        want[rows[i][0]] = [at + 1 for at, j in enumerate(order) if rows[i][1] is not None and rows[j][1] == rows[i][1]]
    ranks = ranking.relevant_ranks(q, q.withColumnRenamed("query_id", "gallery_id"), exclude_self=True, blocks_of=(3, 50))
    got = {}
    for r in ranks.collect():
        got.setdefault(r["query_id"], []).append((r["relevant_rank"], r["rank"]))
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    metrics = ranking.retrieval_metrics(q, q.withColumnRenamed("query_id", "gallery_id"), exclude_self=True, blocks_of=(3, 50)).first()
    assert metrics["queries"] == 300
    assert metrics["map"] == round(sum(np.mean([(n + 1) / p for n, p in enumerate(v)]) for v in want.values() if v) / 300, 4)


def test_ranking_holds_one_own_range_for_each_query(monkeypatch):
    """Two numbers for each query and tile were held: 3 GB for 50,000 queries and 615,000 rows in tiles of 170."""
    from epochlens.plans.scoring import Rows, unit_matrix

    monkeypatch.setattr(ranking, "KEY_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    ids = np.sort(rng.integers(0, 1_500, 2_000))  # some several times, also across tiles
    ids[100:140] = ids[100]
    labels, unit = rng.integers(0, 3, 2_000), unit_matrix(rng.integers(-2, 3, size=(2_000, 3)).astype(float))
    asked = np.arange(4_000) % 2_000

    def tiles():
        for a in range(0, 2_000, 3):
            yield Rows(pa.array(ids[a:a + 3]), pa.array(labels[a:a + 3]), unit[a:a + 3])

    q = Rows(pa.array(ids[asked]), pa.array(labels[asked]), unit[asked])
    tracemalloc.start()
    try:
        found = ranking._places(q, tiles(), True)
        got = [next(found) for _ in range(200)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000  # 667 tiles x 4,000 queries x 16 bytes are 43 MB
    for i, places in got:
        sims = np.round(unit @ unit[asked[i]], 9)
        order = sorted(np.flatnonzero(ids != ids[asked[i]]), key=lambda j: (-sims[j], j))
        assert places.tolist() == [at + 1 for at, j in enumerate(order) if labels[j] == labels[asked[i]]]


def test_own_ranges_that_do_not_go_on():
    own = ranking.Own(3)
    for first, last in (([0, 2, 0], [2, 2, 0]), ([2, 2, 4], [5, 5, 4]), ([7, 5, 6], [9, 5, 6])):
        own.add(np.array(first), np.array(last))
    assert [own.ranges(i) for i in range(3)] == [[(0, 5), (7, 9)], [(2, 5)], [(0, 0)]]


def test_parts_of_a_gallery_do_not_grow_with_the_queries(spark):
    """The gallery was copied once for every block of queries."""
    from epochlens.plans.scoring import score_parts

    q = spark.range(2_000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    g = q.withColumnRenamed("query_id", "gallery_id")

    def count(queries, tiles):
        yield pa.RecordBatch.from_pydict({"asked": [len(queries)], "met": [sum(len(t) for t in tiles)]})

    parts = score_parts(q, g, count, "asked long, met long", (2, 170)).collect()
    assert sum(p["asked"] for p in parts) == 2_000 and {p["met"] for p in parts} == {2_000}
    assert len(parts) <= 2 * spark.sparkContext.defaultParallelism


def test_metrics_of_unit_axes(spark):
    e = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    q = spark.createDataFrame([(0, "a", e[0]), (1, "b", e[1])], "query_id int, label string, v array<double>")
    g = spark.createDataFrame([(0, "a", e[0]), (1, "b", e[1]), (2, "c", e[2])], "gallery_id int, label string, v array<double>")
    r = ranking.retrieval_metrics(q, g).first()
    assert (r["top_1"], r["mrr"], r["map"]) == (1.0, 1.0, 1.0)
    s = ranking.class_separation(q, g).first()
    assert (s["intra"], s["inter"], s["separation_ratio"]) == (1.0, 0.0, 1.0)


def test_query_without_relevant_rows_counts_as_zero(spark):
    q = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "z", [1.0, 0.0])], "query_id int, label string, v array<double>")
    g = spark.createDataFrame([(5, "a", [1.0, 0.0])], "gallery_id int, label string, v array<double>")
    r = ranking.retrieval_metrics(q, g).first()
    assert (r["queries"], r["top_1"], r["mrr"], r["map"]) == (2, 0.5, 0.5, 0.5)


def test_tables_of_a_stage_are_removed(spark):
    from pathlib import Path

    from epochlens.session import checkpoint_dir, cut, stage

    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    with stage(spark):
        assert cut(spark.range(5)).count() == 5
        assert len(set(root.iterdir()) - before) == 1
    assert set(root.iterdir()) == before


def test_tiles_of_long_vectors_are_bounded_in_bytes():
    """A tile of the gallery had 20,000 rows whatever the length of its vectors."""
    def batch(ids, width):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int32()), pa.array([[float(i)] * width for i in ids])], ["gallery_id", "label", "v"])

    long = list(scoring._tiles(iter([batch(range(i, i + 500), 4096) for i in range(0, 1500, 500)]), 20_000))
    assert [len(t) for t in long] == [512, 512, 476] and all(t.unit.nbytes <= scoring.TILE_BYTES for t in long)
    assert [i for t in long for i in t.ids.to_pylist()] == list(range(1500))
    assert [len(t) for t in scoring._tiles(iter([batch(range(100), 4)]), 64)] == [64, 36]


def test_cut_tables_are_compact(spark):
    from epochlens.session import cut

    rows = spark.range(1000).selectExpr("id", "concat('text ', id % 7) AS text")
    held = cut(rows)
    assert all(".zstd." in f for f in held.inputFiles())
    assert held.exceptAll(rows).count() == 0 and held.count() == 1000
