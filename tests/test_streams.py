"""Streams over several triggers, with late and repeated rows: the tables equal what one batch over all rows gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epochlens.streaming import jobs
from epochlens.streaming.keyed import KeyedTable, touched

UTC = dt.timezone.utc
SCHEMA = "series_id string, observation_id string, acquisition_time timestamp, file_hash string, ts timestamp"


def at(hours):
    return dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(hours=hours)


TRIGGERS = [
    [("a", "o1", 0), ("a", "o2", 50), ("b", "p1", 3)],
    # o3 splits the pair of o1 and o2; o2 comes again; p0 comes before all others of its series.
    [("a", "o3", 20), ("a", "o2", 50), ("b", "p0", 1), ("c", "q1", 7)],
    # Years late, and a series that nothing has touched for two triggers.
    [("a", "o0", -40_000), ("b", "p2", 900), ("a", "o4", 20)],
]


@pytest.fixture(scope="module")
def batches(spark):
    def rows(trigger):
        return [(s, o, at(h), f"hash{h % 5}", at(h)) for s, o, h in trigger]

    return [spark.createDataFrame(rows(t), SCHEMA) for t in TRIGGERS]


def run(sink, batches):
    for i, batch in enumerate(batches):
        sink(batch, i)
    # A batch that is replayed changes nothing.
    sink(batches[-1], len(batches) - 1)


def test_neighbours_with_late_rows(spark, batches, tmp_path):
    folder = str(tmp_path)
    run(jobs.adjacent_sink(folder), batches)
    got = {tuple(r) for r in jobs.adjacent_table(spark, folder).select("series_id", "earlier_id", "later_id").collect()}
    seen = sorted({(s, at(h), o) for t in TRIGGERS for s, o, h in t})
    assert got == {(x[0], x[2], y[2]) for x, y in zip(seen, seen[1:]) if x[0] == y[0]}


def test_counts_of_all_windows(spark, batches, tmp_path):
    path = str(tmp_path / "counts")
    run(jobs.counts_sink(path), batches)
    got = {(r.series_id, r.start): r.observation_count for r in jobs.counts_table(spark, path).collect()}
    want = {}
    for s, _, h in (x for t in TRIGGERS for x in t):
        key = s, at(h).replace(hour=0, tzinfo=None)
        want[key] = want.get(key, 0) + 1
    assert {(s, t.replace(tzinfo=None)): n for (s, t), n in got.items()} == want


def test_a_known_file_stays_known(spark, batches, tmp_path):
    path = str(tmp_path / "catalog")
    run(jobs.ingest_sink(path), batches)
    got = [r.file_hash for r in spark.read.parquet(path).collect()]
    assert sorted(got) == sorted({f"hash{h % 5}" for t in TRIGGERS for _, _, h in t})


def files(path, pattern="*.parquet"):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob(pattern)}


@pytest.fixture
def embedded():
    """An embedder that counts nothing but gives each tile a vector of its hash."""
    return lambda tiles: tiles.withColumn("v", F.array(F.length("sha256_hash").cast("double"), F.lit(1.0)))


def tiles(spark, rows):
    return spark.createDataFrame(rows, "tile_id string, sha256_hash string, arrived bigint")


def test_a_batch_of_one_tile_rewrites_one_bucket(spark, tmp_path, embedded):
    path = str(tmp_path / "index")
    sink = jobs.refresh_sink(path, "m", "p", embedded)
    sink(tiles(spark, [(f"t{i}", f"h{i}", i) for i in range(500)]), 0)
    before = files(tmp_path / "index" / "data")
    sink(tiles(spark, [("t7", "changed", 1_000), ("t7", "older", 999), ("t8", "h8", 1_001)]), 1)
    table = jobs.index_table(spark, path)
    assert [v for v in table.manifest().values()].count(2) == 1  # t8 is up to date, so its bucket stays
    after = files(tmp_path / "index" / "data")
    assert {k: after[k] for k in before} == before
    assert {k.split("/")[0] for k in after.keys() - before.keys()} == {"v2"} and len({k.split("/")[1] for k in after.keys() - before.keys()}) == 1
    rows = {r["tile_id"]: r["source_hash"] for r in table.read().collect()}
    assert rows == {f"t{i}": f"h{i}" for i in range(500)} | {"t7": "changed"}
    # Replayed, and replayed after a later version was written: the same rows again.
    sink(tiles(spark, [("t7", "changed", 1_000), ("t7", "older", 999), ("t8", "h8", 1_001)]), 1)
    assert {r["tile_id"]: r["source_hash"] for r in table.read().collect()} == rows


def test_an_unfinished_version_is_not_seen(spark, tmp_path, embedded):
    path = str(tmp_path / "index")
    jobs.refresh_sink(path, "m", "p", embedded)(tiles(spark, [("a", "1", 1), ("b", "1", 2)]), 0)
    table = jobs.index_table(spark, path)
    held = table.manifest()
    # Data of the next version without its manifest, as after a driver that was lost.
    tiles(spark, [("a", "2", 3)]).write.partitionBy("tile_id").parquet(f"{path}/data/v2")
    assert table.manifest() == held and {r["source_hash"] for r in table.read().collect()} == {"1"}


def test_a_bucket_can_become_empty(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, n int", ("k",), 4)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, n int")
    table.rewrite(1, {}, rows, list(range(4)))
    gone = touched(rows.where("k = 'a'"), ["k"], 4)
    left = table.read(table.manifest(), gone).where("k <> 'a'")
    table.rewrite(2, table.manifest(), left, gone)
    assert {r["k"] for r in table.read().collect()} == {"b", "c", "d"}
    assert table.manifest(2) != table.manifest() and {r["k"] for r in table.read(table.manifest(2)).collect()} == {"a", "b", "c", "d"}


def test_small_batches_open_their_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "catalog")
    sink = jobs.ingest_sink(path)
    rows = lambda names, hour: spark.createDataFrame([("s", "o", at(0), n, at(hour)) for n in names], SCHEMA)
    sink(rows([f"hash{i}" for i in range(400)], 0), 0)
    known = jobs._stored(spark, path, 1, "file_hash string", touched(rows(["hash5"], 9), ["file_hash"], jobs.BUCKETS))
    assert len(known.inputFiles()) == 1 or known.select(F.input_file_name()).distinct().count() == 1
    sink(rows(["hash5", "new"], 9_000), 1)
    assert spark.read.parquet(path).groupBy("file_hash").count().where("count > 1").isEmpty()
    assert spark.read.parquet(path).count() == 401


def test_reviews_in_buckets_continue_their_revisions(spark, tmp_path):
    path = str(tmp_path / "log")
    sink = jobs.review_sink(path)
    schema = "investigation_id string, region_id string, event_id bigint, ts timestamp, decision string, note string, reason string"
    sink(spark.createDataFrame([(f"i{i}", "r", i, at(i), "confirm", "", "") for i in range(50)], schema), 0)
    before = files(tmp_path / "log")
    again = spark.createDataFrame([("i3", "r", 100, at(100), "reject", "n", "")], schema)
    for _ in range(2):
        sink(again, 1)
    after = files(tmp_path / "log")
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1
    rows = spark.read.parquet(path).where("investigation_id = 'i3'").orderBy("revision").collect()
    assert [(r["revision"], r["decision"] != rows[0]["decision"]) for r in rows] == [(1, False), (2, True)]


def test_stream_queries_read_tables_that_are_folders(spark, tmp_path):
    """Tables of several files gave no row: only files in the directory itself were taken."""
    from epochlens.catalogue.registry import Tables
    from epochlens.catalogue.tables import stream_counts, stream_refresh

    vectors = spark.range(30).selectExpr("id AS vec_id", "array_repeat(CAST(id AS FLOAT), 64) AS embedding", "CAST(id % 3 AS INT) AS label")
    vectors.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    events = spark.range(20).selectExpr("id AS event_id", "id % 4 AS user_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "'view' AS event_type", "1.0D AS value")
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    rows = stream_refresh(Tables(spark, str(tmp_path))).collect()
    assert sorted(r["tile_id"] for r in rows) == sorted(f"tile_{i}" for i in range(30)) and {r["dimension"] for r in rows} == {512}
    assert sum(r["observation_count"] for r in stream_counts(Tables(spark, str(tmp_path))).collect()) == 20
