"""Retrieval quality and latency figures."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochlens.functions import vectors
from epochlens.plans.quantiles import exact_quantiles
from epochlens.plans.scoring import GALLERY_SLICE, QUERY_BLOCK, TILE_BYTES, Blocks, Rows, _type, own_places, score_parts

#: Bytes of similarities that a task holds at a time when it ranks.
KEY_BYTES = 1 << 27
#: Up to so many queries the gallery is dealt and not the queries.
FEW_QUERIES = 1_000


def latency_stats(latencies: DataFrame) -> DataFrame:
    """One row of latency figures (2 dp) over column `ms`."""
    basic = latencies.agg(F.avg("ms").alias("mean"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    marks = exact_quantiles(latencies, [], "ms", {"median": 0.5, "p95": 0.95})
    both = basic.unionByName(marks, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("mean", "low", "high", "median", "p95")])
    value = {c: F.round(F.coalesce(c, F.lit(0.0)), 2) for c in ("mean", "median", "p95", "low", "high")}
    rate = F.when(F.col("mean") > 1e-6, F.round(1000.0 / F.col("mean"), 2)).otherwise(0.0)
    return both.select(
        value["mean"].alias("mean_ms"), value["median"].alias("median_ms"), value["p95"].alias("p95_ms"),
        value["low"].alias("min_ms"), value["high"].alias("max_ms"), rate.alias("per_second"),
    )


def _codes(q: pa.Array, gallery: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers; null is no label, and equal to nothing."""
    codes, _ = pd.factorize(np.concatenate([x.to_pandas().to_numpy(object) for x in (q, *gallery)]))
    mine, theirs = codes[:len(q)].copy(), codes[len(q):]
    mine[mine < 0] = -2
    return mine, theirs


def _ninths(sims: np.ndarray) -> np.ndarray:
    """Cosines at 9 dp as whole numbers."""
    return np.rint(np.clip(sims, -1.0, 1.0) * 1e9).astype(np.int64)


class Own:
    """For each query the places of the gallery that hold itself.

    The gallery comes in the order of its ids, so that is one range, which may go on in the next tile. What doesn't go
    on (null ids have no such order) is kept aside.
    """

    def __init__(self, count: int):
        self.first, self.last = np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.more: dict[int, list[tuple[int, int]]] = {}

    def add(self, first: np.ndarray, last: np.ndarray) -> None:
        at = np.flatnonzero(last > first)
        begins = at[self.last[at] == self.first[at]]
        self.first[begins] = self.last[begins] = first[begins]
        goes_on = self.last[at] == first[at]
        self.last[at[goes_on]] = last[at[goes_on]]
        for i in at[~goes_on].tolist():
            self.more.setdefault(i, []).append((int(first[i]), int(last[i])))

    def ranges(self, i: int) -> list[tuple[int, int]]:
        return [(int(self.first[i]), int(self.last[i])), *self.more.get(i, ())]


def _places(q: Rows, tiles: Iterator[Rows], exclude_self: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each query of a part the places of its relevant rows among the whole gallery, ascending.

    Order: similarity descending, then gallery id. One key holds both and whether a row is relevant, so a query's keys
    are sorted once. The gallery waits in a temporary file; in memory are `KEY_BYTES` of similarities, the
    keys of one query, and for each query from where to where it meets itself, however many tiles there are.
    """
    labels, count = [], 0
    own = Own(len(q))
    with tempfile.TemporaryFile() as kept:
        for tile in tiles:
            if exclude_self:
                own.add(*(at + count for at in own_places(q.ids, tile.ids)))
            count += len(tile)
            labels.append(tile.labels)
            width = tile.unit.shape[1]
            tile.unit.tofile(kept)
        if not count:
            yield from ((i, np.empty(0, np.int64)) for i in range(len(q)))
            return
        mine, theirs = _codes(q.labels, labels)
        base = np.arange(count, dtype=np.int64) << 1
        block = max(1, min(len(q), KEY_BYTES // (8 * count)))
        piece = max(1, TILE_BYTES // (8 * max(1, width)))
        # One matrix for all blocks: a second would begin while rows of the first are in use.
        matrix = np.empty((block, count))
        for a in range(0, len(q), block):
            unit = q.unit[a:a + block]
            sims = matrix[:len(unit)]
            kept.seek(0)
            for at in range(0, count, piece):
                size = min(piece, count - at)
                sims[:, at:at + size] = unit @ np.fromfile(kept, np.float64, size * width).reshape(size, width).T
            for i, row in enumerate(sims, a):
                key = 1_000_000_000 - _ninths(row) << 32
                key += base
                key += theirs == mine[i]
                for f, l in own.ranges(i):
                    key[f:l] = np.iinfo(np.int64).max - 1  # even, so not relevant, and behind all others
                key.sort()
                yield i, np.flatnonzero(key & 1) + 1


def _dealt_places(queries: DataFrame, gallery: DataFrame, exclude_self: bool, blocks_of: Blocks, rows_of: Callable, schema: str) -> DataFrame:
    """Rows of `rows_of(query id, places of its relevant rows)` for every query."""
    kinds = [queries.schema["query_id"].dataType, gallery.schema["gallery_id"].dataType]

    def by_part(q: Rows, tiles: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
        ids, arrow = q.ids.to_pandas().to_numpy(), None
        for i, places in _places(q, tiles, exclude_self):
            found = rows_of(ids[i], places)
            arrow = arrow or pa.schema([("query_id", q.ids.type), *((c, pa.float64() if c == "precision" else pa.int64()) for c in found.columns[1:])])
            yield from pa.Table.from_pandas(found, schema=arrow, preserve_index=False).to_batches()

    def one_list(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def by_slice(q: Rows, tiles: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
        for tile in tiles:
            mine, theirs = _codes(q.labels, [tile.labels])
            first, last = own_places(q.ids, tile.ids) if exclude_self else (np.zeros(len(q), int),) * 2
            for i in range(len(q)):
                keep = np.ones(len(tile), bool)
                keep[first[i]:last[i]] = False
                ninths = _ninths(tile.unit @ q.unit[i])[keep]
                yield pa.RecordBatch.from_arrays(
                    [q.ids.slice(i, 1), *(one_list(x) for x in (pa.array(ninths), tile.ids.filter(pa.array(keep)), pa.array((theirs == mine[i])[keep])))],
                    ["query_id", "ninths", "ids", "relevant"],
                )

    columns = queries.select("query_id", "label", "v"), gallery.select("gallery_id", "label", "v")
    # A few queries: their similarities take less room than copies of the gallery.
    if queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        return score_parts(*columns, by_part, schema, blocks_of)
    packed = f"query_id {kinds[0].simpleString()}, ninths array<long>, ids array<{kinds[1].simpleString()}>, relevant array<boolean>"
    scored = score_parts(*columns, by_slice, packed, blocks_of, deal="gallery")

    def place(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
        ninths, ids, relevant = (np.concatenate(slices[c].to_list()) for c in ("ninths", "ids", "relevant"))
        wanted = ninths >= (ninths[relevant].min() if relevant.any() else np.iinfo(np.int64).max)
        ninths, ids, relevant = ninths[wanted], ids[wanted], relevant[wanted]
        return rows_of(key[0], np.flatnonzero(relevant[np.lexsort((ids, -ninths))]) + 1)

    return scored.groupBy("query_id").applyInPandas(place, schema)


def relevant_ranks(queries: DataFrame, gallery: DataFrame, exclude_self: bool = False, blocks_of: Blocks = (QUERY_BLOCK, GALLERY_SLICE), chunk: int = 5000) -> DataFrame:
    """For each relevant gallery row its place among all rows (`rank`) and among relevant ones (`relevant_rank`).

    Order: similarity descending, then gallery id. `chunk` is without effect; it is kept for callers that give it.
    """
    def rows_of(query_id, places: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": pd.Series([query_id] * len(places), dtype=object), "relevant_rank": np.arange(1, len(places) + 1), "rank": places})

    return _dealt_places(queries, gallery, exclude_self, blocks_of, rows_of, f"query_id {_type(queries, 'query_id')}, relevant_rank long, rank long")


def retrieval_metrics(queries: DataFrame, gallery: DataFrame, ks: tuple[int, ...] = (1, 3, 5), exclude_self: bool = False, blocks_of: Blocks = (QUERY_BLOCK, GALLERY_SLICE)) -> DataFrame:
    """One row: hit rates, mean reciprocal rank and mean average precision (4 dp). queries: query_id, label, v.

    The ranks of a query's relevant rows are summed up where they are found; no row of a pair is written.
    """
    def rows_of(query_id, places: np.ndarray) -> pd.DataFrame:
        found = len(places) > 0
        precision = float((np.arange(1, len(places) + 1) / places).mean()) if found else None
        return pd.DataFrame({
            "query_id": pd.Series([query_id], dtype=object), "first": pd.array([places[0] if found else None], "Int64"), "precision": pd.array([precision], "Float64"),
        })

    per_query = _dealt_places(queries, gallery, exclude_self, blocks_of, rows_of, f"query_id {_type(queries, 'query_id')}, first long, precision double")
    rows = queries.select("query_id").join(per_query, "query_id", "left")

    def rate(k):
        return F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4)

    return rows.agg(
        F.count(F.lit(1)).alias("queries"), *[rate(k).alias(f"top_{k}") for k in dict.fromkeys((1, *ks))],
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(F.coalesce("precision", F.lit(0.0))), 4).alias("map"),
    )


def class_separation(queries: DataFrame, gallery: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Mean similarity within and across classes and their ratio (4 dp).

    The sum of cosines over two sets is the product of their summed unit vectors, so no pair is formed: one
    pass per table, linear in its rows.
    """
    def sums(df, side):
        unit = df.select("label", F.posexplode(vectors.l2_normalize(vectors.as_double(F.col("v")))).alias("pos", "x"))
        return unit.groupBy("label", "pos").agg(F.sum("x").alias(side), F.count(F.lit(1)).alias(f"n_{side}"))

    both = sums(queries, "q").join(sums(gallery, "g"), ["label", "pos"], "full").fillna(0)
    by_pos = both.groupBy("pos").agg(
        F.sum(F.col("q") * F.col("g")).alias("within"), (F.sum("q") * F.sum("g")).alias("all"),
        F.sum(F.col("n_q") * F.col("n_g")).alias("n_within"), (F.sum("n_q") * F.sum("n_g")).alias("n_all"),
    )
    total = by_pos.agg(F.sum("within").alias("within"), F.sum("all").alias("all"), F.max("n_within").alias("n_within"), F.max("n_all").alias("n_all"))
    if exclude_self:
        shared = queries.select(F.col("query_id").alias("id"), F.col("v").alias("a")).join(gallery.select(F.col("gallery_id").alias("id"), F.col("v").alias("b")), "id")
        own = shared.agg(F.sum(vectors.cosine(vectors.as_double(F.col("a")), vectors.as_double(F.col("b")))).alias("self"), F.count(F.lit(1)).alias("n_self"))
        total = total.unionByName(own, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("within", "all", "n_within", "n_all", "self", "n_self")])
    else:
        total = total.withColumns({"self": F.lit(0.0), "n_self": F.lit(0)})
    intra = F.round((F.col("within") - F.col("self")) / F.nullif(F.col("n_within") - F.col("n_self"), F.lit(0)), 4)
    inter = F.round((F.col("all") - F.col("within")) / F.nullif(F.col("n_all") - F.col("n_within"), F.lit(0)), 4)
    out = total.select(F.coalesce(intra, F.lit(0.0)).alias("intra"), F.coalesce(inter, F.lit(0.0)).alias("inter"))
    ratio = F.when(F.col("inter") > 0, F.round(F.col("intra") / F.greatest("inter", F.lit(1e-6)), 4)).otherwise(1.0)
    return out.withColumn("separation_ratio", ratio)


def compare_models(models: DataFrame, results: DataFrame) -> DataFrame:
    """One row per known model; one that was not run keeps NULL figures."""
    means = results.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("top_1"), 4).alias("top_1"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("latency_ms"), 2).alias("latency_ms")
    )
    return models.join(means, "model_id", "left").withColumn("executed", F.col("runs").isNotNull())
