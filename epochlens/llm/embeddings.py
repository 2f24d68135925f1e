"""Near-duplicate vectors by counting collisions in one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochlens.llm.common import map_batches
from epochlens.plans.components import connected
from epochlens.session import cut

#: Rounds of leading projections that candidates must collide in, and leads of a round.
ROUNDS, LEADS = 2, 2
#: Projections whose collisions are counted.
COUNTED = 16
#: Half-widths of the windows, in standard deviations of the projected distance of a pair at the threshold.
LEAD_WINDOW, COUNT_WINDOW = 2.5, 1.5
#: Share of the pairs at the threshold that must reach the count.
RECALL = 0.999
#: Rows of a block; larger cells are compared block by block.
BLOCK = 1_024


def needed_count(projections: int = COUNTED, window: float = COUNT_WINDOW, recall: float = RECALL) -> int:
    """The largest count of collisions that a pair at the threshold reaches with probability `recall`.

    Its projected distances are independent normal ones, so its collisions are binomial.
    """
    p = math.erf(window / math.sqrt(2))
    reached = 0.0
    for count in range(projections, 0, -1):
        reached += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if reached >= recall:
            return count
    return 0


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 5]).standard_normal((dim, ROUNDS * LEADS + COUNTED))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the components as bytes; null where a vector is null, zero or has a null or non-finite one."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.dtype("<f4") if kind == "float" else np.dtype("<f8")

    def make():
        def packed(values: list | None) -> bytes | None:
            if not values or any(v is None for v in values):
                return None
            x = np.array(values, dtype)
            wide = x.astype(np.float64)
            if not np.isfinite(wide).all() or not wide.any():
                return None
            return x.tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [packed(v) for v in batch.column("embedding").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(found, pa.binary())], ["vec_id", "label", "vec"])

        return each

    source = vectors.select("vec_id", "label", "embedding")
    kinds = [source.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return map_batches(source, make, f"vec_id {kinds[0]}, label {kinds[1]}, vec binary")


def unit(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    """Vectors of unit length in double precision. Scaling by the largest component first keeps squares finite."""
    x = np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(classes: DataFrame, dtype: np.dtype, cosine: float) -> DataFrame:
    """Add round, low1, low2 (the cell), off (the row's offsets from it) and proj: each class in the four cells of a
    round where it can meet one in its own or in a neighbouring cell of both leads."""
    width = LEAD_WINDOW * math.sqrt(2 - 2 * cosine)

    def make():
        known: dict[int, np.ndarray] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = batch.column("vec").to_pylist()
            proj = np.empty((len(data), ROUNDS * LEADS + COUNTED), np.float32)
            for size in {len(v) for v in data}:
                rows = [i for i, v in enumerate(data) if len(v) == size]
                dim = size // dtype.itemsize
                if dim not in known:
                    known[dim] = _directions(dim)
                proj[rows] = (unit([data[i] for i in rows], dtype) @ known[dim]).astype(np.float32)
            cells = np.floor(proj[:, : ROUNDS * LEADS].astype(np.float64) / width).astype(np.int32)
            n, copies = len(data), ROUNDS * 4
            source = np.repeat(np.arange(n), copies)
            turn = np.tile(np.repeat(np.arange(ROUNDS), 4), n)
            off = np.tile(np.arange(4), n * ROUNDS)
            low = [cells[source, turn * LEADS + d] - ((off >> d) & 1) for d in range(LEADS)]
            take = pa.array(source)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(proj.ravel()), proj.shape[1]).cast(pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("cls").take(take), batch.column("label").take(take), batch.column("copies").take(take), batch.column("vec").take(take),
                    pa.array(turn.astype(np.int32)), pa.array(low[0].astype(np.int32)), pa.array(low[1].astype(np.int32)),
                    pa.array(off.astype(np.int32)), flat.take(take),
                ],
                ["cls", "label", "copies", "vec", "round", "low1", "low2", "off", "proj"],
            )

        return each

    label = classes.schema["label"].dataType.simpleString()
    return map_batches(
        classes.select("cls", "label", "copies", "vec"), make,
        f"cls bigint, label {label}, copies bigint, vec binary, round int, low1 int, low2 int, off int, proj array<float>",
    )


def _compare(cosine: float, dtype: np.dtype, need: int):
    """Links among the rows of one cell, or between two of its blocks: per row the linked copies, and a tree edge."""
    spread = math.sqrt(2 - 2 * cosine)
    lead, window = LEAD_WINDOW * spread, np.float32(COUNT_WINDOW * spread)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cls, copies = table["cls"].to_numpy(), table["copies"].to_numpy()
        off, side = table["off"].to_numpy(), table["side"].to_numpy()
        turn = table["round"][0].as_py()
        proj = table["proj"].combine_chunks().values.to_numpy().reshape(len(cls), -1)
        cells = np.floor(proj[:, : ROUNDS * LEADS].astype(np.float64) / lead).astype(np.int32)
        counted = proj[:, ROUNDS * LEADS :]
        vectors = unit(table["vec"].to_pylist(), dtype)
        both = len(np.unique(side)) == 2
        n, parent, links = len(cls), np.arange(len(cls)), np.zeros(len(cls), np.int64)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for s in range(0, n, 128):
            e = min(n, s + 128)
            # Each pair once: in the lowest cell that holds both, in the first round where they are neighbours.
            mask = (off[s:e, None] & off[None, :]) == 0
            mask &= np.arange(s, e)[:, None] < np.arange(n)[None, :]
            if both:
                mask &= side[s:e, None] != side[None, :]
            for r in range(turn):
                c = cells[:, r * LEADS : (r + 1) * LEADS]
                mask &= ~(np.abs(c[s:e, None] - c[None]) <= 1).all(axis=2)
            hits = np.zeros(mask.shape, np.int8)
            for j in range(counted.shape[1]):
                hits += np.abs(counted[s:e, j, None] - counted[None, :, j]) <= window
            a, b = np.nonzero(mask & (hits >= need))
            a = a + s
            for i in range(0, len(a), 50_000):
                x, y = a[i : i + 50_000], b[i : i + 50_000]
                good = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine
                x, y = x[good], y[good]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist()):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        rows = np.nonzero(links)[0]
        roots = np.array([root(i) for i in rows.tolist()], np.int64)
        return pa.table({"cls": cls[rows], "links": links[rows], "top": cls[roots]}, schema=pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("top", pa.int64())]))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal components and label are one class, compared once. Unit vectors at the threshold lie at most
    s = sqrt(2 - 2 cosine) apart, so their projections on a normal direction differ by a normal number of deviation
    s. Candidates lie in the same or neighbouring cells of two sorted leading projections, in either of two rounds;
    of their 16 further projections at least `needed_count()` must collide in a window centred on the query; then
    the cosine decides, in double precision. A pair at the threshold is found with probability 0.998 or more. A
    cell of more than `block` rows is cut in blocks that are compared two by two. A cell emits link counts and a
    spanning forest, no pairs.

    Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing;
    vectors of different lengths don't link. Repeated rows link with each other. A row without vec_id takes part
    and is never kept; an empty table gives no rows. Only vec_id, embedding and label are read.
    """
    dtype = np.dtype("<f4") if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.dtype("<f8")
    rows = cut(prepared(vectors))
    usable = rows.where("vec IS NOT NULL AND label IS NOT NULL")
    classes = cut(
        usable.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    cell = ["label", "size", "round", "low1", "low2"]
    placed = cut(_placed(classes, dtype, cosine).withColumn("size", F.length("vec")))
    heavy = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), "parts").cast("int")
    spread = (
        placed.join(heavy, cell, "left").withColumn("parts", parts).withColumn("part", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part1", F.least("part", "other")).withColumn("part2", F.greatest("part", "other"))
        .withColumn("side", F.when(F.col("part") == F.col("part1"), 0).otherwise(1))
        .select(*cell, "part1", "part2", "side", "cls", "copies", "vec", "off", "proj")
    )
    compared = cut(spread.groupBy(*cell, "part1", "part2").applyInArrow(_compare(cosine, dtype, needed_count()), "cls bigint, links bigint, top bigint"))
    links = compared.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected(compared.where("cls <> top").select(F.col("cls").alias("a"), F.col("top").alias("b")), [])
    rooted = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = (
        rooted.join(named, "root").join(links, "cls", "left")
        .select("label", "vec", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return rows.join(known, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
