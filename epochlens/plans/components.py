"""Connected components of an edge table, and of pixels through blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from epochlens.session import cut


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member index of the component of each of n items linked by edges a-b."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_edges = low != high
        if not open_edges.any():
            return parent
        np.minimum.at(parent, high[open_edges], low[open_edges])
        while True:
            hop = parent[parent]
            if (hop == parent).all():
                break
            parent = hop


def _packed(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all arrays of a batch, with the owner of each value and the cut points between owners."""
    sizes = rows.map(len).to_numpy()
    values = np.concatenate(rows.to_list()) if len(rows) else np.empty(0, np.int64)
    return values.astype(np.int64), np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes)[:-1]


def _block_labels(connectivity: int):
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    @F.pandas_udf("array<bigint>")
    def label(rows: pd.Series, cols: pd.Series) -> pd.Series:
        row, owner, cuts = _packed(rows)
        col, _, _ = _packed(cols)
        order = np.lexsort((col, row, owner))
        row, col, owner = row[order], col[order], owner[order]
        # Offsets inside the batch keep the search key of a pixel in one integer.
        r, c = row - row.min(initial=0) + 1, col - col.min(initial=0) + 1
        width, height = c.max(initial=0) + 2, r.max(initial=0) + 2
        place = (owner * height + r) * width + c
        heads, tails = [], []
        for dr, dc in steps:
            target = place + dr * width + dc
            at = np.minimum(np.searchsorted(place, target), max(len(place) - 1, 0))
            hit = place[at] == target
            heads.append(np.nonzero(hit)[0])
            tails.append(at[hit])
        root = _roots(np.concatenate(heads), np.concatenate(tails), len(place))
        code = np.empty(len(place), np.int64)
        code[order] = (row[root] << 32) | col[root]
        return pd.Series(np.split(code, cuts) if len(rows) else [])

    return label


def _edge_roots():
    @F.pandas_udf("array<struct<node: bigint, root: bigint>>")
    def solve(heads: pd.Series, tails: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(heads, tails):
            nodes, index = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
            root = nodes[_roots(index[: len(a)], index[len(a):], len(nodes))]
            out.append([{"node": int(n), "root": int(r)} for n, r in zip(nodes, root)])
        return pd.Series(out)

    return solve


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Component root of every vertex named in `edges` (columns keys, a, b), as (keys, node, root).

    Rounds of linking each vertex to the smallest neighbour (large star, then small star); a round at least
    halves path lengths. Every round is written to the checkpoint folder, so lineage stays flat.
    """
    current = cut(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    checksum = None
    # The number of rounds grows with the logarithm of the edges; far more than that means the input is not what it seems.
    for _ in range(20 + 4 * current.count().bit_length()):
        # Large star: larger neighbours of a vertex point to the smallest member of its neighbourhood.
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the vertex itself point to the smallest of them.
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*keys, "a"])
        small = small.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(*keys, "a", F.col("m").alias("b"))
        )
        current = cut(small.where("a <> b").distinct())
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first()
        if tuple(state) == checksum:
            break
        checksum = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))


def label_pixels(pixels: DataFrame, key: str, connectivity: int = 8, block: int = 512) -> DataFrame:
    """Add `label`, the first pixel (row-major code) of the component, to (key, row, col, ...).

    A task labels one block of `block` x `block` pixels, whatever the size of the raster; components that
    cross block borders are joined afterwards on the much smaller table of border contacts.
    """
    blocked = pixels.groupBy(
        key, F.floor(F.col("row") / block).alias("_br"), F.floor(F.col("col") / block).alias("_bc")
    ).agg(F.collect_list(F.struct(*[c for c in pixels.columns if c != key])).alias("_px"))
    labels = _block_labels(connectivity)(F.col("_px.row"), F.col("_px.col"))
    local = blocked.select(key, "_br", "_bc", F.explode(F.arrays_zip("_px", labels.alias("label"))).alias("_p")).select(
        key, "_br", "_bc", "_p._px.*", "_p.label"
    )
    local = cut(local.select(*pixels.columns, "_br", "_bc", "label"))
    inner_row, inner_col = F.col("row") % block, F.col("col") % block
    border = local.where(inner_row.isin(0, block - 1) | inner_col.isin(0, block - 1)).select(key, "row", "col", "_br", "_bc", "label")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    moved = border.select(
        key, F.col("label").alias("a"), F.col("_br").alias("_br0"), F.col("_bc").alias("_bc0"),
        F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])).alias("to"),
    ).select(key, "a", "_br0", "_bc0", "to.row", "to.col")
    apart = F.col("_br0").bitwiseXOR(F.col("_br")).bitwiseOR(F.col("_bc0").bitwiseXOR(F.col("_bc")))
    contacts = (
        moved.join(border, [key, "row", "col"])
        .where("_br <> _br0 OR _bc <> _bc0")
        # The level of the smallest square of 2^level x 2^level blocks that holds both ends.
        .withColumn("_level", F.length(F.bin(apart)))
        .select(
            key, F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b"), "_level",
            F.expr("shiftright(_br, _level)").alias("_tr"), F.expr("shiftright(_bc, _level)").alias("_tc"),
        )
    )
    roots = _seam_roots(contacts, key)
    if roots is None:
        return local.drop("_br", "_bc")
    return (
        local.join(roots.withColumnRenamed("node", "label"), [key, "label"], "left")
        .withColumn("label", F.coalesce("root", "label"))
        .select(*pixels.columns, "label")
    )


def _seam_roots(contacts: DataFrame, key: str) -> DataFrame | None:
    """Roots of the labels that touch across blocks; None when no component crosses a border.

    Squares of blocks are merged level by level, each twice as wide as those before. A task joins the labels that meet
    on the seams inside one square, with the roots that its quarters gave them. It holds at most the contacts along
    two lines across the square, so its size follows the side of a raster and not its area, and the number
    of levels follows the logarithm of the side. There is one way for rasters of all sizes.
    """
    contacts = cut(contacts.distinct())
    levels = contacts.agg(F.max("_level")).first()[0]
    if levels is None:
        return None
    roots = None
    for level in range(1, levels + 1):
        seam = contacts.where(F.col("_level") == level)
        if roots is not None:
            for end in ("a", "b"):
                known = roots.select(key, F.col("node").alias(end), F.col("root").alias("_root"))
                seam = seam.join(known, [key, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        packed = seam.where("a <> b").groupBy(key, "_tr", "_tc").agg(F.collect_set(F.struct("a", "b")).alias("_e"))
        solved = packed.select(key, F.explode(_edge_roots()(F.col("_e.a"), F.col("_e.b"))).alias("_r"))
        merged = cut(solved.select(key, "_r.node", "_r.root").where("node <> root"))
        if roots is not None:
            # A label merged now was a root until now, so it isn't among the nodes yet.
            last = merged.select(key, F.col("node").alias("root"), F.col("root").alias("_next"))
            older = roots.join(last, [key, "root"], "left").select(key, "node", F.coalesce("_next", "root").alias("root"))
            merged = cut(older.unionByName(merged))
        roots = merged
    return roots
