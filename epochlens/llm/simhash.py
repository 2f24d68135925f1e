"""Near-duplicate texts by SimHash, with one-wildcard variants of half fingerprints as the index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.llm.common import by_row_key, lists, map_batches, plain_words, row_key, texts, utf8, where_key
from epochlens.plans.components import connected
from epochlens.session import cut

SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of `size` words joined by spaces; of the whole sequence where it is shorter."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long; 0 for a text without words."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(shingle_hashes(plain_words(t), shingle)) for t in utf8(batch.column("text"))]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

        return each

    source = texts(docs)
    return map_batches(source, make, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _forest(values: np.ndarray, most: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges (value, smaller value of the same part) of the graph that joins values at most `most` bits apart."""
    n = len(values)
    parent = np.arange(n)
    for i in range(0, n, block):
        for j in range(i, n, block):
            near = np.bitwise_count(values[i : i + block, None] ^ values[None, j : j + block]) <= most
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            while True:
                ra, rb = parent[a], parent[b]
                open_edges = ra != rb
                if not open_edges.any():
                    break
                a, b = a[open_edges], b[open_edges]
                np.minimum.at(parent, np.maximum(ra, rb)[open_edges], np.minimum(ra, rb)[open_edges])
                while not (parent[parent] == parent).all():
                    parent = parent[parent]
    child = np.nonzero(parent != np.arange(n))[0]
    return values[child], values[parent[child]]


def _edges_in_runs(most: int):
    """Over rows sorted by bucket: the tree edges of every bucket. A bucket that spans batches is carried on."""

    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        b = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def solve(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _forest(np.unique(values), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_values = None, []
        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            values = batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            parts = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if keys[s] == open_key:
                    open_values.append(values[s:e])
                    continue
                if open_values:
                    parts.append(solve(np.concatenate(open_values)))
                open_key, open_values = keys[s], [values[s:e]]
            yield out(parts)
        if open_values:
            yield out([solve(np.concatenate(open_values))])

    return run


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def _cleared(value: Column, bit: Column) -> Column:
    """`value` with one bit, given as a column, set to zero."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return value.bitwiseAND(F.bitwise_not(one))


def links(fps: DataFrame, most: int = 3, split_above: int = 1024) -> DataFrame:
    """(a, b): edges that connect the distinct values of `fps` (column fp) exactly as all pairs at most 3 bits apart do.

    Two values at most 3 bits apart agree in one 32-bit half but for one bit. The index holds, for each
    distinct half, its 32 one-wildcard variants; a variant is shared by two halves at most, so no bucket of
    it is hot. Values with equal halves, or with two such neighbouring halves, are then verified together.
    A set of more than `split_above` values is first cut by the same rule on the other half: one of its two
    quarters agrees but for one bit. Every set emits the edges of a spanning forest, never all its pairs.
    """
    if most > 3:
        raise ValueError("two halves with one wildcard find pairs up to three bits apart")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select(
        "fp", "seg", F.when(F.col("seg") == 0, _bits(F.col("fp"), 32, 32)).otherwise(_bits(F.col("fp"), 0, 32)).alias("v")
    )
    values = cut(halves.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("n")))
    variants = values.select("seg", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p")).select(
        # One long: segment, wildcard place, the other 31 bits.
        (F.col("seg") * F.lit(1 << 38) + F.col("p") * F.lit(1 << 33) + _cleared(F.col("v"), F.col("p"))).alias("variant"), "v", "n"
    )
    couples = (
        variants.groupBy("variant")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("size"))
        .where("low <> high")
        .select(
            (F.col("variant") + F.lit(1 << 32)).alias("bucket"), F.shiftrightunsigned("variant", 38).cast("int").alias("seg"), "size",
            F.explode(F.array("low", "high")).alias("v"),
        )
    )
    same = values.where("n > 1").select((F.col("seg") * F.lit(1 << 38) + F.col("v")).alias("bucket"), "seg", F.col("n").alias("size"), "v")
    members = halves.join(couples.unionByName(same, allowMissingColumns=False), ["seg", "v"])
    other = F.when(F.col("seg") == 0, _bits(F.col("fp"), 0, 32)).otherwise(_bits(F.col("fp"), 32, 32))
    quarter = F.when(F.col("place") < 16, _bits(other, 0, 16)).otherwise(_bits(other, 16, 16))
    small = members.where(F.col("size") <= split_above).select("bucket", F.lit(-1).cast("bigint").alias("part"), "fp")
    large = members.where(F.col("size") > split_above).select(
        "bucket", "seg", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place")
    ).select("bucket", (F.col("place") * F.lit(1 << 16) + _cleared(quarter, F.col("place") % 16)).alias("part"), "fp")
    sets = small.unionByName(large).select(F.xxhash64("bucket", "part").alias("bucket"), "fp")
    return sets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_edges_in_runs(most), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, split_above: int = 1024) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of at most `most` bits).

    Null and empty texts have fingerprint zero and link like any other; repeated rows give repeated results; an
    empty table gives no rows. Rows without a doc_id take part, but name no component: one that holds only such
    rows has a null component_id. Only doc_id and text are read.
    """
    fps = cut(fingerprints(docs, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(distinct.select("fp"), most, split_above), [])
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signatures(texts_of: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(node, size, bands, low): how many distinct shingles each text has, the hashed bands of its MinHash values, and
    the last byte of every value."""

    def make():
        r = np.random.default_rng(SEED)
        factors = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

        def bands_of(hashes: np.ndarray) -> tuple[list[int], bytes]:
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(hashes), 256):
                part = hashes[i : i + 256, None] * factors
                part += shifts
                np.minimum(low, part.min(axis=0), out=low)
            keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED + k) for k, band in enumerate(low.reshape(bands, rows))]
            return keys, (low & np.uint64(0xFF)).astype(np.uint8).tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(plain_words(t), shingle)) for t in utf8(batch.column("text"))]
            signed = [bands_of(s) for s in sets]
            flat = np.array([b for keys, _ in signed for b in keys], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), lists(pa.array(flat), np.full(len(sets), bands)), pa.array([low for _, low in signed], pa.binary())],
                ["node", "size", "bands", "low"],
            )

        return each

    return map_batches(texts_of, make, "node bigint, size bigint, bands array<bigint>, low binary")


def _shingle_sets(texts_of: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(plain_words(t), shingle)) for t in utf8(batch.column("text"))]
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column("node"), lists(pa.array(flat), np.array([len(s) for s in sets], np.int64))], ["node", "shingles"]
            )

        return each

    return map_batches(texts_of, make, "node bigint, shingles array<bigint>")


def _neighbours(members: DataFrame, least: float, near: int) -> DataFrame:
    """(a, b, turn): candidates among texts that share a large band, a number of them that is linear in its texts.

    members: band, turn (place of the band), next (the texts' following bands), node, size, low. Within a band texts are ordered by
    the bands that follow it, and each is compared with the `near` before it; orders of 25 bands differ, so like texts
    stand together in several. Rows are dealt out in ranges of the whole order, so a band of any size spreads over
    tasks; the first of a band in a task also meets the band's smallest node. Kept are couples whose sizes allow the
    similarity and whose MinHash values agree in not much fewer places than it expects: four standard deviations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, last = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                signs = np.frombuffer(r["low"], np.uint8)
                if r["band"] != band:
                    band, last = r["band"], [(r["head"], r["head_size"], np.frombuffer(r["head_low"], np.uint8))]
                expected = len(signs) * least - 4 * np.sqrt(len(signs) * least * (1 - least))
                for node, size, other in last:
                    if node != r["node"] and min(size, r["size"]) >= max(size, r["size"]) * (least - 1e-9) and (signs == other).sum() >= expected:
                        out.append((min(node, r["node"]), max(node, r["node"]), r["turn"]))
                last = [*last[-near + 1 :], (r["node"], r["size"], signs)] if near > 1 else [(r["node"], r["size"], signs)]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "turn"])

    heads = members.groupBy("band").agg(F.min(F.struct("node", "size", "low")).alias("h"))
    placed = members.join(heads, "band").select("band", "turn", "next", "node", "size", "low", F.col("h.node").alias("head"), F.col("h.size").alias("head_size"), F.col("h.low").alias("head_low"))
    order = ["band", "next", "node"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("band", "turn", "node", "size", "low", "head", "head_size", "head_low").mapInArrow(run, "a bigint, b bigint, turn int")


def similar_links(
    texts_of: DataFrame, least: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5, all_pairs_to: int = 32, near: int = 2, first_turns: int = 6
) -> DataFrame:
    """(a, b): links that join distinct texts (columns node, text) whose shingle sets have a Jaccard similarity of `least`
    or more, every one verified on the whole sets.

    SimHash can't index this: sets 0.8 alike differ in about 10 of 64 bits, and segments short enough to agree but for
    one bit are shared by unrelated texts. So candidates share a band of MinHash values; sets 0.8 alike miss every
    one of 25 bands of 5 with a probability below 0.0001. A band of up to `all_pairs_to` texts is compared pair by pair,
    a larger one as `_neighbours` says. Candidates of the first bands are verified first; later ones only where they
    could join texts that aren't joined already, so copies of one text cost a few comparisons each.
    """
    signs = cut(_signatures(texts_of, shingle, bands, rows))
    held = signs.where("size > 0").select("node", "size", F.posexplode("bands").alias("turn", "band"))
    counts = held.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(held.join(counts, "band"))
    small = members.where(F.col("n") <= all_pairs_to)
    left, right = (small.select("band", "turn", F.col("node").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    alike_in_size = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (least - 1e-9)
    pairs = left.join(right.drop("turn"), "band").where("a < b").where(alike_in_size).select("a", "b", "turn")
    large = members.where(F.col("n") > all_pairs_to).select("band", "turn", "node").join(signs, "node")
    following = F.slice(F.concat("bands", "bands"), F.col("turn") + 2, 4)
    close = _neighbours(large.select("band", "turn", following.alias("next"), "node", "size", "low"), least, near)
    wanted = cut(pairs.unionByName(close).groupBy("a", "b").agg(F.min("turn").alias("turn")))
    nodes = wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(_shingle_sets(texts_of.join(nodes, "node", "left_semi"), shingle))
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")

    def verified(found: DataFrame) -> DataFrame:
        both = found.select("a", "b").join(one, "a").join(two, "b")
        common = F.size(F.array_intersect("_a", "_b"))
        union = F.size("_a") + F.size("_b") - common
        return cut(both.where(common >= union * (least - 1e-9)).select("a", "b"))

    early = verified(wanted.where(F.col("turn") < first_turns))
    roots = connected(early, [])
    rest = wanted.where(F.col("turn") >= first_turns)
    for side in "ab":
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"_root_{side}")), side, "left")
    apart = rest.where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b"))
    return early.unionByName(verified(apart))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each group, once; columns as given. A null doc_id is the smallest."""
    found = near_duplicates(by_row_key(docs), **options)
    kept = where_key(docs, found.where("doc_id = component_id"), "left_semi")
    return kept.withColumn("_key", row_key(kept)).dropDuplicates(["_key"]).drop("_key")


def keep_first_similar(docs: DataFrame, least: float = 0.8, **options) -> DataFrame:
    """`keep_first` by `similar_links` in place of fingerprints: groups are joined by verified similarity only.

    Texts of equal words are one text; those without words are one group.
    """
    words = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x09-\x0D\x20]+", " "))
    keyed = cut(by_row_key(docs).select("doc_id", F.xxhash64(F.coalesce(words, F.lit(""))).alias("node")))
    bare = docs.select(F.coalesce(words, F.lit("")).alias("text")).select(F.xxhash64("text").alias("node"), "text").dropDuplicates(["node"])
    roots = connected(similar_links(cut(bare), least, **options), [])
    first = keyed.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first_id").alias("doc_id"))
    kept = where_key(docs, named, "left_semi")
    return kept.withColumn("_key", row_key(kept)).dropDuplicates(["_key"]).drop("_key")
