"""Shared passages of documents and benchmark items by winnowing."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.llm.common import by_row_key, hash_cache, lists, map_batches, texts, utf8, where_key, word_list
from epochlens.session import cut

#: Words of a k-gram; with windows of GUARANTEE - GRAM + 1 grams, every shared run of GUARANTEE words is found.
GRAM = 5
_FILTER_BITS = 24
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += words[j : j + n] * _MIX[j]
    total ^= total >> np.uint64(29)
    total *= _MIX[63]
    return total ^ (total >> np.uint64(32))


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of consecutive grams the place of its smallest hash, the rightmost of equals."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        nxt = hashes[j : j + n]
        better = nxt <= best
        best[better] = nxt[better]
        at[better] = np.nonzero(better)[0] + j
    return at


def _word_hashes(words: list[bytes], cache: dict) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _new_cache() -> dict:
    return hash_cache(functools.partial(xxhash.xxh64_intdigest, seed=7))


def item_windows(items: DataFrame, guarantee: int = 10, gram: int = GRAM) -> DataFrame:
    """(item_id, gram, offset, words): each window of an item, its selected k-gram and where in the window that starts.

    An item of fewer than `guarantee` words is one window whose k-gram is all of it.
    """

    def make():
        cache = _new_cache()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, grams, offsets, windows = [], [], [], []
            for row, text in enumerate(utf8(batch.column("text"))):
                words = word_list(text)
                size = min(len(words), guarantee)
                if not size:
                    continue
                k = gram if size == guarantee else size
                hashes = _gram_hashes(_word_hashes(words, cache), k)
                at = selected(hashes, size - k + 1)
                for start, place in enumerate(at.tolist()):
                    owner.append(row)
                    grams.append(hashes[place])
                    offsets.append(place - start)
                    windows.append([w.decode() for w in words[start : start + size]])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(owner, pa.int64())),
                    pa.array(np.array(grams, np.uint64).view(np.int64)),
                    pa.array(offsets, pa.int32()),
                    pa.array(windows, pa.list_(pa.string())),
                ],
                ["item_id", "gram", "offset", "words"],
            )

        return each

    source = texts(items, "item_id")
    kind = source.schema["item_id"].dataType.simpleString()
    return map_batches(source, make, f"item_id {kind}, gram bigint, offset int, words array<string>")


def _membership_filter(windows: DataFrame) -> np.ndarray:
    """Bits of a table of 2^24 places that the items' grams hash to: 2 MB whatever the number of items."""
    place = F.shiftrightunsigned("gram", 64 - _FILTER_BITS)
    rows = (
        windows.groupBy(F.shiftright(place, 5).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 32).cast("int"))).alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (_FILTER_BITS - 5), np.uint32)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def document_fingerprints(docs: DataFrame, table: np.ndarray, lengths: list[int], guarantee: int = 10, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, found): per document those winnowed k-grams that the filter lets through.

    `found` holds gram, pos (its first word) and near, the words around it that windows containing it can have.
    `lengths` are the lengths of items shorter than the guarantee; for each, every run of that many words is kept.
    """
    before, after = guarantee - gram, guarantee

    def make():
        cache = _new_cache()

        def hits(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
            bit = hashes[at] >> np.uint64(64 - _FILTER_BITS)
            known = (table[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
            return at[known.astype(bool)]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_found, grams, places, near = [], [], [], [], []
            for text in utf8(batch.column("text")):
                words = word_list(text)
                n_words.append(len(words))
                hashes = _word_hashes(words, cache)
                plans = [(gram, guarantee - gram + 1)] + [(k, 1) for k in lengths]
                count = 0
                for k, window in plans:
                    runs = _gram_hashes(hashes, k)
                    at = hits(runs, np.unique(selected(runs, window)) if window > 1 else np.arange(len(runs)))
                    for p in at.tolist():
                        grams.append(runs[p])
                        places.append(p)
                        left = max(0, before - p)
                        near.append([""] * left + [w.decode() for w in words[max(0, p - before) : p + after]])
                    count += len(at)
                n_found.append(count)
            found = pa.StructArray.from_arrays(
                [pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(places, pa.int32()), pa.array(near, pa.list_(pa.string()))],
                ["gram", "pos", "near"],
            )
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), lists(found, np.array(n_found, np.int64))],
                ["doc_id", "n_words", "found"],
            )

        return each

    source = texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, make, f"doc_id {kind}, n_words bigint, found array<struct<gram: bigint, pos: int, near: array<string>>>")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, size), which are sorted by start."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, guarantee: int = 10, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    Winnowing keeps the smallest k-gram hash of every window, so texts that share `guarantee` words share a kept
    gram. Kept grams of documents and items are joined on their hash, and a hit is extended over the words
    around it: only equal words count. A 2 MB filter built from all items keeps other grams out of the shuffle.
    Null, empty and word-less texts have no words; repeated rows are documents of their own; items without an
    item_id mark words but are not listed. Only doc_id, item_id and text are read.
    """
    windows = cut(item_windows(items, guarantee, gram).withColumn("window", F.sha2(F.array_join("words", " "), 256)))
    lengths = sorted(r[0] for r in windows.select(F.size("words").alias("n")).where(F.col("n") < guarantee).distinct().collect())
    table = _membership_filter(windows)
    found = document_fingerprints(docs, table, lengths, guarantee, gram).withColumn("_row", F.monotonically_increasing_id())
    found = cut(found)
    distinct = windows.groupBy("window").agg(
        F.first("gram").alias("gram"), F.first("offset").alias("offset"), F.first("words").alias("words")
    )
    grams = found.where(F.size("found") > 0).select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    hits = cut(
        grams.join(distinct, "gram")
        # `near` starts `guarantee - gram` words before the k-gram, the window `offset` words before it.
        .where(F.expr(f"slice(near, {guarantee - gram} + 1 - offset, size(words)) = words AND pos >= offset"))
        .select("_row", (F.col("pos") - F.col("offset")).cast("bigint").alias("start"), F.size("words").cast("bigint").alias("size"), "window")
    )
    spans = hits.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    listed = (
        hits.select("_row", "window").distinct()
        .join(windows.select("window", "item_id").where("item_id IS NOT NULL").distinct(), "window")
        .groupBy("_row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    marked = spans.select("_row", _covered(F.col("spans")).alias("n_hit")).join(listed, "_row", "left")
    return found.select("_row", "doc_id", "n_words").join(marked, "_row", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a shared passage; columns as given."""
    return where_key(docs, contamination(by_row_key(docs), items, **options).where("contaminated"), "left_anti")
