"""Language-model scores of texts: a hashed maximum-entropy model over class-factored words.

The probability of a word is that of its class given the context, times that of its subclass given class and
context, times that of the word given its subclass. Classes come from the spelling alone, so every word, seen or not,
has one. The first two factors are softmaxes over hashed features of the context: the word before (bigram), the word
two before (skip), both (trigram), and both by their classes. The last factor is the word's smoothed share of its
subclass, with one further word for all unseen ones. The factors sum to one over all words.

Texts are cut into blocks of bounded size that hold token numbers and the words of the block. Counts are summed by
word over all blocks. Training goes over all blocks in rounds of disjoint ones: every task makes gradient steps on its
blocks, and a row of weights becomes the mean over the tasks that met it, by how often they did. The tables of weights
have a fixed size (`LEVELS` x features x `ROWS` x `WAYS`); counts grow with the corpus and never pass the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochlens.llm.common import lists, ragged, utf8
from epochlens.session import cut, scratch, tune

#: Outcomes of a softmax; a word has a class and, within it, a subclass.
WAYS = 16
#: Softmaxes of a word, features of a context, and rows of weights of one table.
LEVELS, FEATURES, ROWS = 2, 4, 1 << 16
#: Tokens of a block at which it ends (a longer text is one block), and rounds of training.
BLOCK_TOKENS, ROUNDS = 2_000_000, 2
#: Tokens of whole texts whose contexts are worked out together.
PIECE_TOKENS = 1 << 18
#: Tokens of one training task, tokens of one gradient step, and the length of the steps.
SHARD_TOKENS, STEP_TOKENS, RATE = 1 << 24, 32_768, 0.5
#: Scores of outcomes are kept in these bounds, within which single precision holds their exponentials.
LARGEST = 80.0
#: Rows of weights that travel together when the tasks' weights are averaged.
PART = 4_096

#: Stands for the end of a text; no word holds white space.
END = "\n"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def leaf_of(word: bytes) -> int:
    """Class and subclass of a word, from its last two bytes before punctuation and from all of it."""
    return zlib.crc32(word.rstrip(b".,;:!?)\"'")[-2:]) % WAYS * WAYS + zlib.crc32(word) % WAYS


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many each text has."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = pieces.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = ragged(np.asarray(pc.list_value_length(pieces), dtype=np.int64))
    return flat.filter(pa.array(full)), np.diff(ends[offsets])


def _blocks(docs: DataFrame, training: Column) -> str:
    """Write the blocks, by round, and return their folder.

    A block holds doc_ids, flags of training, lengths with the end token, token numbers as their low and high 16 bits
    (words are numbered by falling frequency, so the high ones are mostly zero), and the words with their subclass
    and count in training texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), F.col("text").cast("string").alias("text"))
    schema = (
        f"block bigint, round int, doc_ids array<{kind}>, training array<boolean>, lengths array<int>, low binary, high binary, "
        "words array<string>, leaves array<int>, counts array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        tokens, made = 0, 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            training = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[3] for h in held]) + 1
            coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
            words = [END.encode(), *utf8(coded.dictionary)]
            numbers = np.zeros(int(lengths.sum()), np.int64)
            ends = np.cumsum(lengths) - 1
            inside = np.ones(len(numbers), bool)
            inside[ends] = False
            numbers[inside] = np.asarray(coded.indices) + 1
            order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            numbers = place[numbers]
            words = [words[i] for i in order]
            counts = np.bincount(numbers[np.repeat(training, lengths)], minlength=len(words))
            one = lambda values: lists(values, np.array([len(values)]))
            columns = [
                pa.array([(task << 33) + made], pa.int64()), pa.array([made % ROUNDS], pa.int32()), one(ids), one(pa.array(training)),
                one(pa.array(lengths.astype(np.int32))),
                pa.array([(numbers & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([(numbers >> 16).astype("<u2").tobytes()], pa.binary()),
                one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array([leaf_of(w) for w in words], pa.int32())), one(pa.array(counts.astype(np.int64))),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["block", "round", "doc_ids", "training", "lengths", "low", "high", "words", "leaves", "counts"]
        for batch in batches:
            words, lengths = split_words(batch.column("text"))
            starts = ragged(lengths)
            at = 0
            while at < batch.num_rows:
                room = max(BLOCK_TOKENS - tokens, 1)
                stop = max(at + 1, int(np.searchsorted(starts + np.arange(len(starts)), starts[at] + at + room, "right")) - 1)
                training = np.asarray(batch.column("training").to_numpy(zero_copy_only=False)[at:stop], bool)
                held.append((batch.column("doc_id").slice(at, stop - at), training, words.slice(starts[at], starts[stop] - starts[at]), lengths[at:stop]))
                tokens += int(starts[stop] - starts[at]) + stop - at
                at = stop
                if tokens >= BLOCK_TOKENS or at < batch.num_rows:
                    yield block()
                    held, tokens, made = [], 0, made + 1
        if held:
            yield block()

    path = scratch(docs.sparkSession)
    source.mapInArrow(run, schema).write.partitionBy("round").parquet(path)
    return path


def _numbers(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) + (np.frombuffer(high, "<u2").astype(np.int64) << 16)


def _flat(batch: pa.RecordBatch, column: str, row: int) -> pa.Array:
    values = batch.column(column)
    return values.values.slice(values.offsets[row].as_py(), values.offsets[row + 1].as_py() - values.offsets[row].as_py())


def contexts(numbers: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, leaves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of weights of each token, for every level and feature, and each token's class and subclass."""
    since = np.arange(len(numbers)) - np.repeat(ragged(lengths)[:-1], lengths)

    def before(values: np.ndarray, k: int) -> np.ndarray:
        moved = np.zeros_like(values)
        moved[k:] = values[:-k]
        moved[since < k] = 0
        return moved

    word, leaf = hashes[numbers], leaves[numbers].astype(np.uint64)
    one, two = before(word, 1), before(word, 2)
    leaf_one, leaf_two = before(leaf, 1), before(leaf, 2)
    keys = [one + np.uint64(1), two + np.uint64(2), one * _MIX + two + np.uint64(3), leaf_one * np.uint64(WAYS) + leaf_two // np.uint64(WAYS) + np.uint64(4)]
    of_class = (leaf // np.uint64(WAYS) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rows = []
    for shift in (np.uint64(0), of_class):
        for key in keys:
            mixed = (key + shift) * _MIX
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MIX
            rows.append((mixed >> np.uint64(48)).astype(np.uint16))
    return rows, leaves[numbers]


class Model:
    """Weights of both levels, the sums of squared gradients that scale the steps, and the biases."""

    def __init__(self, totals: np.ndarray, distinct: np.ndarray):
        self.weights = np.zeros((LEVELS * FEATURES, ROWS, WAYS), np.float32)
        self.squares = np.full((LEVELS * FEATURES, ROWS), 1e-3, np.float32)
        self.totals, self.distinct = totals.astype(np.float64), distinct.astype(np.float64)
        smooth = (self.totals + 0.5 * (self.distinct + 1)).reshape(WAYS, WAYS)
        self.bias = [np.log(smooth.sum(axis=1) / smooth.sum()).astype(np.float32)[None, :], np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)]

    def word_share(self, counts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Natural logarithm of a word's share of its subclass; a word without a count stands for all unseen ones."""
        return np.log((counts + 0.5) / (self.totals[leaves] + 0.5 * (self.distinct[leaves] + 1)))

    def outcomes(self, level: int, rows: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        """Probabilities of the outcomes of a level, a row for each token."""
        z = self.bias[level][cls if level else np.zeros(len(cls), np.int64)]
        for feature in range(FEATURES):
            z += self.weights[level * FEATURES + feature].take(rows[level * FEATURES + feature], axis=0)
        np.clip(z, -LARGEST, LARGEST, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(WAYS, np.float32))[:, None]
        return z

    def log_leaf(self, rows: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's class and subclass."""
        out = np.empty(len(leaves))
        for at in range(0, len(leaves), STEP_TOKENS):
            part, cut_rows = leaves[at : at + STEP_TOKENS], [r[at : at + STEP_TOKENS] for r in rows]
            i, cls = np.arange(len(part)), part // WAYS
            both = self.outcomes(0, cut_rows, cls)[i, cls].astype(np.float64) * self.outcomes(1, cut_rows, cls)[i, part % WAYS]
            out[at : at + STEP_TOKENS] = np.log(np.maximum(both, 1e-300))
        return out

    def learn(self, rows: list[np.ndarray], leaves: np.ndarray, met: np.ndarray) -> None:
        """Gradient steps over the tokens in order; `met` counts how often each row of weights was met."""
        for at in range(0, len(leaves), STEP_TOKENS):
            part, cut_rows = leaves[at : at + STEP_TOKENS], [r[at : at + STEP_TOKENS] for r in rows]
            i, cls = np.arange(len(part)), part // WAYS
            for level, wanted in enumerate((cls, part % WAYS)):
                gradient = self.outcomes(level, cut_rows, cls)
                gradient[i, wanted] -= 1
                for table in range(level * FEATURES, (level + 1) * FEATURES):
                    order = np.argsort(cut_rows[table], kind="stable")
                    sorted_rows = cut_rows[table][order]
                    first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                    sizes = np.diff(np.append(first, len(order)))
                    which = sorted_rows[first]
                    summed = gradient.take(order[first], axis=0)
                    many = np.flatnonzero(sizes > 1)
                    if len(many):
                        inside = np.repeat(sizes > 1, sizes)
                        summed[many] = np.add.reduceat(gradient.take(order[inside], axis=0), ragged(sizes[many])[:-1], axis=0)
                    squares = self.squares[table][which] + np.einsum("ij,ij->i", summed, summed)
                    self.squares[table][which] = squares
                    summed *= (RATE / np.sqrt(squares))[:, None]
                    self.weights[table][which] -= summed
                    met[table][which] += sizes


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _chosen(numbers: np.ndarray, lengths: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and lengths of some texts."""
    return numbers[np.repeat(keep, lengths)], lengths[keep]


def pieces(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of whole texts of about `PIECE_TOKENS` tokens: which texts, and which tokens."""
    starts = ragged(lengths)
    at = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE_TOKENS, "right")) - 1)
        yield slice(at, stop), slice(int(starts[at]), int(starts[stop]))
        at = stop


def _round(spark: SparkSession, blocks: DataFrame, model: Model, shards: int) -> None:
    """One round: gradient steps in every task from the same weights, then the mean of what the tasks moved."""
    shared = spark.sparkContext.broadcast((model.weights, model.squares, model.totals, model.distinct))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, totals, distinct = shared.value
        own = Model(totals, distinct)
        own.weights[:], own.squares[:] = weights, squares
        met = np.zeros((LEVELS * FEATURES, ROWS), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.asarray(_flat(batch, "lengths", row), dtype=np.int64)
                keep = np.asarray(_flat(batch, "training", row).to_numpy(zero_copy_only=False), bool)
                numbers, lengths = _chosen(_numbers(batch.column("low")[row].as_py(), batch.column("high")[row].as_py()), lengths, keep)
                hashes, leaves = word_hashes(utf8(_flat(batch, "words", row))), np.asarray(_flat(batch, "leaves", row), dtype=np.int64)
                for texts, span in pieces(lengths):
                    own.learn(*contexts(numbers[span], lengths[texts], hashes, leaves), met)
        for table in range(LEVELS * FEATURES):
            for at in range(0, ROWS, PART):
                span = slice(at, at + PART)
                if not met[table, span].any():
                    continue
                moved = (own.weights[table, span] - weights[table, span]).astype(np.float16)
                values = [moved.tobytes(), (own.squares[table, span] - squares[table, span]).tobytes(), met[table, span].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([table * ROWS + at], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], ["part", "moved", "squares", "met"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, moved, squares, met in zip(*[batch.column(c).to_pylist() for c in ("part", "moved", "squares", "met")], strict=True):
                n = np.frombuffer(met, np.int64).astype(np.float64)
                add = [np.frombuffer(moved, np.float16).reshape(PART, WAYS) * n[:, None], np.frombuffer(squares, np.float32) * n, n]
                sums[part] = [a + b for a, b in zip(sums[part], add, strict=True)] if part in sums else add
        for part, (moved, squares, n) in sums.items():
            n = np.maximum(n, 1)
            values = [(moved / n[:, None]).astype(np.float32).tobytes(), (squares / n).astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], ["part", "moved", "squares"])

    moved = blocks.select("training", "lengths", "low", "high", "words", "leaves").coalesce(shards).mapInArrow(steps, "part int, moved binary, squares binary, met binary")
    # As many rows as the tables have parts, whatever the corpus.
    for r in moved.repartition("part").mapInArrow(means, "part int, moved binary, squares binary").collect():
        table, at = divmod(r["part"], ROWS)
        model.weights[table, at : at + PART] += np.frombuffer(r["moved"], np.float32).reshape(PART, WAYS)
        model.squares[table, at : at + PART] += np.frombuffer(r["squares"], np.float32)
    shared.unpersist()


def _located(blocks: DataFrame) -> DataFrame:
    """(block, pos, leaf, count, first): every word of every block with its count in all training texts; `first` marks
    one block of each word. Both sides of the join read one shuffle by word; a word has one row in each block."""
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "leaves", "counts")).alias("pos", "w"))
    words = words.select(F.col("w.words").alias("word"), "block", "pos", F.col("w.leaves").alias("leaf"), F.col("w.counts").alias("n")).repartition("word")
    total = words.groupBy("word").agg(F.sum("n").alias("count"), F.min("block").alias("_first"))
    return cut(words.join(total, "word").select("block", "pos", "leaf", "count", (F.col("block") == F.col("_first")).alias("first")))


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`; the model learns from the
    rows where `training` holds (null: it doesn't).

    Scores are base-10 logarithms. A null text is empty, and an empty text has its end token only. Rows with null or
    repeated ids are scored one by one. Without any training text every count is zero. A text of any length is
    one piece of a block, held by one task as token numbers. Further columns of any name are left out.
    """
    spark = tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    folder = _blocks(docs, training)
    shape = f"block bigint, doc_ids array<{kind}>, training array<boolean>, lengths array<int>, low binary, high binary, words array<string>, leaves array<int>, counts array<bigint>, round int"
    blocks = spark.read.schema(shape).parquet(folder)
    located = _located(blocks)
    totals, distinct = np.zeros(WAYS * WAYS, np.int64), np.zeros(WAYS * WAYS, np.int64)
    # One row for each subclass.
    for r in located.where("first").groupBy("leaf").agg(F.sum("count").alias("n"), F.count(F.when(F.col("count") > 0, 1)).alias("v")).collect():
        totals[r["leaf"]], distinct[r["leaf"]] = r["n"], r["v"]
    model = Model(totals, distinct)
    n_train, n_distinct = int(totals.sum()), int(distinct.sum())
    shards = -(-n_train // (SHARD_TOKENS * ROUNDS)) or 1
    for turn in range(ROUNDS) if n_train else ():
        _round(spark, blocks.where(F.col("round") == turn), model, shards)
    shared = spark.sparkContext.broadcast((model.weights, totals, distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, totals, distinct = shared.value
        own = Model(totals, distinct)
        own.weights = weights
        divisor = n_train + 0.5 * (n_distinct + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.asarray(_flat(batch, "lengths", row), dtype=np.int64)
                numbers = _numbers(batch.column("low")[row].as_py(), batch.column("high")[row].as_py())
                counts, leaves = (np.asarray(_flat(batch, c, row), dtype=np.int64) for c in ("known", "leaves"))
                hashes, ids = word_hashes(utf8(_flat(batch, "words", row))), _flat(batch, "doc_ids", row)
                seen, base, share = (counts > 0).astype(np.int64), np.log10((counts + 0.5) / divisor), own.word_share(counts, leaves)
                for texts, span in pieces(lengths):
                    part, n = numbers[span], lengths[texts]
                    rows, leaf = contexts(part, n, hashes, leaves)
                    starts = ragged(n)[:-1]
                    sums = [np.add.reduceat(v, starts) for v in (seen[part], base[part], (own.log_leaf(rows, leaf) + share[part]) / np.log(10))]
                    columns = [ids.slice(texts.start, len(n)), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), n_train)), *map(pa.array, sums[1:])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    known = located.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "count"))).alias("_known"))
    known = known.select("block", F.transform("_known", lambda x: x["count"]).alias("known"))
    ready = blocks.select("block", "doc_ids", "lengths", "low", "high", "words", "leaves").join(known, "block")
    return ready.select("doc_ids", "lengths", "low", "high", "words", "leaves", "known").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the doc_id as text leaves 1 when divided by 5; a null id is text of no length."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1
