"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import dataclasses
import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochlens.llm.common import by_row_key, lists, map_batches, ragged, texts, utf8, where_key, word_list
from epochlens.session import cut

#: Bound of the model, whatever the size of the corpus: labelled rows learnt from. All their words are terms.
MAX_EXAMPLES = 20_000
#: Examples whose leave-one-out votes calibrate the scores.
MAX_CALIBRATION = 4_000
#: What a word weighs, as a log-likelihood ratio, that stands in toxic and other examples alike.
NEUTRAL = 0.01
#: Reading an entry of an example's row costs so many times an entry of a posting list; changes speed only.
ROW_COST = 2
#: Reading a block bound costs so many times an entry of a posting list, as its gain is uncertain; changes speed only.
BLOCK_COST = 8
#: So many rare terms are read before the first bound; changes speed only.
STEP = 64
#: So many of the most frequent terms are kept as full columns and multiplied for so many texts at once; changes speed only.
FREQUENT, TOGETHER = 512, 128
#: Sums before the last step are in single precision: bounds give way by so much and 1e-7 a term, cosines are computed anew.
SLACK = 5e-5


def _words(text: bytes) -> list[bytes]:
    """Words of a text in lower case; A-Z are lower-cased as they are split."""
    return word_list(text if text.isascii() else text.decode().lower().encode())


def words_of(text: bytes) -> Counter:
    """Words of a text in lower case, and how often each stands there."""
    return Counter(_words(text))


def unit_weights(idf: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a text's terms, of length one."""
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum())


@dataclass
class Index:
    """Labelled examples as unit vectors: their rows, postings by term, largest weight of a term in each block of examples.

    `weight` is a term's factor: its inverse document frequency times how strongly it goes with one label.
    """

    terms: dict[bytes, int]
    weight: np.ndarray
    indptr: np.ndarray  # rows of the examples
    columns: np.ndarray
    weights: np.ndarray
    positives: np.ndarray  # labelled rows with this vector
    negatives: np.ndarray
    example_ids: np.ndarray
    prior: float
    empty_score: float
    block: int = 64
    steps: tuple[np.ndarray, np.ndarray] | None = None  # calibration: score up to here, calibrated value

    def _build(self):
        """Postings, where examples are searched: in tasks. The driver holds the rows only.

        The most frequent terms, which hold most entries, are columns of a matrix and have no postings.
        """
        n_terms, n_rows = len(self.weight), len(self.indptr) - 1
        self.row_sizes = np.diff(self.indptr)
        self.sizes = np.bincount(self.columns, minlength=n_terms)
        self._dense = np.zeros(n_terms)
        often = np.argsort(-self.sizes, kind="stable")[:FREQUENT]
        self._column = np.full(n_terms, -1, np.int32)
        self._column[often] = np.arange(len(often))
        self._often = np.zeros((n_rows, len(often)), np.float32)
        self.sizes[often] = 0
        self.posting_ptr = ragged(self.sizes)
        of_row = np.repeat(np.arange(n_rows, dtype=np.min_scalar_type(n_rows)), self.row_sizes)
        # An entry of the other terms is its term and place, sorted where the postings will stand; rows ascend with places.
        self.postings = np.empty(self.posting_ptr[-1], np.int64)
        n_entries = 0
        for at in range(0, len(self.columns), 1 << 18):
            part = slice(at, at + (1 << 18))
            column = self._column[self.columns[part]]
            held = column >= 0
            self._often[of_row[part][held], column[held]] = self.weights[part][held]
            others = np.flatnonzero(~held) + at
            self.postings[n_entries : n_entries + len(others)] = self.columns[others].astype(np.int64) << 32 | others
            n_entries += len(others)
        self.postings.sort()
        # Row and weight of a posting stand together in 8 bytes, so that they are read at once.
        rows, shares = self.postings.view(np.int32)[::2], self.postings.view(np.float32)[1::2]
        for at in range(0, n_entries, 1 << 18):
            part = slice(at, at + (1 << 18))
            places = self.postings[part] & 0xFFFFFFFF
            rows[part], shares[part] = of_row[places], self.weights[places]
        del of_row
        self.n_blocks = -(-n_rows // self.block)
        starts = self._block_starts()
        held = np.flatnonzero(self.sizes)
        self.block_sizes, self.term_max = np.zeros(n_terms, np.int32), np.zeros(n_terms, np.float32)
        if len(held):
            self.block_sizes[held] = np.add.reduceat(starts, self.posting_ptr[held], dtype=np.int32)
            self.term_max[held] = np.maximum.reduceat(shares, self.posting_ptr[held])

    def _block_starts(self) -> np.ndarray:
        """Which postings are the first of their term in their block of examples."""
        rows, starts = self.postings.view(np.int32)[::2], np.ones(len(self.postings), bool)
        for at in range(1, len(rows), 1 << 20):
            blocks = rows[at - 1 : at + (1 << 20)] // np.int32(self.block)
            np.not_equal(blocks[1:], blocks[:-1], out=starts[at : at + (1 << 20)])
        starts[self.posting_ptr[:-1][self.sizes > 0]] = True
        return starts

    def _block_bounds(self):
        """Largest weights by term and block; worked out when first asked for, as most searches end without them."""
        first = np.flatnonzero(self._block_starts())
        self.block_max = np.maximum.reduceat(self.postings.view(np.float32)[1::2], first) if len(first) else np.empty(0, np.float32)
        self.block_of = self.postings.view(np.int32)[::2][first] // np.int32(self.block)
        self.block_ptr = ragged(self.block_sizes)

    def __getstate__(self) -> dict:
        """What travels to tasks: the examples' rows in a compact form, without words; postings are built again there."""
        steps = np.diff(self.columns.astype(np.int32), prepend=np.int32(0))
        fields = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        return fields | {"terms": {}, "columns": zlib.compress(steps.tobytes(), 1)}

    def __setstate__(self, state: dict):
        steps = np.frombuffer(zlib.decompress(state["columns"]), np.int32)
        self.__dict__ = state | {"columns": np.cumsum(steps, dtype=np.int32)}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit_weights(self.weight, terms, counts)

    @staticmethod
    def _runs(ptr: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """How many entries each `wanted` group has, and the entries of all of them from each of `values`.

        A group's entries stand together, so they are copied as one piece.
        """
        starts, ends = ptr[wanted], ptr[wanted + 1]
        pieces = [slice(*x) for x in zip(starts.tolist(), ends.tolist())]
        return [ends - starts, *(np.concatenate([v[:0], *map(v.__getitem__, pieces)]) for v in values)]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each (terms, weights); the frequent terms of `TOGETHER` texts are one matrix product."""
        if "postings" not in self.__dict__:
            self._build()
        found, sums = [], np.empty((min(TOGETHER, len(vectors)), len(self.indptr) - 1), np.float32)
        for at in range(0, len(vectors), TOGETHER):
            part = vectors[at : at + TOGETHER]
            asked = np.zeros((len(part), self._often.shape[1]), np.float32)
            for i, (terms, weights) in enumerate(part):
                column = self._column[terms]
                asked[i, column[column >= 0]] = weights[column >= 0]
            np.matmul(asked, self._often.T, out=sums[: len(part)])
            found += [self._nearest(*vector, k, partial) for vector, partial in zip(part, sums)]
        return found

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine, ties by place, and their cosines; exact.

        The frequent terms are multiplied out. Postings of the others are added up by falling share that a term can have in
        a cosine. What the terms still open can add to an example is bounded by their length and by their largest weights
        in its block; examples that this can't lift to the k-th best are left out, and as soon as reading the others'
        rows is cheaper than reading on, their cosines are computed.
        """
        return self.nearest_of([(terms, weights)], k)[0]

    def _nearest(self, all_terms: np.ndarray, all_weights: np.ndarray, k: int, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_rows = len(self.indptr) - 1
        rare = self._column[all_terms] < 0
        terms, weights = all_terms[rare], all_weights[rare].astype(np.float64)
        share = weights * self.term_max[terms]
        order = np.argsort(-share, kind="stable")
        terms, weights, share = terms[order], weights[order], share[order]
        single = weights.astype(np.float32)
        most = np.minimum(np.cumsum(share[::-1]), np.sqrt(np.cumsum((weights * weights)[::-1])))
        open_share = np.concatenate([most[::-1], [0.0]])
        open_size = np.concatenate([np.cumsum(self.sizes[terms][::-1])[::-1], [0]])
        open_blocks = np.concatenate([np.cumsum(self.block_sizes[terms][::-1])[::-1], [0]])
        # A sum of m shares that are not negative is off by m roundings at most.
        slack = SLACK + 1e-7 * len(terms)
        at, step = 0, STEP
        while True:
            upto = slice(at, at + step)
            sizes, held = self._runs(self.posting_ptr, terms[upto], self.postings)
            rows, held = held.view(np.int32)[::2], held.view(np.float32)[1::2]
            np.add.at(partial, rows.astype(np.intp), held * np.repeat(single[upto], sizes))
            at, step = min(at + step, len(terms)), step * 4
            least = float(np.partition(partial, -k)[-k]) if n_rows > k else 0.0
            if at == len(terms):
                rows = np.flatnonzero(partial >= max(least - slack, 1e-30))
                break
            if least > open_share[at]:
                rows = np.flatnonzero(partial >= least - slack - float(open_share[at]))
                if ROW_COST * self.row_sizes[rows].sum() > open_size[at] > BLOCK_COST * open_blocks[at]:
                    if "block_ptr" not in self.__dict__:
                        self._block_bounds()
                    sizes, blocks, most = self._runs(self.block_ptr, terms[at:], self.block_of, self.block_max)
                    rest = np.bincount(blocks, np.repeat(weights[at:], sizes) * most, self.n_blocks)
                    rows = rows[partial[rows] + rest[rows // self.block] >= least - slack]
                if ROW_COST * self.row_sizes[rows].sum() <= open_size[at]:
                    break
        if not len(rows):
            return np.empty(0, np.int64), np.empty(0)
        self._dense[all_terms] = all_weights
        sizes, columns, held = self._runs(self.indptr, rows, self.columns, self.weights)
        cosine = np.add.reduceat(self._dense[columns] * held, ragged(sizes)[:-1])
        self._dense[all_terms] = 0
        rows, cosine = rows[cosine > 0], cosine[cosine > 0]
        top = np.lexsort((rows, -np.round(cosine, 12)))[:k]
        return rows[top], cosine[top]

    def vote(self, found: np.ndarray, cosine: np.ndarray, without: tuple[int, int, int] | None = None) -> float:
        """Share of toxic rows among the neighbours, each weighted by 1 / (distance + 0.1), and the prior as one vote.

        `without` leaves one labelled row out: its place, and how many positive and negative rows it is.
        """
        p, n = self.positives[found].astype(float), self.negatives[found].astype(float)
        if without is not None:
            p[found == without[0]] -= without[1]
            n[found == without[0]] -= without[2]
        w = 1 / (1.1 - np.minimum(cosine, 1))
        return float((w @ p + self.prior) / (w @ (p + n) + 1))

    def calibrated(self, score: float) -> float:
        if self.steps is None:
            return score
        return float(np.interp(score, *self.steps))


def _monotone(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that fall; means of the pools by mean score."""
    pools: list[list[float]] = []
    for s, y, w in sorted(zip(scores.tolist(), labels.tolist(), weights.tolist())):
        pools.append([s * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, terms, counts): places in `terms` of the words that a whole text holds, ascending, and how often."""

    terms_given = bool(terms)
    packed = zlib.compress(b"\n".join(terms), 1)  # words hold no line ends

    def make():
        place = {t: i for i, t in enumerate(zlib.decompress(packed).split(b"\n"))} if terms_given else {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for text in utf8(batch.column("text")):
                words = _words(text)
                parts.append(np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words)))
            found, of = np.concatenate([np.empty(0, np.int32), *parts]), np.repeat(np.arange(len(parts)), np.array([len(x) for x in parts], np.int64))
            held = found >= 0
            # One number for text and term, so that one sort counts the terms of all texts.
            keys = of[held] << 32 | found[held]
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            counts, keys = np.diff(first, append=len(keys)).astype(np.int32), keys[first]
            found, sizes = keys.astype(np.int32), np.bincount(keys >> 32, minlength=len(parts))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists(pa.array(found), sizes), lists(pa.array(counts), sizes)], ["doc_id", "terms", "counts"],
            )

        return each

    source = texts(docs)
    return map_batches(source, make, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, terms array<int>, counts array<int>")


def _vectors(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each row of a batch or table of `term_counts`."""
    columns = []
    for name in ("terms", "counts"):
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
        columns.append(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return list(zip(*columns))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """At most `max_examples` labelled rows outside the held-out fifth, the first by hash of their id.

    An id with labels of both kinds counts as toxic; null labels and ids teach nothing.
    """
    known = cut(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("_place", F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53))
    )
    # The places spread evenly over 0..1, so twice the wanted share of them surely holds the first ones; only those are sorted.
    share = 2.0 * max_examples / max(1, known.count())
    first = known.where(F.col("_place") <= share).orderBy("_place", "doc_id").limit(max_examples)
    chosen = cut(first.select(F.col("doc_id").alias("_id"), "toxic"))
    source = texts(docs)
    # At most `max_examples` ids, so they may travel to every task.
    rows = source.join(F.broadcast(chosen), source["doc_id"] == F.col("_id")).select("_id", "toxic", "text")
    # One row per id, so that repeated rows of a document stay within the bound.
    return rows.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).withColumnRenamed("_id", "doc_id")


def _weighed_terms(examples: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """All words of the examples, and the log-likelihood ratio of each with the label, largest first.

    Copies of a text count once, else the rare words of a copied text would look like telling ones.
    """
    # One row for each text, known by its digest: at most `max_examples`.
    first = cut(examples.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).drop("digest"))
    totals = first.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if not p or p == n:
        return [], np.empty(0)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [list(words_of(text)) for text in utf8(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.binary()))], ["toxic", "terms"])

        return each

    distinct = examples.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("toxic", "text")
    words = map_batches(distinct, make, "toxic int, terms array<binary>")
    counts = words.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    df, pos = F.col("df").cast("double"), F.col("pos").cast("double")
    ratio = 2 * (
        part(pos, df * (p / n)) + part(df - pos, df * (1 - p / n))
        + part(p - pos, (n - df) * (p / n)) + part((n - p) - (df - pos), (n - df) * (1 - p / n))
    )
    # Words of at most `max_examples` texts.
    found = counts.select("term", F.round(F.greatest(ratio, F.lit(0.0)), 9).alias("ratio")).toArrow().sort_by([("ratio", "descending"), ("term", "ascending")])
    return found.column("term").to_pylist(), found.column("ratio").to_numpy()


def fit(
    docs: DataFrame, labels: DataFrame, keyed: DataFrame | None = None, *, max_examples: int = MAX_EXAMPLES, neighbours: int = 10,
) -> tuple[Index, DataFrame]:
    """The index of labelled examples, and the term counts of all documents that it was weighted with.

    The counts carry the ids of `keyed`, the same documents under other ids, where that is given. What reaches the driver
    is bounded by `max_examples` rows and their words; inverse document frequencies count all documents, and a word weighs
    them times its log-likelihood ratio with the label in the examples (`NEUTRAL` at least, so that every word counts).
    Scores are calibrated by isotonic regression on leave-one-out votes of the examples.
    """
    examples = cut(_examples(docs, labels, max_examples))
    terms, ratio = _weighed_terms(examples)
    counted = cut(term_counts(docs if keyed is None else keyed, terms))
    n_docs = counted.count()
    df = np.zeros(len(terms))
    if terms:
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[held.column("term").to_numpy()] = held.column("count").to_numpy()
        del held
    weight = (np.log((n_docs + 1) / (df + 1)) + 1) * (ratio + NEUTRAL)
    rows = term_counts(examples.select(F.struct("doc_id", "toxic").alias("doc_id"), "text"), terms)
    del terms, ratio, df
    # Examples with the same terms and counts are one row; ordered by terms, so those with the same strongest words stand together.
    toxic = F.col("doc_id.toxic") == 1
    grouped = rows.groupBy("terms", "counts").agg(F.count_if(toxic).alias("p"), F.count_if(~toxic).alias("n"), F.min("doc_id.doc_id").alias("id"))
    found = _weighed_rows(grouped.orderBy("terms", "counts"), weight).toArrow()
    labels_of = [found.column(c).to_numpy() for c in "pn"]
    ids = found.column("id").to_numpy(zero_copy_only=False).astype(object)
    sizes = pc.list_value_length(found.column("terms")).to_numpy().astype(np.int64)
    flat, weights = (pc.list_flatten(found.column(c)).to_numpy() for c in ("terms", "weights"))
    del found
    # The row of the examples without a word of their own is the first, if there is one.
    bare = int(len(sizes) > 0 and sizes[0] == 0)
    empty = [int(x[0]) if bare else 0 for x in labels_of]
    total = [int(x.sum()) for x in labels_of]
    prior = (total[0] + 0.5) / (sum(total) + 1)
    index = Index(
        weight=weight, indptr=ragged(sizes[bare:]), columns=flat, weights=weights, positives=labels_of[0][bare:], negatives=labels_of[1][bare:],
        example_ids=ids[bare:], prior=prior, terms={}, empty_score=(empty[0] + prior) / (sum(empty) + 1),
    )
    votes = _left_out(docs.sparkSession, index, neighbours)
    if len(set(votes.column("label").to_pylist())) == 2:
        index.steps = _monotone(*(votes.column(c).to_numpy() for c in ("score", "label", "weight")))
    return index, counted


def _weighed_rows(grouped: DataFrame, weight: np.ndarray) -> DataFrame:
    """(terms, weights, p, n, id): the unit weights of each row's terms in place of their counts."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            units = [unit_weights(weight, t, n).astype(np.float32) if len(t) else np.empty(0, np.float32) for t, n in _vectors(batch)]
            flat = np.concatenate([*units, np.empty(0, np.float32)])
            unit = lists(pa.array(flat), np.array([len(u) for u in units], np.int64))
            return pa.RecordBatch.from_arrays([batch.column("terms"), unit, *(batch.column(c) for c in ("p", "n", "id"))], ["terms", "weights", "p", "n", "id"])

        return each

    kind = grouped.schema["id"].dataType.simpleString()
    return map_batches(grouped, make, f"terms array<int>, weights array<float>, p bigint, n bigint, id {kind}")


def _left_out(spark: SparkSession, index: Index, neighbours: int) -> pa.Table:
    """(score, label, weight): votes on at most `MAX_CALIBRATION` examples without themselves, worked out in tasks."""
    def each(batches):
        for batch in batches:
            found, chosen = [], batch.column("id").to_pylist()
            rows = [slice(index.indptr[i], index.indptr[i + 1]) for i in chosen]
            for i, (near, cosine) in zip(chosen, index.nearest_of([(index.columns[r], index.weights[r]) for r in rows], neighbours)):
                for label, count in ((1, index.positives[i]), (0, index.negatives[i])):
                    if count:
                        found.append((index.vote(near, cosine, (i, label, 1 - label)), float(label), float(count)))
            columns = np.array(found, np.float64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["score", "label", "weight"])

    # The groups are in the order of their terms, so every so-manieth is a spread-out choice.
    n = len(index.indptr) - 1
    chosen = spark.range(0, n, max(1, -(-n // MAX_CALIBRATION)))
    return chosen.mapInArrow(each, "score double, label double, weight double").toArrow()


def score(counted: DataFrame, index: Index, neighbours: int = 10) -> DataFrame:
    """(doc_id, score, predicted, evidence): `evidence` holds the doc_id and cosine of the nearest examples."""

    def make():
        memory: dict[bytes, tuple] = {}
        names = pa.array([str(x) for x in index.example_ids], pa.string())
        none = (index.empty_score, np.empty(0, np.int64), np.empty(0))

        def of(near: np.ndarray, cosine: np.ndarray) -> tuple:
            return index.calibrated(index.vote(near, cosine)) if len(near) else index.empty_score, near, cosine

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(memory) > 20_000:
                memory.clear()
            keys, new = [], {}
            for terms, counts in _vectors(batch):
                key = hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest() if len(terms) else b""
                if key and key not in memory:
                    new[key] = (terms, index.vector(terms, counts))
                keys.append(key)
            memory.update(zip(new, (of(*f) for f in index.nearest_of(list(new.values()), neighbours))))
            found = [memory[key] if key else none for key in keys]
            scores = np.clip(np.array([f[0] for f in found], float), 0, 1)
            near, cosine = (np.concatenate([none[i], *(f[i] for f in found)]) for i in (1, 2))
            pairs = pa.StructArray.from_arrays([names.take(pa.array(near)), pa.array(cosine)], ["doc_id", "cosine"])
            evidence = lists(pairs, np.array([len(f[1]) for f in found], np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence],
                ["doc_id", "score", "predicted", "evidence"],
            )

        return each

    kind = counted.schema["doc_id"].dataType.simpleString()
    return map_batches(counted, make, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id: string, cosine: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, neighbours: int = 10, **options) -> DataFrame:
    """One row per document: doc_id, score, predicted, evidence.

    Null and empty texts get the share of toxic rows among examples without any word of their own; so do all rows when
    nothing can be learnt (no labels, or labels of one kind). Repeated rows get equal scores. Only doc_id and text
    of the documents and doc_id and toxic of the labels are read; the id is used to find labels, never to score.
    """
    index, counted = fit(docs, labels, neighbours=neighbours, **options)
    return score(counted, index, neighbours)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, neighbours: int = 10, **options) -> DataFrame:
    """The documents not predicted toxic; columns as given."""
    index, counted = fit(docs, labels, by_row_key(docs), neighbours=neighbours, **options)
    return where_key(docs, score(counted, index, neighbours).where("predicted = 1"), "left_anti")
