"""Token ids of texts in files of range-coded blocks, and their reader."""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import filterfalse, islice, repeat
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from epochlens.llm import rans
from epochlens.llm.common import ragged, texts
from epochlens.session import scratch, tune

#: Ids that share a frequency table and make one row of a file; a longer document is a row of its own.
GROUP = 2_000_000
#: About 130 MB of a worker.
_CACHED_WORDS = 800_000
#: White space on both sides of a space, or before a last one: there a space doesn't begin a piece of its own.
_SPACE_RUN = re.compile(r"\s \s|\s \Z")
_HEAD = re.compile(r"[^\W_]*")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, without special tokens.

    For byte-level vocabularies a space that follows or precedes a non-space always begins a new piece, so the ids
    of a text are those of its space-separated words one after another; words met before are looked up. Texts with
    longer runs of white space, and other kinds of vocabularies, go through the library as a whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        parsed = json.loads(spec)
        before = parsed.get("pre_tokenizer") or {}
        self.by_words = not parsed.get("normalizer") and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
            self.place: dict[str, int] = {}
            self.rests: dict[str, int] = {}
            self.flat, self.starts, self.size = np.empty(1 << 16, np.uint32), np.zeros(1 << 10, np.int64), 0

    def _plain(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stored pieces one after another, and the length of each."""
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)], lengths

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Append pieces; their places."""
        used, at = int(self.starts[self.size]), self.size
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * len(ids), np.uint32)])
        if at + len(lengths) >= len(self.starts):
            self.starts = np.concatenate([self.starts[: at + 1], np.empty(at + 2 * len(lengths), np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.starts[at + 1 : at + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.size += len(lengths)
        return range(at, self.size)

    def _store_plain(self, pieces: list[str]) -> range:
        found = [np.array(x, np.uint32) for x in self._plain(pieces)]
        return self._store(np.concatenate([*found, np.empty(0, np.uint32)]), np.array([len(x) for x in found], np.int64))

    def _learn(self, words: list[str]) -> None:
        """Store the ids of new words, each taken with the space before it.

        A leading run of letters and digits always ends a piece, so it is encoded once for all that may follow it.
        """
        known, rest = set(filter(str.isalnum, words)), list(filterfalse(str.isalnum, words))
        edged = [w for w in rest if not w or w.strip() != w]
        if edged:
            self.place.update(zip(edged, self._store_plain([" " + w for w in edged])))
            rest = [w for w in rest if w not in self.place]
        heads = [_HEAD.match(w)[0] for w in rest]
        known.update(w for w, h in zip(rest, heads) if not h)
        known.update(h for h in set(filter(None, heads)) if h not in self.place)
        self._learn_joined(list(known))
        joined = [w for w, h in zip(rest, heads) if h]
        heads = list(filter(None, heads))
        tails = [w[len(h) :] for w, h in zip(joined, heads)]
        new = list({r for r in tails if r not in self.rests})
        self.rests.update(zip(new, self._store_plain(new)))
        pairs = np.empty((len(joined), 2), np.int64)
        for i, (known_places, pieces) in enumerate(((self.place, heads), (self.rests, tails))):
            pairs[:, i] = np.fromiter(map(known_places.__getitem__, pieces), np.int64, len(pieces))
        ids, lengths = self._gather(pairs.reshape(-1))
        self.place.update(zip(joined, self._store(ids, lengths.reshape(-1, 2).sum(axis=1))))

    def _learn_joined(self, words: list[str]) -> None:
        """Words without white space at their ends, encoded in long lines; a piece that begins with a space begins a word."""
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            ids = np.array(self._plain([" " + " ".join(some)])[0], np.uint32)
            begin = np.nonzero(self.begins[ids])[0]
            if len(begin) != len(some):
                raise AssertionError("pieces don't begin with a space each")
            self.place.update(zip(some, self._store(ids, np.diff(np.append(begin, len(ids))))))

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(x, np.uint32) for x in self._plain(batch)]
        whole = [bool(_SPACE_RUN.search(t)) for t in batch]
        split = [[t] if w else t.split(" ") for t, w in zip(batch, whole)]
        heads = self._plain([s[0] for s in split])
        words = [w for s in split for w in s[1:]]
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.nonzero(at < 0)[0].tolist()
        before = self.size, len(self.place), len(self.rests)
        if missing:
            self._learn(list({words[i] for i in missing}))
            at[missing] = [self.place[words[i]] for i in missing]
        ids, lengths = self._gather(at)
        if len(self.place) + len(self.rests) > _CACHED_WORDS:
            # Full: what this batch has brought is forgotten, what came earlier is more likely to come again.
            for known, n in ((self.place, before[1]), (self.rests, before[2])):
                for w in list(islice(reversed(known), len(known) - n)):
                    del known[w]
            self.size = before[0]
        cuts = np.append(0, np.cumsum(lengths))[ragged(np.array([len(s) - 1 for s in split], np.int64))]
        return [np.concatenate([np.array(h, np.uint32), ids[a:b]]) for h, a, b in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist())]


def _encoder(spec: str) -> Encoder:
    """One encoder per worker process and vocabulary, so that its memory serves all tasks there.

    Functions travel to workers by value, so module globals don't outlive a task; a named place in sys.modules does.
    """
    held = sys.modules.setdefault("_epochlens_encoders", SimpleNamespace(by_spec={})).by_spec
    if spec not in held:
        held.clear()
        held[spec] = Encoder(spec)
    return held[spec]


def _group_row(part: int, group: int, doc_ids: list, ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids)
    table = rans.Table.of(flat)
    payload, checkpoints = rans.encode(flat, table)
    return {
        "part": part, "group": group, "n_tokens": len(flat), "doc_ids": doc_ids, "lengths": [len(x) for x in ids],
        "table": table.pack(), "checkpoints": checkpoints, "payload": payload,
    }


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, group: int = GROUP) -> None:
    """Write the ids of all texts, in ascending order of doc_id, as a table of coded groups at `path`.

    `vocabulary` is the local path of a tokenizers file; its content travels to the tasks. A row of the table (in
    Parquet files, which Spark commits task by task) holds consecutive documents: part and group (their order), doc_ids
    and lengths, the frequency table that its blocks share, checkpoints (offset, words and crc32 of each block) and
    the payload. Rows of equal doc_id stand by a hash of their text, null ids first.
    """
    spec = Path(vocabulary).read_text(encoding="utf-8")
    source = texts(docs)
    kind = source.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    schema = pa.schema([
        ("part", pa.int32()), ("group", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(arrow)), ("lengths", pa.list_(pa.int64())),
        ("table", pa.binary()), ("checkpoints", pa.binary()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n_groups, encoder, held, doc_ids, size = TaskContext.get().partitionId(), 0, None, [], [], 0
        for batch in batches:
            encoder = encoder or _encoder(spec)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                if held and size + len(ids) + 1 > group:
                    yield pa.RecordBatch.from_pylist([_group_row(part, n_groups, doc_ids, held)], schema)
                    n_groups, held, doc_ids, size = n_groups + 1, [], [], 0
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(ids) + 1
        if held:
            yield pa.RecordBatch.from_pylist([_group_row(part, n_groups, doc_ids, held)], schema)

    order = [F.col("doc_id"), F.xxhash64("text"), F.col("_tie")]
    spread = source.withColumn("_tie", F.monotonically_increasing_id())
    # In as many ranges as shuffles have; the last column lets equal ids spread over several.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = spread.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ddl = (
        f"part int, group int, n_tokens bigint, doc_ids array<{kind.simpleString()}>, lengths array<bigint>, "
        "table binary, checkpoints binary, payload binary"
    )
    # Coded bytes don't compress any further.
    sorted_docs.mapInArrow(run, ddl).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written table: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    Groups are decoded independently; only their sizes are summed to find where each begins.
    """
    tune(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                table = rans.Table.unpack(r["table"].as_py())
                ids = rans.decode(r["payload"].as_py(), r["checkpoints"].as_py(), table, r["n_tokens"].as_py()).astype("<u4")
                lengths = r["lengths"].values.to_numpy(zero_copy_only=False)
                at = ragged(lengths)
                bounds = list(zip(at[:-1].tolist(), at[1:].tolist()))
                n = len(lengths)
                columns = [
                    pa.array([r["part"].as_py()] * n, pa.int32()), pa.array([r["group"].as_py()] * n, pa.int32()), r["doc_ids"].values,
                    pa.array(at[:-1]), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in bounds], pa.int64()),
                ]
                names = ["part", "group", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in bounds], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2].cast(arrow), *columns[3:]], names)

    ddl = f"part int, group int, doc_id {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    decoded = files.mapInArrow(run, ddl)
    sizes = files.select("part", "group", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )
    inside = Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.join(parts, "part").select(
        "part", "group", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base")
    )
    out = decoded.join(groups, ["part", "group"]).withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenized(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Write the texts' ids at `path`, by default a new folder in the checkpoint folder, and read them back.

    Null and empty texts have only the end id; repeated rows are documents of their own, each with its own start;
    an empty table gives no rows. Only doc_id and text are read.
    """
    path = path or scratch(docs.sparkSession)
    write_tokens(docs, path, vocabulary, **options)
    return read_tokens(docs.sparkSession, path)
