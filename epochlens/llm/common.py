"""Text helpers shared by the operators: byte-level words inside tasks, and batches of rows in and out of Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.session import tune

#: Words of letters, digits and everything beyond ASCII, as a pattern over text whose A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """Words of `WORD` after lower-casing A-Z; UTF-8 bytes beyond ASCII belong to words."""
    return text.translate(_WORD_BYTES).split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def hash_cache(hash_of: Callable[[bytes], int], most: int = 300_000) -> dict:
    """A dictionary that computes missing values and starts anew when it holds `most` of them."""

    class Cache(dict):
        def __missing__(self, key):
            if len(self) >= most:
                self.clear()
            value = self[key] = hash_of(key)
            return value

    return Cache()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Map Arrow batches to Arrow batches; `make` runs once in each task and returns the function of a batch."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield each(batch)

    return df.mapInArrow(run, schema)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive groups with the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """A list column over flat `values`, one list for each of `lengths`."""
    return pa.ListArray.from_arrays(pa.array(ragged(lengths).astype(np.int32)), values)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text of a table, the text never null; other columns can't clash with an operator's own."""
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def row_key(docs: DataFrame) -> Column:
    """What identifies a document in a filtering stage: its doc_id with a hash of its text, so that null and
    repeated ids are told apart by their texts."""
    return F.struct(docs["doc_id"].alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text"))


def by_row_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row key in place of the doc_id, as input of an operator."""
    return docs.select(row_key(docs).alias("doc_id"), "text")


def where_key(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` whose row key is (`left_semi`) or isn't (`left_anti`) in the column doc_id of `marked`."""
    return docs.join(marked.select(F.col("doc_id").alias("_marked")).distinct(), row_key(docs) == F.col("_marked"), how)


def starts_of(lengths: Column) -> Column:
    """Running sums of an array before each element, without Python.

    The array is cut into blocks of about the square root of its size, so that appending inside a fold costs
    the array's size to the power 1.5 at most.
    """

    def fold(values: Column, element: Callable[[Column, Column], Column], grow: Callable[[Column], Column], kind: str) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.from_json(F.lit("[]"), kind).alias("out"))
        return F.aggregate(
            values, zero,
            lambda a, x: F.struct((a["sum"] + grow(x)).alias("sum"), F.concat(a["out"], F.array(element(a["sum"], x))).alias("out")),
            lambda a: a["out"],
        )

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(lengths) - 1), width), lambda i: F.slice(lengths, i + 1, width)
    )
    total = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + x)
    with_base = fold(
        blocks, lambda at, block: F.struct(at.alias("at"), block.alias("block")), total, "array<struct<at: bigint, block: array<bigint>>>"
    )
    inner = F.transform(
        with_base,
        lambda b: F.aggregate(
            b["block"],
            F.struct(b["at"].alias("sum"), F.from_json(F.lit("[]"), "array<bigint>").alias("out")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
            lambda a: a["out"],
        ),
    )
    return F.flatten(inner)
