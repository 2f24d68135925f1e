"""Matches of patterns with their places, as DataFrame expressions only."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochlens.llm.common import starts_of


@dataclass(frozen=True)
class Pattern:
    """A kind of span: a pattern without groups, a test of a matched string, and a string without which it can't match."""

    kind: str
    regex: str
    valid: Callable[[Column], Column] | None = None
    needs: str | None = None


def locate(df: DataFrame, text: str, patterns: list[Pattern], context: int = 0, asked: dict[str, Column] | None = None) -> DataFrame:
    """Add a column for each pattern, named by its kind: array of (start, end, value) of its valid matches.

    Places count code points, the end is exclusive; matches are the leftmost ones that don't overlap. A string is
    split at its matches, so the lengths of the pieces give the places, without a second search. With `context`,
    the array also holds up to so many code points before and after each match, not beyond a neighbouring match.
    `asked` may give a condition for a kind; rows that don't meet it aren't searched for that kind and have no spans of it.
    """
    source = F.col(text)
    found = {}
    for p in patterns:
        matches = F.regexp_extract_all(source, F.lit(f"({p.regex})"), F.lit(1))
        matches = F.when(F.contains(source, F.lit(p.needs)), matches) if p.needs else matches
        found[f"_{p.kind}_matches"] = F.when(asked[p.kind], matches) if asked and p.kind in asked else matches
    df = df.withColumns(found)
    # Only texts with a match are searched a second time.
    df = df.withColumns({f"_{p.kind}_pieces": F.when(F.size(f"_{p.kind}_matches") > 0, F.split(source, p.regex, -1)) for p in patterns})
    steps = {}
    for p in patterns:
        pairs = F.arrays_zip(F.slice(f"_{p.kind}_pieces", 1, F.size(f"_{p.kind}_matches")).alias("piece"), F.col(f"_{p.kind}_matches").alias("match"))
        steps[f"_{p.kind}_steps"] = F.transform(pairs, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("bigint"))
    df = df.withColumns(steps)
    df = df.withColumns({f"_{p.kind}_begins": starts_of(F.col(f"_{p.kind}_steps")) for p in patterns})
    spans = {}
    for p in patterns:
        pieces, matches, begins = (F.col(f"_{p.kind}_{x}") for x in ("pieces", "matches", "begins"))
        n = F.size(matches)
        # All that an element needs stands in it: an outer column inside a lambda would be worked out for every element.
        parts = [matches.alias("match"), begins.alias("begin"), F.slice(pieces, 1, n).alias("piece")]
        parts += [F.slice(pieces, 2, n).alias("next")] if context else []

        def span(x: Column) -> Column:
            start = x["begin"] + F.length(x["piece"])
            fields = [start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("value")]
            if context:
                fields += [F.right(x["piece"], F.lit(context)).alias("before"), F.left(x["next"], F.lit(context)).alias("after")]
            return F.struct(*fields)

        all_spans = F.transform(F.arrays_zip(*parts), span)
        kept = F.filter(all_spans, lambda s: p.valid(s["value"])) if p.valid else all_spans  # noqa: B023
        kind = "array<struct<start: bigint, end: bigint, value: string" + ", before: string, after: string" * bool(context) + ">>"
        spans[p.kind] = F.coalesce(F.when(n > 0, kept), F.array()).cast(kind)
    return df.withColumns(spans).drop(*[f"_{p.kind}_{x}" for p in patterns for x in ("matches", "pieces", "steps", "begins")])


def listed(kinds: list[str]) -> Column:
    """Spans of the columns of `kinds` as one array of (start, place of the kind, kind, end), in order."""
    tagged = [
        F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")))  # noqa: B023
        for i, kind in enumerate(kinds)
    ]
    return F.sort_array(F.concat(*tagged))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed values, without Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * (1 + i % 2)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
