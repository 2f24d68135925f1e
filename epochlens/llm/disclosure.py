"""Personal data, and the terms that give protected entities away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.llm.common import by_row_key, row_key, texts
from epochlens.llm.native import Pattern, digits, joined, listed, locate, luhn
from epochlens.session import cut

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds of personal data, in their order. A run that could start earlier can't start a match, unless a match ends there.
PATTERNS = [
    Pattern("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Pattern("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$"), "."),
    Pattern("card", r"[0-9](?:[ -]?[0-9]){13,}+", lambda m: (F.length(digits(m)) <= 19) & luhn(digits(m))),
    Pattern("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15), "+"),
]
KINDS = [p.kind for p in PATTERNS]
#: What stands for a removed value.
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "cut": ""}
#: Code points on both sides of an entity that make its context.
CONTEXT = 80
_TOKEN = r"\S++"


def entities(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id and, for each kind, the array of its spans with value and context. Null texts count as empty."""
    return locate(texts(docs), "text", PATTERNS, context).drop("text")


def _context_terms(mentions: DataFrame, context: int) -> DataFrame:
    """(_row, entity, spot, term, start, end): words of letters that stand apart, in the context of each mention.

    A word that the context cuts or that touches the mention doesn't count.
    """
    sides = mentions.select(
        "_row", "entity", F.xxhash64("before", "after").alias("spot"),
        F.explode(F.array(
            F.struct(F.col("before").alias("side"), (F.col("start") - F.length("before")).alias("at"), F.lit(True).alias("left")),
            F.struct(F.col("after").alias("side"), F.col("end").alias("at"), F.lit(False).alias("left")),
        )).alias("s"),
    ).select("_row", "entity", "spot", "s.*")
    found = locate(sides, "side", [Pattern("token", _TOKEN)])
    words = found.select("_row", "entity", "spot", "side", "at", "left", F.explode("token").alias("w"))
    length = F.length("side")
    outer = F.when(F.col("left"), (F.col("w.start") == 0) & (length >= context)).otherwise((F.col("w.end") == length) & (length >= context))
    inner = F.when(F.col("left"), F.col("w.end") == length).otherwise(F.col("w.start") == 0)
    letters = F.regexp_extract(F.col("w.value"), r"^\p{P}*(\p{L}{3,})\p{P}*$", 1)
    lead = F.length(F.regexp_extract(F.col("w.value"), r"^(\p{P}*)", 1))
    return words.where(~outer & ~inner).withColumn("letters", letters).where("letters <> ''").select(
        "_row", "entity", "spot", F.lower("letters").alias("term"),
        (F.col("at") + F.col("w.start") + lead).alias("start"), (F.col("at") + F.col("w.start") + lead + F.length("letters")).alias("end"),
    )


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many documents each word of letters stands, over whole texts of all documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\P{L}++"))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def disclosures(
    docs: DataFrame, generalise: float = 0.6, remove: float = 0.9, support: int = 3, context: int = CONTEXT
) -> DataFrame:
    """One row per document: doc_id, an array of spans for each kind, and `term`, spans of disclosing terms with `action`.

    A protected entity is a value found by the base patterns. For a term t in its contexts, the pointwise mutual
    information log2(N n(e,t) / (n(e) n(t))), relative to the entity's information log2(N / n(e)), says how much of the
    entity t gives away: from `generalise` on the term is generalised, from `remove` on it is removed. n(e) and n(e,t)
    count distinct contexts, so that copies of one text are one piece of evidence; n(t) counts all documents (or, if
    they are more, the contexts). A pair seen in fewer than `support` contexts is no evidence.

    Null and empty texts have no spans; repeated rows get a row each; an empty table gives no rows; ids may be null.
    Only doc_id and text are read.
    """
    found = cut(entities(docs, context).withColumn("_row", F.monotonically_increasing_id()))
    each = F.concat(*[
        F.transform(k, lambda s: F.struct(F.concat(F.lit(f"{k}:"), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["before"].alias("before"), s["after"].alias("after")))  # noqa: B023
        for k in KINDS
    ])
    mentions = found.where(F.greatest(*[F.size(k) for k in KINDS]) > 0).select("_row", F.explode(each).alias("m")).select("_row", "m.*")
    near = cut(_context_terms(mentions, context))
    spots = mentions.select("entity", F.xxhash64("before", "after").alias("spot")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = near.select("entity", "term", "spot").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    weighed = pairs.join(spots, "entity").join(document_frequencies(docs), "term")
    n = F.greatest(F.lit(found.count()), "n_e", "df").cast("double")
    information = F.log2(n / F.col("n_e"))
    mutual = F.log2(n * F.col("n_et") / (F.col("n_e") * F.greatest("df", "n_et")))
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    telling = weighed.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    marked = (
        near.join(telling, ["entity", "term"])
        .groupBy("_row", "start", "end").agg(F.max("share").alias("share"))
        .select("_row", F.struct("start", "end", F.when(F.col("share") >= remove, "cut").otherwise("term").alias("action")).alias("s"))
        .groupBy("_row").agg(F.sort_array(F.collect_list("s")).alias("term"))
    )
    empty = F.array().cast("array<struct<start: bigint, end: bigint, action: string>>")
    return found.join(marked, "_row", "left").select("doc_id", *KINDS, F.coalesce("term", empty).alias("term"))


def base_spans() -> Column:
    return listed(KINDS)


def all_spans() -> Column:
    return listed([*KINDS, "term"])


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data and disclosing terms replaced by their labels or removed; other columns as given.

    Where spans overlap, the one that starts first counts, and of those the longest.
    """
    found = disclosures(by_row_key(docs), **options)
    tagged = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(LABELS[k]).alias("label"))) for k in KINDS]  # noqa: B023
    terms = F.transform("term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(s["action"] == "cut", LABELS["cut"]).otherwise(LABELS["term"]).alias("label")))
    spans = found.select(F.col("doc_id").alias("_key"), F.sort_array(F.concat(*tagged, terms)).alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_key"])
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs).alias("_key"), F.col("text").alias("_text"))
    rows = held.join(spans, "_key", "left")
    text = F.col("_text")
    piece = lambda a, start: F.substring(text, (a["end"] + 1).cast("int"), (start - a["end"]).cast("int"))
    build = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["end"], F.struct((-s["back"]).alias("end"), F.concat(a["out"], piece(a, s["start"]), s["label"]).alias("out"))).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(text, (a["end"] + 1).cast("int"), F.length(text))),
    )
    return rows.select(F.col("_row").withField("text", F.when(F.col("_spans").isNull(), text).otherwise(build)).alias("_row")).select("_row.*")
