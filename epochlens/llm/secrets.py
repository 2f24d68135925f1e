"""Secrets in every version of every path, through a ledger of scanned blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochlens.llm.native import Pattern, joined, literal_table, locate
from epochlens.session import cut

_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]++"


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; a blob is scanned again when the version of a rule changes."""

    pattern: Pattern
    version: int = 1


#: The first three are the base kinds, in their order.
RULES = (
    Rule(Pattern("assign", _ASSIGNED + _VALUE, lambda m: F.length(F.regexp_replace(m, "^" + _ASSIGNED, "")) >= 12)),
    Rule(Pattern("access", r"AKIA[A-Z0-9]{14,}+", needs="AKIA")),
    Rule(Pattern("hex", r"[0-9a-f]{16,}+")),
    Rule(Pattern("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="PRIVATE KEY-----")),
    Rule(Pattern("webtoken", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", needs="eyJ")),
)
BASE = ("assign", "access", "hex")
_LEDGER = "blob string, rule string, version int, spans array<struct<start: bigint, end: bigint>>"


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger: a row for each scanned blob and rule version, whether or not it has findings; empty where there is none yet."""
    if path is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.schema(_LEDGER).parquet(path)
    return literal_table(spark, [], _LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger for the blobs of `versions` (blob, text): each blob once, by the rule versions it lacks.

    A blob is chosen by its hash alone; only texts of blobs that lack some rule version are scanned, and only by the
    rules that they lack. Very long texts are scanned whole.
    """
    marks = {r.pattern.kind: f"{r.pattern.kind}@{r.version}" for r in rules}
    wanted = F.array_sort(F.array(*[F.lit(m) for m in marks.values()]))
    done = (
        ledger.withColumn("mark", F.concat_ws("@", "rule", F.col("version").cast("string")))
        .groupBy("blob").agg(F.collect_set("mark").alias("marks"))
    )
    once = versions.groupBy("blob").agg(F.first("text").alias("text"))
    lacking = once.join(done, "blob", "left").withColumn("lacks", F.array_except(wanted, F.coalesce("marks", F.array().cast("array<string>"))))
    todo = lacking.where(F.size("lacks") > 0)
    asked = {kind: F.array_contains("lacks", m) for kind, m in marks.items()}
    located = locate(todo, "text", [r.pattern for r in rules], asked=asked)
    rows = F.array(*[
        F.struct(
            F.lit(r.pattern.kind).alias("rule"), F.lit(r.version).alias("version"),
            F.transform(r.pattern.kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
        )
        for r in rules
    ])
    fresh = F.filter(rows, lambda r: F.array_contains("lacks", F.concat_ws("@", r["rule"], r["version"].cast("string"))))
    return located.select("blob", F.explode(fresh).alias("r")).select("blob", "r.rule", "r.version", "r.spans")


def scan(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version of a path: its columns key and blob, and spans, an array of (start, place, kind, end) in order.

    `versions` has key (what names a version: path and commit, say) and text; a blob is the SHA-256 of the text,
    null as empty. With `ledger_path` new findings are appended there, and later calls scan only blobs and rule
    versions that the ledger lacks; without it everything is new. Findings of a blob go to every version that holds it.
    """
    spark = versions.sparkSession
    blobs = versions.select("key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    known = read_ledger(spark, ledger_path)
    fresh = scan_unseen(blobs.select("blob", "text"), known, rules)
    if ledger_path:
        # The ledger is appended to in one job and read back; what it held before was listed when `known` was made.
        fresh.write.mode("append").parquet(ledger_path)
    else:
        fresh = cut(fresh)
    current = F.create_map(*[x for r in rules for x in (F.lit(r.pattern.kind), F.lit(r.version))])
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.pattern.kind), F.lit(i))])
    # Written first, so that the join below is between plain shuffles and the planner can split a blob of many paths.
    findings = cut(
        (fresh if not ledger_path else read_ledger(spark, ledger_path))
        .where((F.size("spans") > 0) & (current[F.col("rule")] == F.col("version")))
        .dropDuplicates(["blob", "rule", "version"])
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("rule")].alias("place"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("spans"))
        .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<start: bigint, place: int, kind: string, end: bigint>>")
    return blobs.select("key", "blob").join(findings, "blob", "left").select("key", "blob", F.coalesce("spans", empty).alias("spans"))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def document_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, blob, and its spans in order.

    Null texts count as empty; repeated rows get a row each; ids may be null; an empty table gives no rows. Only
    doc_id and text are read.
    """
    return scan(docs.select(F.col("doc_id").alias("key"), "text"), ledger_path, rules).withColumnRenamed("key", "doc_id")


def digest(spans: Column) -> Column:
    """SHA-256 of the base spans' listing."""
    return F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256)
