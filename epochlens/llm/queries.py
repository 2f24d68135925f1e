"""Registered queries of the operators, and their SQL where SQL can state the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epochlens.llm import centroids, conversations, decontaminate, disclosure, embeddings, html, licenses, lm, mixing, native, secrets, simhash, tokens, toxicity
from epochlens.llm.common import WORD
from epochlens.session import scratch, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Default path of the vocabulary; the operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.disclosures(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in disclosure.KINDS],
        disclosure.digest(disclosure.base_spans()).alias("base_sha256"), native.joined(disclosure.all_spans()).alias("spans"),
    )


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # The ledger is a table in the shared folder: written by the scan, then read back for the findings.
    found = secrets.document_secrets(docs, scratch(spark))
    return found.select(
        "doc_id", *[secrets.counted(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE],
        secrets.digest(F.col("spans")).alias("base_sha256"), native.joined(F.col("spans")).alias("spans"),
    )


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_table(spark, sf_dir, "documents"), vocabulary())


def op4_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_tfidf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = toxicity.toxicity(docs, labels)
    return found.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op7_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lm.held_out(F.col("doc_id"))
    found = lm.scores(_table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_incremental_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_disclosure": op1_disclosure,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_text_blocks": op4_text_blocks,
    "op5_collision_counting": op5_collision_counting,
    "op6_tfidf_toxicity": op6_tfidf_toxicity,
    "op7_pareto_mixture": op7_pareto_mixture,
    "op8_winnowing": op8_winnowing,
    "op9_license_index": op9_license_index,
    "op10_simhash": op10_simhash,
    "op11_maxent": op11_maxent,
    "op12_incremental_distances": op12_incremental_distances,
    "op13_lightest_repair": op13_lightest_repair,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '{WORD}')"

_ASSIGN = """a{i} AS MATERIALIZED (SELECT rid, x, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
          SELECT v.rid, v.x, k.c, CAST(list_sum(list_transform(list_zip(v.x, k.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, k{i} k) GROUP BY rid, x)"""
_MOVE = """n{j} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS m FROM (
          SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
        k{j} AS (SELECT k.c, coalesce(n.m, k.m) AS m FROM k{i} k LEFT JOIN n{j} n ON n.c = k.c)"""
_ROUNDS = ", ".join(f"{_ASSIGN.format(i=i)}, {_MOVE.format(i=i, j=i + 1)}" for i in range(centroids.ROUNDS))

SQL: dict[str, str] = {
    "op5_collision_counting": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
        u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98e0),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op8_winnowing": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        dw AS (SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM win) k ON len(w) >= n)),
        hit AS (SELECT rid, s, n, item_id FROM dw JOIN win USING (win, n)),
        cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
        it AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
          sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)""",
    "op12_incremental_distances": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        k0 AS MATERIALIZED (SELECT c, x AS m FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS c FROM v) WHERE c < {centroids.CLUSTERS}),
        {_ROUNDS}, {_ASSIGN.format(i=centroids.ROUNDS)}
        SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
          CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.m, ',')) AS centroid_sha256
        FROM a{centroids.ROUNDS} a JOIN v ON v.rid = a.rid JOIN k{centroids.ROUNDS} k ON k.c = a.c""",
    "op13_lightest_repair": r"""
        WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]) AS bits FROM conversations),
         dealt AS (SELECT conv_id, turn, role, text,
           xor(4294967295, list_reduce(list_concat([4294967295], flatten(bits)), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 20 AS kind FROM raw),
         changed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE kind <> 0),
         placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
           rtrim(text, E' \t\n\x0b\x0c\r') AS core FROM changed),
         seen AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS i0 FROM placed),
         x AS MATERIALIZED (SELECT conv_id, turn, p, role, text, i, core = '' AS blank, core <> '' AND nth > 1 AS duplicate,
           core <> '' AND nth = 1 AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
           p > 1 AND i0 || i NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
         ins(f, t, cost, letters, rep) AS (VALUES ('-', '-', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
           ('-', 'u', 5, 'I', E'\nuser:'), ('s', 'u', 5, 'I', E'\nuser:'), ('a', 'u', 5, 'I', E'\nuser:'), ('u', 'a', 5, 'I', E'\nassistant:'),
           ('-', 'a', 10, 'II', E'\nuser:\nassistant:'), ('s', 'a', 10, 'II', E'\nuser:\nassistant:'), ('a', 'a', 10, 'II', E'\nuser:\nassistant:'), ('u', 'u', 10, 'II', E'\nassistant:\nuser:')),
         step(f, t) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
         act AS (SELECT f, t, 'K' AS letter FROM step UNION ALL SELECT f, t, 'R' FROM step WHERE t <> 's' UNION ALL SELECT f, f, 'D' FROM (VALUES ('-'), ('s'), ('u'), ('a')) s(f)),
         best AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, '-' AS st, struct_pack(cost := CAST(0 AS BIGINT), audit := '') AS k, '' AS rep FROM (SELECT DISTINCT conv_id FROM conversations)
           UNION ALL
           SELECT conv_id, p + 1, st, min(k), arg_min(rep, k) FROM (
             SELECT b.conv_id, b.p, a.t AS st,
               struct_pack(cost := CAST(b.k.cost + n.cost + CASE a.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN x.truncated AND a.letter <> 'D' THEN 5 ELSE 0 END AS BIGINT), audit := b.k.audit || n.letters || a.letter) AS k,
               b.rep || n.rep || CASE a.letter WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || x.role || ':' || x.text ELSE E'\n' || CASE a.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || x.text END AS rep
             FROM best b JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.p = b.p + 1 JOIN ins n ON n.f = b.st
             JOIN act a ON a.f = n.t AND (a.letter = 'D' OR NOT (x.blank OR x.duplicate)) AND (a.letter <> 'K' OR a.t = x.i)) GROUP BY conv_id, p, st),
         stats AS (SELECT conv_id, max(p) AS p, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM x GROUP BY conv_id),
         ended AS (SELECT b.conv_id, min(struct_pack(cost := CAST(b.k.cost + n.cost AS BIGINT), audit := b.k.audit || n.letters)) AS k,
           arg_min(b.rep || n.rep, struct_pack(cost := CAST(b.k.cost + n.cost AS BIGINT), audit := b.k.audit || n.letters)) AS rep
           FROM best b LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins n ON n.f = b.st
           WHERE b.p = coalesce(s.p, 0) AND n.t IN ('-', 'a') GROUP BY b.conv_id)
        SELECT e.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
          coalesce(s.illegal, 0) AS illegal, e.k.cost AS cost, e.k.audit AS audit, sha256(substr(e.rep, 2)) AS repaired_sha256
        FROM ended e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
