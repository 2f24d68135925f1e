"""Search, ranking and feature queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.catalogue.views import EXTRA_SQL
from epochlens.functions import vectors
from epochlens.operators import features, ranking, search
from epochlens.plans.scoring import topk_batch

WHERE = search.TileFilter(sensor="SENTINEL-2A msi", date_from=datetime(1995, 1, 1), date_to=datetime(1997, 6, 30), aoi=(72.0, 12.0, 80.25, 22.5))
WHERE_SQL = "lower(sensor) = 'sentinel-2a msi' AND acquisition_time >= TIMESTAMP '1995-01-01' AND acquisition_time <= TIMESTAMP '1997-06-30' AND min_lon <= 80.25e0 AND max_lon >= 72 AND min_lat <= 22.5e0 AND max_lat >= 12"
PROBE = [((i * 37) % 64 - 31.5) / 64.0 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x!r}e0" for x in PROBE) + "]"


def index(t):
    return t.fx_vectors.select(F.format_string("tile_%06d", "vec_id").alias("tile_id"), "v", "label", "vec_id")


EXTRA_SQL["fx_index"] = "SELECT printf('tile_%06d', vec_id) AS tile_id, v, label, vec_id FROM fx_vectors"
EXTRA_SQL["fx_index_tiles"] = "SELECT printf('tile_%06d', vec_id) AS tile_id, concat('scene_', CAST(vec_id % 20 AS VARCHAR)) AS source_scene_id, CASE vec_id % 3 WHEN 0 THEN 'Sentinel-2A MSI' ELSE 'Landsat-8 OLI/TIRS' END AS sensor FROM embeddings WHERE label <> 9"
EXTRA_SQL["fx_index_records"] = "SELECT printf('tile_%06d', vec_id) AS tile_id, CASE WHEN vec_id % 4 = 0 THEN 'other' ELSE 'spectral-spatial' END AS model_id FROM embeddings WHERE label <> 8"


def tiles(t):
    """Tile metadata; the tiles of one class have none."""
    return index(t).where("label <> 9").select(
        "tile_id", F.concat(F.lit("scene_"), F.col("vec_id") % 20).alias("source_scene_id"),
        F.when(F.col("vec_id") % 3 == 0, "Sentinel-2A MSI").otherwise("Landsat-8 OLI/TIRS").alias("sensor"),
    )


def records(t):
    return index(t).where("label <> 8").select("tile_id", F.when(F.col("vec_id") % 4 == 0, "other").otherwise("spectral-spatial").alias("model_id"))


@query("c01_filter_tiles", f"SELECT tile_id, sha256_hash, source_scene_id FROM fx_tiles WHERE {WHERE_SQL}")
def filter_tiles(t):
    return search.filter_tiles(t.fx_tiles, WHERE).select("tile_id", "sha256_hash", "source_scene_id")


@query("c02_aoi_intersects", "SELECT tile_id, l_partkey FROM fx_tiles WHERE min_lon <= 75 AND max_lon >= 71.25e0 AND min_lat <= 15 AND max_lat >= 11.25e0")
def aoi(t):
    return t.fx_tiles.where(search.aoi_intersects((71.25, 11.25, 75.0, 15.0))).select("tile_id", "l_partkey")


@query("c08_stale_embeddings", """
    SELECT scene_id AS tile_id, CASE WHEN o_custkey % 4 = 0 THEN 'new' WHEN o_custkey % 4 = 1 OR o_custkey % 7 = 0 THEN 'replaced' ELSE 'skipped' END AS state FROM fx_scenes""")
def stale(t):
    rows = t.fx_scenes.select(F.col("scene_id").alias("tile_id"), F.col("file_hash").alias("sha256_hash"), "o_custkey")
    key = F.col("o_custkey")
    known = rows.where(key % 4 != 0).select(
        "tile_id", F.when(key % 4 == 1, "old").otherwise(F.col("sha256_hash")).alias("source_hash"), F.when(key % 7 == 0, "m1").otherwise("m2").alias("model_id"), F.lit("p").alias("preprocessing")
    )
    return search.stale_embeddings(rows, known, "m2", "p").select("tile_id", "state")


@query("n01_l2_normalize", "SELECT vec_id, pos, round(x, 9) AS x FROM (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS x FROM fx_vectors)")
def normalize(t):
    return t.fx_vectors.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("pos", "x")).withColumn("x", F.round("x", 9))


@query("n02_cosine", f"SELECT vec_id, round(list_cosine_similarity(v, {PROBE_SQL}), 9) AS cosine FROM fx_vectors")
def cosine(t):
    return t.fx_vectors.select("vec_id", F.round(vectors.cosine(F.col("v"), F.array(*[F.lit(x) for x in PROBE]), clip=True), 9).alias("cosine"))


@query("n03_check_dimension", "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'expected 64 values, got 60' END AS error FROM embeddings")
def dimension(t):
    v = F.when(F.col("vec_id") % 6 == 0, F.slice("v", 1, 60)).otherwise(F.col("v"))
    return search.check_dimension(t.fx_vectors.withColumn("v", v), 64).select("vec_id", "error")


@query("g03_topk", f"SELECT tile_id, round(list_cosine_similarity(v, {PROBE_SQL}), 6) AS score FROM fx_index ORDER BY score DESC, tile_id LIMIT 10")
def topk(t):
    return search.topk(index(t), PROBE, 10)


TOPK_SQL = """
    WITH s AS (SELECT q.vec_id AS query_id, g.vec_id AS gallery_id, round(list_cosine_similarity(q.v, g.v), 6) AS score FROM fx_vectors q JOIN fx_vectors g ON q.vec_id <> g.vec_id)
    SELECT query_id, gallery_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gallery_id) AS rank FROM s) WHERE rank <= 10"""


def _sides(t):
    rows = t.fx_vectors
    return rows.select(F.col("vec_id").alias("query_id"), "label", "v"), rows.select(F.col("vec_id").alias("gallery_id"), "label", "v")


@query("g04_topk_batch", TOPK_SQL)
def topk_many(t):
    return topk_batch(*_sides(t), 10, exclude_self=True)


@query("g04_topk_batch_partitioned", TOPK_SQL)
def topk_partitioned(t):
    return topk_batch(*_sides(t), 10, exclude_self=True, blocks_of=(200, 170))


@query("d11_candidates_semi", "SELECT vec_id FROM fx_index WHERE tile_id IN (SELECT tile_id FROM fx_index_tiles WHERE lower(sensor) = 'sentinel-2a msi')")
def semi(t):
    allowed = search.filter_tiles(tiles(t), search.TileFilter(sensor="Sentinel-2A MSI"))
    return search.candidates_semi(index(t), allowed).select("vec_id")


@query("d12_exclude_self", "SELECT a.tile_id AS query_id, b.tile_id FROM fx_index a JOIN fx_index b ON b.vec_id IN (a.vec_id, a.vec_id + 1) WHERE a.tile_id <> b.tile_id")
def without_self(t):
    rows = index(t).select("tile_id", "vec_id")
    hits = rows.select(F.col("tile_id").alias("query_id"), F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1)).alias("vec_id")).join(rows, "vec_id")
    return search.exclude_self(hits).select("query_id", "tile_id")


@query("h02_ids_except", "SELECT tile_id FROM fx_index WHERE tile_id NOT IN (SELECT tile_id FROM fx_index_tiles)")
def ids_except(t):
    return search.ids_except(index(t), tiles(t))


@query("d10_enrich_hits", """
    SELECT i.tile_id, t.source_scene_id, t.sensor, r.model_id FROM fx_index i JOIN fx_index_tiles t USING (tile_id) LEFT JOIN fx_index_records r USING (tile_id)""")
def enrich(t):
    return search.enrich_hits(index(t).select("tile_id"), tiles(t), records(t))


@query("n08_search_by_vector", f"""
    WITH s AS (SELECT i.tile_id, t.source_scene_id, t.sensor, r.model_id, round(list_cosine_similarity(v, {PROBE_SQL}), 6) AS sc FROM fx_index i JOIN fx_index_tiles t USING (tile_id) LEFT JOIN fx_index_records r USING (tile_id) WHERE lower(sensor) = 'landsat-8 oli/tirs' )
    SELECT tile_id, source_scene_id, sensor, model_id, round(sc, 4) AS score, row_number() OVER (ORDER BY sc DESC, tile_id) AS rank FROM s ORDER BY sc DESC, tile_id LIMIT 25""")
def by_vector(t):
    return search.search_by_vector(index(t), tiles(t), records(t), PROBE, 25, search.TileFilter(sensor="Landsat-8 OLI/TIRS"))


@query("n09_search_by_id", """
    WITH s AS (SELECT q.tile_id AS query_id, g.tile_id, round(list_cosine_similarity(q.v, g.v), 6) AS score FROM fx_index q JOIN fx_index g ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM s)
    SELECT query_id, tile_id, score, rank, NULL AS error FROM r WHERE rank <= 5 UNION ALL SELECT concat('missing_', tile_id), NULL, NULL, NULL, 'unknown tile id' FROM fx_index""")
def by_id(t):
    known = index(t).select("tile_id")
    asked = known.unionByName(known.select(F.concat(F.lit("missing_"), "tile_id").alias("tile_id")))
    hits, missing = search.search_by_id(index(t), asked, 5)
    return hits.unionByName(missing.withColumnRenamed("tile_id", "query_id"), allowMissingColumns=True).select("query_id", "tile_id", "score", "rank", "error")


@query("n10_search_counts", """
    SELECT (SELECT count(*) FROM fx_index) AS indexed, count(*) AS filtered, count(*) AS scored, least(count(*), 25) AS returned FROM fx_index_tiles WHERE sensor = 'Landsat-8 OLI/TIRS'""")
def counts(t):
    return search.search_counts(index(t), tiles(t), 25, search.TileFilter(sensor="landsat-8 oli/tirs"))


METRICS_SQL = """
    WITH s AS (SELECT q.vec_id AS query_id, g.vec_id AS gallery_id, q.label = g.label AS rel, round(list_cosine_similarity(q.v, g.v), 9) AS sim FROM fx_vectors q JOIN fx_vectors g ON q.vec_id <> g.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, gallery_id) AS rank FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rr FROM r WHERE rel),
    q AS (SELECT query_id, min(rank) AS first, avg(rr / rank) AS ap FROM p GROUP BY query_id)
    SELECT count(*) AS queries, round(avg(if(first <= 1, 1e0, 0e0)), 4) AS top_1, round(avg(if(first <= 3, 1e0, 0e0)), 4) AS top_3, round(avg(if(first <= 5, 1e0, 0e0)), 4) AS top_5, round(avg(1e0 / first), 4) AS mrr, round(avg(ap), 4) AS map FROM q"""


@query("n11_retrieval_metrics", METRICS_SQL)
def metrics(t):
    return ranking.retrieval_metrics(*_sides(t), exclude_self=True)


@query("n11_retrieval_metrics_partitioned", METRICS_SQL)
def metrics_partitioned(t):
    return ranking.retrieval_metrics(*_sides(t), exclude_self=True, blocks_of=(200, 170))


@query("n12_class_separation", """
    WITH s AS (SELECT q.label = g.label AS rel, list_cosine_similarity(q.v, g.v) AS sim FROM fx_vectors q JOIN fx_vectors g ON q.vec_id <> g.vec_id),
    m AS (SELECT round(avg(sim) FILTER (rel), 4) AS intra, round(avg(sim) FILTER (NOT rel), 4) AS inter FROM s)
    SELECT intra, inter, CASE WHEN inter > 0 THEN round(intra / inter, 4) ELSE 1e0 END AS separation_ratio FROM m""")
def separation(t):
    return ranking.class_separation(*_sides(t), exclude_self=True)


@query("n13_cross_modal_metrics")
def cross_modal(t):
    texts = features.embedder("text-concepts").embed(t.table("benchmark")).select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).cast("int").alias("label"), "v")
    images = features.embedder("spectral-spatial").embed(t.fx_rasters).select("obs_id", "v").join(
        t.table("embeddings").select(F.col("vec_id").alias("obs_id"), "label"), "obs_id"
    )
    return ranking.retrieval_metrics(texts, images.withColumnRenamed("obs_id", "gallery_id"))


@query("n14_compare_models", """
    SELECT m AS model_id, r.* EXCLUDE (event_type), r.runs IS NOT NULL AS executed FROM (SELECT DISTINCT event_type AS m FROM events UNION ALL SELECT 'not-staged') x LEFT JOIN
      (SELECT event_type, count(*) AS runs, round(avg(if(event_id % 3 = 0, 1e0, 0e0)), 4) AS top_1, round(avg(1e0 / (1 + event_id % 5)), 4) AS mrr, round(avg(value), 2) AS latency_ms FROM events GROUP BY event_type) r ON r.event_type = m""")
def compare(t):
    runs = t.table("events").select(
        F.col("event_type").alias("model_id"), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("top_1"), (1.0 / (1 + F.col("event_id") % 5)).alias("mrr"), F.col("value").alias("latency_ms")
    )
    models = runs.select("model_id").distinct().unionByName(t.spark.createDataFrame([("not-staged",)], "model_id string"))
    return ranking.compare_models(models, runs)


@query("n04_spectral_spatial_features", """
    WITH px AS (SELECT pair_num * 2 + epoch AS vec_id, band, r, c, value FROM fx_pixels),
    m AS (SELECT vec_id, band, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL),
    k AS (SELECT vec_id, band, avg(((value - mean) / (std + 1e-6)) ** 3) AS skew FROM px JOIN m USING (vec_id, band) GROUP BY ALL),
    s AS (SELECT vec_id, sum(mean ** 2 + std ** 2 + lo ** 2 + hi ** 2 + skew ** 2) AS squares, max(mean) FILTER (band = 0) AS m0, max(std) FILTER (band = 3) AS s3, max(skew) FILTER (band = 1) AS k1 FROM m JOIN k USING (vec_id, band) GROUP BY vec_id),
    g AS (SELECT a.vec_id, sqrt((x.value - a.value) ** 2 + (y.value - a.value) ** 2) AS slope FROM px a JOIN px x ON x.vec_id = a.vec_id AND x.band = 0 AND x.r = a.r AND x.c = a.c + 1 JOIN px y ON y.vec_id = a.vec_id AND y.band = 0 AND y.r = a.r + 1 AND y.c = a.c WHERE a.band = 0),
    h AS (SELECT vec_id, avg(slope) AS gm, stddev_pop(slope) AS gs, max(slope) AS gx FROM g GROUP BY vec_id),
    f AS (SELECT vec_id, avg(if(slope > gm + gs, 1e0, 0e0)) AS gf, any_value(gm) AS gm, any_value(gs) AS gs, any_value(gx) AS gx FROM g JOIN h USING (vec_id) GROUP BY vec_id),
    b AS (SELECT a.vec_id, avg((b.value - a.value) / (b.value + a.value + 1e-6)) AS ratio FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = b.c AND a.band = 0 AND b.band = 1 GROUP BY a.vec_id),
    n AS (SELECT *, sqrt(squares + gm ** 2 + gs ** 2 + gx ** 2 + gf ** 2 + ratio ** 2 + (SELECT sum(sin(i) ** 2) FROM range(45, 64) t(i))) AS len FROM s JOIN f USING (vec_id) JOIN b USING (vec_id))
    SELECT vec_id, round(m0 / len, 7) AS mean_0, round(s3 / len, 7) AS std_3, round(k1 / len, 7) AS skew_1, round(gm / len, 7) AS slope_mean, round(gf / len, 7) AS slope_share, round(ratio / len, 7) AS ratio, round(sin(63) / len, 7) AS tail FROM n""")
def tile_features(t):
    v = features.spectral_spatial_features()("bands", "height", "width")
    picks = {"mean_0": 0, "std_3": 16, "skew_1": 9, "slope_mean": 40, "slope_share": 43, "ratio": 44, "tail": 63}
    return t.fx_rasters.select(F.col("obs_id").alias("vec_id"), v.alias("v")).select("vec_id", *[F.round(F.get("v", F.lit(i)), 7).alias(n) for n, i in picks.items()])


@query("n05_project")
def projected(t):
    return t.fx_vectors.select("vec_id", F.transform(features.project()("v"), lambda x: F.round(x, 7)).alias("v"))


@query("n05_project_cosines", f"SELECT vec_id, round(list_cosine_similarity(v, {PROBE_SQL}), 6) AS cosine FROM fx_vectors")
def projected_cosines(t):
    """The rows of the projection are orthonormal, so projected vectors have the cosines of the vectors themselves."""
    project = features.project()
    probe = F.array(*[F.lit(x) for x in PROBE])
    both = t.fx_vectors.select("vec_id", project("v").alias("a"), project(probe).alias("b"))
    return both.select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("n06_text_concepts", """
    WITH d AS (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' Water lake' WHEN 1 THEN ' forest-trees urban' ELSE '' END) AS text FROM documents),
    h AS (SELECT doc_id, list_transform(range(0, 32), lambda i: CAST(('0x' || substring(sha256(text), CAST(2 * i + 1 AS BIGINT), 2)) AS INT) / 255e0) AS b FROM d),
    v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [1.8e0, 0.2e0, 0.1e0, 0.1e0, 0.2e0, 0.1e0] WHEN 1 THEN [1e0, 2e0, 0.3e0, 1.3e0, 1.1e0, 1.9e0] ELSE b END AS v FROM h)
    SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 7) AS a, round(v[6] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 7) AS b FROM v""")
def concepts(t):
    key = F.col("doc_id") % 4
    text = F.concat("text", F.when(key == 0, " Water lake").when(key == 1, " forest-trees urban").otherwise(""))
    v = features.text_concepts(text)
    return t.table("documents").select("doc_id", v.alias("v")).select("doc_id", F.round(F.get("v", F.lit(0)), 7).alias("a"), F.round(F.get("v", F.lit(5)), 7).alias("b"))


@query("n07_refresh_embeddings", """
    SELECT 'counts' AS what, CAST(count(*) FILTER (vec_id % 3 = 0) AS BIGINT) AS new, CAST(count(*) FILTER (vec_id % 3 = 1) AS BIGINT) AS replaced, CAST(count(*) FILTER (vec_id % 3 = 2) AS BIGINT) AS skipped FROM embeddings
    UNION ALL SELECT 'index', count(*), CAST(count(*) FILTER (vec_id % 3 <> 2) AS BIGINT), CAST(count(*) FILTER (vec_id % 3 = 2) AS BIGINT) FROM embeddings""")
def refresh(t):
    key = F.col("obs_id") % 3
    tile = t.fx_rasters.withColumn("tile_id", F.concat(F.lit("tile_"), F.col("obs_id"))).withColumn("sha256_hash", F.sha2("tile_id", 256))
    known = tile.where(key != 0).select(
        "tile_id", F.col("sha256_hash").alias("source_hash"), F.when(key == 1, "older").otherwise("spectral-spatial").alias("model_id"), F.lit("p").alias("preprocessing")
    )
    stored = tile.where(key != 0).select("tile_id", F.array(F.lit(0.0)).alias("v"))
    new_index, _, counts = features.refresh_embeddings(tile, known, stored, "spectral-spatial", "p")
    summary = new_index.agg(F.count(F.lit(1)).alias("new"), F.count_if(F.size("v") == 512).alias("replaced"), F.count_if(F.size("v") == 1).alias("skipped"))
    return counts.select(F.lit("counts").alias("what"), "new", "replaced", "skipped").unionByName(summary.select(F.lit("index").alias("what"), "*"))
