"""Source, sink, table maintenance and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epochlens.catalogue.registry import query
from epochlens.operators import features
from epochlens.sources import manifests, tables
from epochlens.session import scratch
from epochlens.streaming import jobs


#: Objects in a JSON list. A reader holds a list whole.
LIST_ROWS = 20_000


def _json_lists(df: DataFrame) -> str:
    """Write rows as compressed JSON documents, each a list of bounded size in a file of its own, and return the folder."""
    path = scratch(df.sparkSession)
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def as_lists(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(held):
            values = pa.chunked_array(held, pa.string()).combine_chunks()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), ",")
            return pa.RecordBatch.from_arrays([pc.binary_join_element_wise("[", joined, "]", "")], ["value"])

        held: list[pa.Array] = []
        count, written = 0, False
        for batch in batches:
            while len(batch):
                piece = batch.column("value")[:LIST_ROWS - count]
                held.append(piece)
                count += len(piece)
                batch = batch.slice(len(piece))
                if count == LIST_ROWS:
                    yield one(held)
                    held, count, written = [], 0, True
        if held or not written:
            yield one(held)

    lists = rows.mapInArrow(as_lists, "value string").write.option("maxRecordsPerFile", 1)
    # JSON repeats its keys in every row, so plain documents take many times the room of the table.
    lists.option("compression", "gzip").option("zlib.compress.level", "THREE").text(path)
    return path


def _nested_box(df: DataFrame) -> DataFrame:
    corners = ("min_lon", "min_lat", "max_lon", "max_lat")
    return df.withColumn("bounds_wgs84", F.struct(*corners)).drop(*corners)


@query("a01_read_scenes", """
    SELECT scene_id, sensor, platform, epoch_us(acquisition_time) AS us, CASE WHEN o_custkey % 50 = 0 THEN 'cloud cover outside 0..100' ELSE '' END AS errors, CASE WHEN o_custkey % 50 = 0 THEN 250e0 ELSE cloud_cover_percentage END AS cloud FROM fx_scenes""")
def read_scenes(t):
    rows = t.fx_scenes.withColumns({c: F.lit(v) for c, v in (("min_lon", 70.0), ("min_lat", 10.0), ("max_lon", 71.0), ("max_lat", 11.0))})
    rows = rows.withColumn("cloud_cover_percentage", F.when(F.col("o_custkey") % 50 == 0, 250.0).otherwise(F.col("cloud_cover_percentage")))
    accepted, rejected = manifests.read_scenes(t.spark, _json_lists(_nested_box(rows).drop("o_custkey")))
    both = accepted.withColumn("errors", F.array().cast("array<string>")).unionByName(rejected, allowMissingColumns=True)
    return both.select("scene_id", "sensor", "platform", F.unix_micros("acquisition_time").alias("us"), F.array_join("errors", "; ").alias("errors"), F.col("cloud_cover_percentage").alias("cloud"))


@query("a02_read_tiles", """
    SELECT tile_id, source_scene_id, tile_col, min_lon, sha256_hash, l_extendedprice FROM (SELECT * FROM fx_tiles WHERE l_partkey % 6 <> 0) WHERE valid_pixel_ratio IS NULL OR valid_pixel_ratio BETWEEN 0 AND 1""")
def read_tiles(t):
    rows = t.fx_tiles.withColumn("sha256_hash", F.when(F.col("l_partkey") % 6 != 0, F.col("sha256_hash")).otherwise("short"))
    accepted, _ = manifests.read_tiles(t.spark, _json_lists(_nested_box(rows).withColumn("file_path", F.col("l_extendedprice").cast("string"))))
    return accepted.select("tile_id", "source_scene_id", F.col("tile_col").cast("bigint").alias("tile_col"), "min_lon", "sha256_hash", F.col("file_path").cast("double").alias("l_extendedprice"))


@query("a05_file_inventory")
def inventory(t):
    return manifests.file_inventory(t.spark, t.directory, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "file_hash", "error")



def _files(t):
    """Documents as files: the text is the content, so copies share a hash."""
    return t.table("documents").select(F.sha2("text", 256).alias("file_hash"), F.format_string("%010d", "doc_id").alias("path"), "source", "doc_id")


@query("a06_ingest_new", """
    WITH d AS (SELECT sha256(text) AS file_hash, doc_id, source FROM documents), f AS (SELECT file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY file_hash),
    c AS (SELECT file_hash, min(printf('scene_%010d', doc_id)) AS existing_id FROM d JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY file_hash)
    SELECT file_hash, doc_id, copies, existing_id, existing_id IS NULL AS is_new FROM f LEFT JOIN c USING (file_hash)""")
def ingest_new(t):
    files = _files(t)
    stored = files.join(t.table("labels").where("quality = 1").select("doc_id"), "doc_id").select("file_hash", F.concat(F.lit("scene_"), "path").alias("scene_id"))
    return tables.ingest_new(files, stored).select("file_hash", "doc_id", "copies", "existing_id", "is_new")


@query("a06_ingest_new_provenance", """
    WITH d AS (SELECT sha256(text) AS file_hash, doc_id FROM documents), c AS (SELECT file_hash, min(printf('scene_%010d', doc_id)) AS existing_id FROM d JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY file_hash),
    p AS (SELECT printf('scene_%010d', event_id % 700) AS existing_id, concat('prov_', event_id) AS provenance_id, ts FROM events),
    l AS (SELECT existing_id, arg_max(provenance_id, struct_pack(ts, provenance_id)) AS provenance_id FROM p GROUP BY existing_id)
    SELECT file_hash, existing_id, existing_id IS NULL AS is_new, provenance_id FROM (SELECT DISTINCT file_hash FROM d) LEFT JOIN c USING (file_hash) LEFT JOIN l USING (existing_id)""")
def ingest_new_provenance(t):
    files = _files(t)
    stored = files.join(t.table("labels").where("quality = 1").select("doc_id"), "doc_id").select("file_hash", F.concat(F.lit("scene_"), "path").alias("scene_id"))
    records = t.table("events").select(
        F.format_string("scene_%010d", F.col("event_id") % 700).alias("scene_id"), F.concat(F.lit("prov_"), "event_id").alias("provenance_id"), F.col("ts").alias("executed_at")
    )
    return tables.ingest_new(files, stored, provenance=records).select("file_hash", "existing_id", "is_new", "provenance_id")


@query("a07_get_by_id", "SELECT scene_id, sensor, file_hash FROM fx_scenes WHERE scene_id = 'scene_123'")
def get_by_id(t):
    return tables.get_by_id(t.fx_scenes, "scene_id", "scene_123").select("scene_id", "sensor", "file_hash")


@query("a08_list_ids", "SELECT DISTINCT source_scene_id FROM fx_tiles ORDER BY 1")
def list_ids(t):
    return tables.list_ids(t.fx_tiles, "source_scene_id")


@query("a09_list_scenes", "SELECT scene_id, sensor, platform, epoch_us(created_at) AS created_us FROM fx_scenes ORDER BY created_at DESC, scene_id")
def list_scenes(t):
    return tables.list_scenes(t.fx_scenes).select("scene_id", "sensor", "platform", F.unix_micros("created_at").alias("created_us"))


@query("a10_scene_tiles", "SELECT tile_id, sha256_hash, l_partkey FROM fx_tiles WHERE source_scene_id = 'scene_42'")
def scene_tiles(t):
    return tables.scene_tiles(t.fx_tiles, "scene_42").select("tile_id", "sha256_hash", "l_partkey")


@query("a11_write_artifacts", "SELECT scene_id, platform, CASE WHEN platform = 'Landsat-8' THEN 'second' ELSE 'first' END AS run FROM fx_scenes")
def write_artifacts(t):
    path = scratch(t.spark)
    rows = t.fx_scenes.select("scene_id", "platform")
    tables.write_artifacts(rows.withColumn("run", F.lit("first")), path, ["platform"])
    tables.write_artifacts(rows.where("platform = 'Landsat-8'").withColumn("run", F.lit("second")), path, ["platform"])
    return t.spark.read.schema("scene_id string, run string, platform string").parquet(path)


@query("a12_append_provenance", """
    SELECT 'tiling' AS processing_stage, tile_id AS target_id, source_scene_id FROM fx_tiles UNION ALL SELECT 'ingest', NULL, scene_id FROM fx_scenes""")
def append_provenance(t):
    path = scratch(t.spark)
    none = F.lit(None).cast("string")
    tables.append_provenance(tables.provenance_rows(t.fx_tiles, "tiling", F.col("tile_id"), F.col("source_scene_id"), "tiler"), path)
    tables.append_provenance(tables.provenance_rows(t.fx_scenes, "ingest", none, F.col("scene_id"), "ingest", at=F.col("created_at")), path)
    return t.spark.read.parquet(path).select("processing_stage", "target_id", "source_scene_id")


@query("a13_upsert", """
    WITH u AS (SELECT tile_id, arg_max(l_extendedprice, (l_partkey, l_extendedprice)) AS price FROM fx_tiles WHERE l_partkey % 2 = 0 GROUP BY tile_id),
    b AS (SELECT DISTINCT tile_id FROM fx_tiles)
    SELECT tile_id, coalesce(u.price, -1e0) AS price FROM b LEFT JOIN u USING (tile_id)""")
def upsert(t):
    base = t.fx_tiles.select("tile_id").distinct().withColumn("price", F.lit(-1.0))
    updates = t.fx_tiles.where("l_partkey % 2 = 0").select("tile_id", F.col("l_extendedprice").alias("price"), "l_partkey")
    return tables.upsert(base, updates, ["tile_id"], "l_partkey")


@query("a13_upsert_versions", "SELECT tile_id, max(l_partkey) AS version, arg_max(l_extendedprice, (l_partkey, l_extendedprice)) AS price FROM fx_tiles GROUP BY tile_id")
def upsert_versions(t):
    rows = t.fx_tiles.select("tile_id", F.col("l_partkey").alias("version"), F.col("l_extendedprice").alias("price"))
    return tables.upsert_versions(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["tile_id"], "version")


@query("a14_insert_strict", "SELECT scene_id, platform FROM fx_scenes")
def insert_strict(t):
    rows = t.fx_scenes.select("scene_id", "platform")
    return tables.insert_strict(rows.where("platform = 'Sentinel-2'"), rows.where("platform <> 'Sentinel-2'"), ["scene_id"])


@query("a14_key_collisions", "SELECT tile_id FROM fx_tiles WHERE l_partkey % 2 = 1 GROUP BY tile_id HAVING count(*) > 1 UNION SELECT a.tile_id FROM fx_tiles a JOIN fx_tiles b USING (tile_id) WHERE a.l_partkey % 2 = 1 AND b.l_partkey % 2 = 0")
def key_collisions(t):
    rows = t.fx_tiles.select("tile_id", "l_partkey")
    return tables.key_collisions(rows.where("l_partkey % 2 = 0"), rows.where("l_partkey % 2 = 1"), ["tile_id"])


@query("a15_delete_cascade", """
    SELECT 'tiles' AS stored, tile_id FROM fx_tiles WHERE tile_id NOT IN (SELECT tile_id FROM fx_tiles WHERE l_partkey % 5 = 0) UNION ALL
    SELECT DISTINCT 'embeddings', tile_id FROM fx_tiles WHERE tile_id NOT IN (SELECT tile_id FROM fx_tiles WHERE l_partkey % 5 = 0)""")
def delete_cascade(t):
    rows = t.fx_tiles.select("tile_id", "l_partkey")
    left = tables.delete_cascade({"tiles": rows, "embeddings": rows.select("tile_id").distinct()}, rows.where("l_partkey % 5 = 0"))
    return left["tiles"].select(F.lit("tiles").alias("stored"), "tile_id").unionByName(left["embeddings"].select(F.lit("embeddings").alias("stored"), "tile_id"))


@query("a16_export_json", """
    SELECT concat('{"scene_id":"', scene_id, '","platform":"', platform, '"}') AS json, (SELECT count(*) FROM fx_scenes) AS record_count FROM fx_scenes""")
def export_json(t):
    path = scratch(t.spark)
    rows = t.fx_scenes.select("scene_id", "platform")
    tables.export_json(rows, path)
    head = t.spark.read.schema("record_count bigint").json(f"{path}/header").first()[0]
    back = t.spark.read.schema("scene_id string, platform string").json(f"{path}/records")
    return tables.export_rows(back).withColumn("record_count", F.lit(head))


# Streams: the given tables are read as file streams and run until everything has been taken in.


def _stream(t, table: str) -> DataFrame:
    """A stream's source is a folder: the table itself where it is one, else the folder that holds its file."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.directory}/{table}.parquet")
    source = t.spark.readStream.schema(t.table(table).schema)
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source.parquet(f"{t.directory}/{table}.parquet")
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(t.directory)


@query("p01_stream_ingest_dedup", "SELECT sha256(concat(event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR))) AS file_hash, epoch_us(min(ts)) AS first_us FROM events GROUP BY ALL")
def stream_dedup(t):
    rows = _stream(t, "events").select(F.sha2(F.concat("event_type", F.floor("value").cast("string")), 256).alias("file_hash"), "ts")
    folder = scratch(t.spark)
    jobs.run_once(rows, folder, jobs.ingest_sink(f"{folder}/catalog", "ts"))
    return t.spark.read.parquet(f"{folder}/catalog").select("file_hash", F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"))


@query("p02_stream_refresh_embeddings", "SELECT printf('tile_%d', vec_id) AS tile_id, 512 AS dimension, 'spectral-spatial' AS model_id FROM embeddings")
def stream_refresh(t):
    v = F.col("embedding").cast("array<double>")
    tiles = _stream(t, "embeddings").select(
        F.concat(F.lit("tile_"), "vec_id").alias("tile_id"), F.sha2(F.to_json(F.struct("embedding")), 256).alias("sha256_hash"), F.col("vec_id").alias("arrived"),
        F.lit(4).alias("height"), F.lit(4).alias("width"), F.array(*[F.slice(v, 1 + 16 * b, 16) for b in range(4)]).alias("bands"),
    )
    folder = scratch(t.spark)
    jobs.run_once(tiles, folder, jobs.refresh_sink(f"{folder}/index", "spectral-spatial", "p", features.embedder("spectral-spatial").embed))
    return jobs.index_table(t.spark, f"{folder}/index").read().select("tile_id", F.size("v").alias("dimension"), "model_id")


@query("p03_stream_adjacent_pairs", """
    SELECT series_id, lag(observation_id) OVER w AS earlier_id, observation_id AS later_id FROM fx_observations WINDOW w AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id) QUALIFY lag(observation_id) OVER w IS NOT NULL""")
def stream_pairs(t):
    rows = _stream(t, "events").select(F.concat(F.lit("series_"), "user_id").alias("series_id"), F.concat(F.lit("obs_"), "event_id").alias("observation_id"), F.col("ts").alias("acquisition_time"))
    folder = scratch(t.spark)
    jobs.run_once(rows, folder, jobs.adjacent_sink(folder))
    return jobs.adjacent_table(t.spark, folder).select("series_id", "earlier_id", "later_id")


@query("p04_stream_series_counts", """
    SELECT series_id, epoch_us(date_trunc('day', acquisition_time)) AS day_us, count(*) AS observation_count, epoch_us(min(acquisition_time)) AS earliest, epoch_us(max(acquisition_time)) AS latest
    FROM fx_observations GROUP BY ALL""")
def stream_counts(t):
    rows = _stream(t, "events").select(F.concat(F.lit("series_"), "user_id").alias("series_id"), F.col("ts").alias("acquisition_time"))
    folder = scratch(t.spark)
    jobs.run_once(rows, folder, jobs.counts_sink(f"{folder}/counts"))
    return jobs.counts_table(t.spark, f"{folder}/counts").select(
        "series_id", F.unix_micros("start").alias("day_us"), "observation_count", F.unix_micros("earliest").alias("earliest"), F.unix_micros("latest").alias("latest")
    )


@query("p05_stream_reviews", "SELECT concat('rev_', investigation_id, '_', region_id, '_r', CAST(revision AS VARCHAR)) AS review_id, event_id, decision FROM fx_review_log")
def stream_reviews(t):
    from epochlens.catalogue.views import REVIEWS

    folder = scratch(t.spark)
    jobs.run_once(_stream(t, "events").selectExpr(*[f"{e} AS {a}" for e, a in REVIEWS]), folder, jobs.review_sink(f"{folder}/log"))
    return t.spark.read.parquet(f"{folder}/log").select("review_id", "event_id", "decision")


@query("u01_custom_scorer", "SELECT pair_id, r AS row, c AS col, round(max(abs(l - e)), 9) AS score FROM fx_px GROUP BY ALL")
def custom_scorer(t):
    from epochlens.catalogue import pixels as chain
    from epochlens.operators import pixels

    scored = features.custom_scorer(chain.masked(t), lambda earlier, later: abs(later - earlier).max(axis=0))
    return pixels.score_pixels(scored).select("pair_id", "row", "col", F.round("score", 9).alias("score"))


@query("u02_custom_embedder", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents")
def custom_embedder(t):
    plug = features.custom_embedder("sizes", 2, lambda: (lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts]), "text")
    v = plug.embed(t.table("documents").select("doc_id", "text"))
    return v.select("doc_id", F.get("v", F.lit(0)).cast("double").alias("chars"), F.get("v", F.lit(1)).cast("double").alias("blanks"))


@query("u03_embedder_registry", "SELECT doc_id, 512 AS dimension, 'spectral-spatial,text-concepts' AS available FROM documents")
def registry(t):
    """Every registered embedder with a text input, run over the documents."""
    out = features.embedder("text-concepts").embed(t.table("documents").select("doc_id", "text"))
    available = [e.model_id for e in features.list_embedders(available=True)]
    return out.select("doc_id", F.size("v").alias("dimension"), F.lit(",".join(sorted(available))).alias("available"))
