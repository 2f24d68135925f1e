"""Pixel chain queries over the vector table read as small rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.config import DetectionConfig
from epochlens.operators import pixels
from epochlens.session import cut

CONFIG = DetectionConfig(nodata=-99.0, std_multiplier=0.5, min_region_area=2)


def aligned(t):
    return pixels.select_bands(pixels.align(t.fx_raster_pairs, t.fx_rasters), None)


def masked(t):
    return cut(pixels.valid_mask(aligned(t), CONFIG))


def scored(t):
    return pixels.score_map(masked(t), CONFIG)


def detection(t):
    return pixels.detect(t.fx_raster_pairs, t.fx_rasters, CONFIG, 4)


def members(t):
    return detection(t).members


@query("a04_read_raster_table", "SELECT vec_id, band, r AS row, c AS col, value FROM (SELECT pair_num * 2 + epoch AS vec_id, * FROM fx_pixels)")
def raster_table(t):
    return pixels.explode_raster(t.fx_rasters, "obs_id").withColumnRenamed("obs_id", "vec_id")


@query("a04_channel_order", """
    SELECT vec_id, CAST(floor(pos / 16) AS INT) AS band, CAST(pos % 16 AS INT) AS pos, v AS value FROM (
      SELECT vec_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0
        THEN list_concat(list_concat(list_transform(generate_series(0, 15), lambda i: v[i * 4 + 1]), list_transform(generate_series(0, 15), lambda i: v[i * 4 + 2])),
             list_concat(list_transform(generate_series(0, 15), lambda i: v[i * 4 + 3]), list_transform(generate_series(0, 15), lambda i: v[i * 4 + 4]))) ELSE v END AS x FROM fx_vectors))""")
def channel_order(t):
    bands = pixels.to_band_arrays(F.col("v"), F.lit(4), F.lit(4), F.lit(4), F.col("vec_id") % 2 == 0)
    return t.fx_vectors.select("vec_id", F.posexplode(bands).alias("band", "x")).select("vec_id", "band", F.posexplode("x").alias("pos", "value"))


@query("d05_pixels_aligned", "SELECT pair_id, band, r AS row, c AS col, e, l FROM fx_px")
def pixels_aligned(t):
    both = aligned(t).withColumn(
        "bands", F.zip_with("earlier", "later", lambda e, l: F.zip_with(e, l, lambda x, y: F.struct(x.alias("e"), y.alias("l"))))
    )
    return pixels.explode_raster(both, "pair_id").select("pair_id", "band", "row", "col", "value.e", "value.l")


@query("i01_tile_grid", """
    SELECT vec_id, CAST(floor(r / 3) AS BIGINT) AS tile_row, CAST(floor(c / 3) AS BIGINT) AS tile_col, count(*) AS pixels, max(c) - min(c) + 1 AS width, max(r) - min(r) + 1 AS height, round(sum(value), 9) AS total, CAST(9 AS BIGINT) AS padded
    FROM fx_grid8 GROUP BY ALL""")
def tile_grid(t):
    return padded_tiles(t).select(
        "vec_id", "tile_row", "tile_col", "pixels", "width", "height",
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 9).alias("total"), F.size("values").cast("bigint").alias("padded"),
    )


def padded_tiles(t):
    px = t.fx_grid8.select("vec_id", F.lit(0).alias("band"), F.col("r").alias("row"), F.col("c").alias("col"), "value")
    return pixels.pad_tiles(pixels.tile_grid(px, 3), "vec_id", 3)


@query("i02_tile_bounds", """
    SELECT vec_id, tr AS tile_row, tc AS tile_col, round(70e0 + vec_id % 10 + tc * 3 * 0.01e0, 6) AS min_lon, round(20e0 - tr * 3 * 0.01e0 - least(3, 8 - tr * 3) * 0.01e0, 6) AS min_lat,
      round(70e0 + vec_id % 10 + tc * 3 * 0.01e0 + least(3, 8 - tc * 3) * 0.01e0, 6) AS max_lon, round(20e0 - tr * 3 * 0.01e0, 6) AS max_lat
    FROM embeddings, range(0, 3) a(tr), range(0, 3) b(tc)""")
def tile_bounds(t):
    from epochlens.functions import geo

    b = geo.tile_bounds(
        F.lit(70.0) + F.col("vec_id") % 10, F.lit(20.0), F.lit(0.01), F.lit(-0.01), F.col("tile_col") * 3, F.col("tile_row") * 3, F.col("width"), F.col("height")
    )
    return padded_tiles(t).select("vec_id", "tile_row", "tile_col", b.alias("b")).select("vec_id", "tile_row", "tile_col", "b.*")


@query("i03_tile_hash")
def tile_hash(t):
    return pixels.tile_hash(padded_tiles(t), "vec_id")


@query("i03_tile_hash_bytes", """
    WITH b AS (SELECT vec_id, r, c, floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255e0) AS byte FROM fx_grid8 WINDOW w AS (PARTITION BY vec_id)),
    p AS (SELECT g.vec_id, CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, pos, coalesce(byte, 0e0) AS byte
      FROM (SELECT vec_id, tr, tc, pos FROM embeddings, range(0, 3) x(tr), range(0, 3) y(tc), range(0, 9) z(pos)) g
      LEFT JOIN b ON b.vec_id = g.vec_id AND b.r = tr * 3 + pos // 3 AND b.c = tc * 3 + pos % 3)
    SELECT vec_id, tile_row, tile_col, sha256(string_agg(CAST(byte AS VARCHAR), ',' ORDER BY pos)) AS sha256_hash FROM p GROUP BY ALL""")
def tile_hash_bytes(t):
    """Hash of tiles of whole numbers, whose text is the same in any engine."""
    px = t.fx_grid8.select("vec_id", F.col("r").alias("row"), F.col("c").alias("col"), "value")
    whole = pixels.rescale_8bit(px, "vec_id").select("vec_id", F.lit(0).alias("band"), "row", "col", F.col("byte").cast("double").alias("value"))
    return pixels.tile_hash(pixels.pad_tiles(pixels.tile_grid(whole, 3), "vec_id", 3), "vec_id")


@query("i04_rescale_8bit", """
    SELECT vec_id, r AS row, c AS col, CAST(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255e0) AS INT) AS byte FROM fx_grid8 WINDOW w AS (PARTITION BY vec_id)""")
def rescale(t):
    bands = F.array(F.col("embedding").cast("array<double>"))
    whole = t.table("embeddings").select("vec_id", F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.lit(8).alias("height"), F.lit(8).alias("width"), bands.alias("bands"))
    bytes_ = pixels.explode_raster(pixels.rescale_blocks(whole, "vec_id"), "vec_id")
    return bytes_.select("vec_id", "row", "col", F.col("value").alias("byte"))


@query("e13_tile_nodata", """
    SELECT vec_id, CAST(floor(r / 2) AS BIGINT) AS tile_row, CAST(floor(c / 2) AS BIGINT) AS tile_col, CAST(count(*) FILTER (abs(value + 99) <= 1e-8 + 1e-5 * 99) AS BIGINT) AS nodata_pixels,
      round(1e0 - count(*) FILTER (abs(value + 99) <= 1e-8 + 1e-5 * 99) / count(*), 4) AS valid_pixel_ratio
    FROM (SELECT pair_num * 2 + epoch AS vec_id, * FROM fx_pixels) WHERE band = 0 GROUP BY ALL""")
def nodata(t):
    return pixels.nodata_of_blocks(t.fx_rasters.withColumnRenamed("obs_id", "vec_id"), "vec_id", 2, -99.0)


@query("i05_select_bands", "SELECT pair_id, r AS row, c AS col, CASE band WHEN 3 THEN 0 ELSE 1 END AS band, e AS value FROM fx_px WHERE band IN (1, 3)")
def select_bands(t):
    picked = pixels.select_bands(pixels.align(t.fx_raster_pairs, t.fx_rasters), (3, 1))
    return pixels.explode_raster(picked.where("error IS NULL").withColumnRenamed("earlier", "bands"), "pair_id")


@query("i06_valid_mask", "SELECT pair_id, r AS row, c AS col, valid FROM fx_valid")
def valid(t):
    shaped = masked(t).withColumn("scores", F.transform("valid", lambda v: F.lit(0.0)))
    return pixels.score_pixels(shaped).select("pair_id", "row", "col", "valid")


@query("e12_robust_percentiles", """
    SELECT pair_id, 0 AS epoch, band, round(el, 9) AS low, round(eh, 9) AS high FROM fx_range UNION ALL SELECT pair_id, 1, band, round(ll, 9), round(lh, 9) FROM fx_range""")
def robust_percentiles(t):
    return pixels.band_ranges(masked(t), CONFIG).select("pair_id", "epoch", "band", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("i07_normalize", """
    SELECT pair_id, band, r AS row, c AS col, round(CASE WHEN valid AND eh > el THEN least(1e0, greatest(0e0, (e - el) / (eh - el))) ELSE 0e0 END, 9) AS norm_earlier,
      round(CASE WHEN valid AND hi > lo THEN (e - lo) / (hi - lo) ELSE 0e0 END, 9) AS minmax_earlier, round(CASE WHEN valid THEN least(1e0, greatest(0e0, e)) ELSE 0e0 END, 9) AS none_earlier
    FROM fx_px JOIN fx_valid USING (pair_id, r, c) JOIN fx_range USING (pair_id, band)
      JOIN (SELECT pair_id, band, min(e) AS lo, max(e) AS hi FROM fx_px JOIN fx_valid USING (pair_id, r, c) WHERE valid GROUP BY ALL) USING (pair_id, band)""")
def normalize(t):
    blocks = masked(t)
    out = None
    for name in ("robust_percentile", "min_max", "none"):
        config = DetectionConfig(nodata=-99.0, normalization=name)
        ranged = pixels.with_ranges(blocks, config)
        rows = ranged.select("pair_id", "row0", "col0", "width", "valid", "low_0", "high_0", F.posexplode("earlier").alias("band", "x")).select(
            "pair_id", "row0", "col0", "width", "band", F.get("low_0", F.col("band")).alias("low"), F.get("high_0", F.col("band")).alias("high"),
            F.posexplode(F.zip_with("x", "valid", lambda v, ok: F.when(ok, v))).alias("_pos", "v"),
        )
        value = F.round(F.coalesce(F.when(F.col("v").isNotNull(), pixels.normalized(F.col("v"), F.col("low"), F.col("high"), config)), F.lit(0.0)), 9)
        label = {"robust_percentile": "norm_earlier", "min_max": "minmax_earlier", "none": "none_earlier"}[name]
        rows = rows.select("pair_id", "band", *pixels._position(), value.alias(label))
        out = rows if out is None else out.join(rows, ["pair_id", "band", "row", "col"])
    return out


@query("i08_score_map", "SELECT pair_id, r AS row, c AS col, valid, round(score, 9) AS score FROM fx_score")
def score_map(t):
    return pixels.score_pixels(scored(t)).withColumn("score", F.round("score", 9))


@query("i09_threshold", """
    SELECT pair_id, CASE WHEN max(score) > 0 THEN 0.2e0 END AS fixed, round(max(t.threshold), 9) AS statistical, round(CASE WHEN max(score) > 0 THEN quantile_cont(score, 0.95) END, 9) AS percentile
    FROM fx_score JOIN fx_threshold t USING (pair_id) WHERE valid GROUP BY pair_id""")
def threshold(t):
    scores = scored(t)
    out = pixels.threshold(scores, DetectionConfig(threshold_method="fixed")).withColumnRenamed("threshold", "fixed")
    for config in (CONFIG, DetectionConfig(threshold_method="percentile")):
        one = pixels.threshold(scores, config).select("pair_id", F.round("threshold", 9).alias(config.threshold_method))
        out = out.join(one, "pair_id")
    return out


@query("i10_change_pixels", "SELECT pair_id, r AS row, c AS col, round(score, 9) AS score FROM fx_changed")
def change_pixels(t):
    scores = scored(t)
    return pixels.change_pixels(scores, pixels.threshold(scores, CONFIG)).withColumn("score", F.round("score", 9))


@query("i11_label_regions", """
    WITH RECURSIVE p AS (SELECT vec_id, r, c FROM fx_grid8 WHERE value > 0.1e0),
    reach AS (SELECT vec_id, r, c, r * 4294967296 + c AS seed FROM p UNION SELECT p.vec_id, p.r, p.c, q.seed FROM reach q JOIN p ON p.vec_id = q.vec_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1)
    SELECT vec_id AS pair_id, r AS row, c AS col, min(seed) AS label FROM reach GROUP BY ALL""")
def label_regions(t):
    px = t.fx_grid8.where("value > 0.1").select(F.col("vec_id").alias("pair_id"), F.col("r").alias("row"), F.col("c").alias("col"))
    return pixels.label_regions(px, DetectionConfig(min_region_area=1)).select("pair_id", "row", "col", "label")


@query("i11_label_regions_across_blocks", """
    WITH RECURSIVE p AS (SELECT vec_id, r, c FROM fx_grid8 WHERE value > 0.05e0),
    reach AS (SELECT vec_id, r, c, r * 4294967296 + c AS seed FROM p UNION SELECT p.vec_id, p.r, p.c, q.seed FROM reach q JOIN p ON p.vec_id = q.vec_id AND abs(p.r - q.r) + abs(p.c - q.c) = 1),
    l AS (SELECT vec_id AS pair_id, r AS row, c AS col, min(seed) AS label FROM reach GROUP BY ALL)
    SELECT pair_id, row, col, label FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, label) AS n FROM l) WHERE n >= 3""")
def label_across(t):
    px = t.fx_grid8.where("value > 0.05").select(F.col("vec_id").alias("pair_id"), F.col("r").alias("row"), F.col("c").alias("col"))
    return pixels.label_regions(px, DetectionConfig(min_region_area=3, connectivity=4), block=3).select("pair_id", "row", "col", "label")


@query("f06_region_ids", "SELECT pair_id, label, region_id FROM fx_region_name")
def region_ids(t):
    return members(t).select("pair_id", "label", "region_id").distinct()


FRAME = "70e0 + (pair_id % 50) * 0.1e0 AS x0, 10e0 + (pair_id % 30) * 0.1e0 AS y0, 70.04e0 + (pair_id % 50) * 0.1e0 AS x1, 10.04e0 + (pair_id % 30) * 0.1e0 AS y1"


@query("i12_region_stats", f"""
    WITH m AS (SELECT pair_id, region_id, count(*) AS area_px, min(r) AS min_row, min(c) AS min_col, max(r) AS max_row, max(c) AS max_col, avg(r) AS ar, avg(c) AS ac, avg(score) AS s, max(score) AS x, {FRAME} FROM fx_member GROUP BY pair_id, region_id)
    SELECT pair_id, region_id, area_px, min_row, min_col, max_row, max_col, round(ar, 2) AS centroid_row, round(ac, 2) AS centroid_col, round(s, 4) AS mean_score, round(x, 4) AS max_score, round(area_px * 10e0 * 10e0, 2) AS area_m2,
      round(x0 + min_col / 4e0 * (x1 - x0), 6) AS min_lon, round(y1 - (max_row + 1) / 4e0 * (y1 - y0), 6) AS min_lat, round(x0 + (max_col + 1) / 4e0 * (x1 - x0), 6) AS max_lon, round(y1 - min_row / 4e0 * (y1 - y0), 6) AS max_lat,
      round(x0 + (ac + 0.5e0) / 4e0 * (x1 - x0), 6) AS lon, round(y1 - (ar + 0.5e0) / 4e0 * (y1 - y0), 6) AS lat FROM m""")
def region_stats(t):
    return pixels.region_stats(members(t), t.fx_frames).drop("frame_height", "frame_width")


@query("e05_change_metrics", """
    WITH s AS (SELECT pair_id, count(*) AS total_pixels, CAST(count(*) FILTER (valid) AS BIGINT) AS valid_pixels FROM fx_score GROUP BY pair_id),
    m AS (SELECT pair_id, count(*) AS n, count(DISTINCT region_id) AS regions, avg(score) AS mean, max(score) AS mx FROM fx_member GROUP BY pair_id)
    SELECT pair_id, total_pixels, valid_pixels, total_pixels - valid_pixels AS invalid_pixels, coalesce(n, 0) AS changed_pixels, coalesce(regions, 0) AS regions, round(coalesce(n, 0) / valid_pixels, 4) AS changed_fraction,
      round(coalesce(mean, 0e0), 4) AS mean_score, round(coalesce(mx, 0e0), 4) AS max_score, round(coalesce(threshold, 0e0), 4) AS threshold_used, round(coalesce(n, 0) * 100e0, 2) AS changed_area_m2
    FROM s LEFT JOIN m USING (pair_id) LEFT JOIN fx_threshold USING (pair_id)""")
def change_metrics(t):
    run = detection(t)
    return pixels.change_metrics(run.scored, run.members, run.thresholds, t.fx_frames)


@query("i13_filtered_mask", """
    SELECT pair_id, r AS row, c AS col, CASE pair_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS mask FROM fx_member""")
def filtered_mask(t):
    found = members(t)
    pair = F.col("pair_id")
    decision = F.when(pair % 4 == 0, "suppressed").when(pair % 4 == 1, "FLAGGED").when(pair % 4 == 2, "insufficient_evidence")
    decisions = found.select("pair_id", "region_id").distinct().withColumn("decision", decision).where("decision IS NOT NULL")
    return pixels.filtered_mask(found, decisions)


@query("e11_latency_stats", """
    SELECT round(avg(value), 2) AS mean_ms, round(quantile_cont(value, 0.5), 2) AS median_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms, round(1000e0 / avg(value), 2) AS per_second FROM events""")
def latency(t):
    from epochlens.operators.ranking import latency_stats

    return latency_stats(t.table("events").select(F.col("value").alias("ms")))
