"""Known answers of column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epochlens.functions import geo, text, times, vectors

UTC = dt.timezone.utc


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit_box(*v):
    return geo.box(*[F.lit(float(x)) for x in v])


def test_overlap_of_shifted_unit_boxes(spark):
    o = one(spark, o=geo.bbox_overlap(lit_box(0, 0, 2, 2), lit_box(1, 1, 3, 3)))["o"]
    assert o["ratio_iou"] == pytest.approx(1 / 7, abs=1e-4) and o["ratio_min"] == 0.25 and o["area"] == 1.0


@pytest.mark.parametrize("other", [(2, 0, 4, 2), (5, 5, 6, 6), (1, 1, 1, 2)])
def test_touching_disjoint_and_empty_boxes_do_not_overlap(spark, other):
    o = one(spark, o=geo.bbox_overlap(lit_box(0, 0, 2, 2), lit_box(*other)))["o"]
    assert not o["overlapping"] and o["ratio_iou"] == 0.0 and o["bounds"] is None


def test_separation_in_days(spark):
    a, b = F.lit("2026-03-01 10:00:00").cast("timestamp"), F.lit("2026-03-11 22:00:00").cast("timestamp")
    s = one(spark, s=times.separation(a, b), back=times.separation(b, a))
    assert s["s"]["days"] == 10.5 and s["s"]["hours"] == 252.0 and s["back"]["seconds"] == 0.0


def test_haversine_and_metric_iou(spark):
    r = one(spark, d=geo.haversine_m(F.lit(77.0), F.lit(12.0), F.lit(77.0), F.lit(13.0)), same=geo.metric_iou(lit_box(0, 0, 1, 1), lit_box(0, 0, 1, 1)),
            apart=geo.metric_iou(lit_box(0, 0, 1, 1), lit_box(5, 5, 6, 6)))
    assert r["d"] == pytest.approx(111194.93, abs=0.5) and r["same"] == 1.0 and r["apart"] == 0.0


def test_name_and_tag_times(spark):
    tags = F.create_map(F.lit("TIFFTAG_DATETIME"), F.lit("2026:03:15 05:20:21"))
    none = F.create_map().cast("map<string,string>")
    r = one(spark, tag=text.parse_acquisition_time(tags, F.lit("x")), name=text.parse_acquisition_time(none, F.lit("S2A_2024-05-06T010203_x")),
            day=text.parse_acquisition_time(none, F.lit("scene_20240506")), bad=text.parse_acquisition_time(none, F.lit("scene_20241399")), old=text.parse_acquisition_time(none, F.lit("x19000101")))
    assert r["tag"] == dt.datetime(2026, 3, 15, 5, 20, 21) and r["name"] == dt.datetime(2024, 5, 6, 1, 2, 3)
    assert r["day"] == dt.datetime(2024, 5, 6) and r["bad"] is None and r["old"] is None


def test_sensor_from_name_and_mixed_case_tags(spark):
    tags = F.create_map(F.lit("Sensor"), F.lit("X"), F.lit("SENSOR"), F.lit("Y"))
    none = F.create_map().cast("map<string,string>")
    r = one(spark, a=text.detect_sensor_platform(tags, F.lit("S2A")), b=text.detect_sensor_platform(none, F.lit("landsat_8_x")), c=text.detect_sensor_platform(none, F.lit("q")))
    assert r["a"]["sensor"] == "Y" and r["a"]["platform"] == "unknown" and r["b"]["platform"] == "Landsat-8" and r["c"]["sensor"] == "unknown"


def test_band_lookup_scales_bytes_and_keeps_the_last_spelling(spark):
    m = F.create_map(F.lit("Red"), F.lit(255.0), F.lit("red"), F.lit(0.5), F.lit("B08"), F.lit(51.0))
    r = one(spark, red=text.band_lookup(m, ("red",)), nir=text.band_lookup(m, ("nir", "b08")), none=text.band_lookup(m, ("swir",)))
    assert r["red"] == 0.5 and r["nir"] == 0.2 and r["none"] is None


def test_set_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "k int, s string")
    d = {r["k"]: r["d"] for r in df.groupBy("k").agg(text.set_digest(F.col("s")).alias("d")).collect()}
    assert d[1] == d[2] != d[3] and len(d[1]) == 64


def test_vectors_without_direction(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, keep=vectors.l2_normalize(zero), z=vectors.l2_normalize(zero, "zero"), c=vectors.cosine(zero, F.array(F.lit(1.0), F.lit(0.0))), u=vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert r["keep"] == [0.0, 0.0] and r["z"] == [0.0, 0.0] and r["c"] == 0.0 and r["u"] == [0.6, 0.8]


def test_decisions(spark):
    rows = spark.createDataFrame([(" Confirm ",), ("REJECTED",), (None,), ("later",)], "d string").select(text.normalize_decision(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["CONFIRMED", "REJECTED", "PENDING", "PENDING"]
