"""Operator behaviour on small hand-built inputs."""

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.config import DetectionConfig, EvidenceConfig, PairingConfig
from epochlens.functions import geo
from epochlens.operators import catalog, evidence, features, lineage, matching, pairing, pixels, reviews, rules, screening, search, timeline
from epochlens.plans import investigate as plan
from epochlens.sources import manifests, tables

BOX = dict(min_lon=76.0, min_lat=12.0, max_lon=76.1, max_lat=12.1)


def observations(spark, rows):
    fields = "series_id string, observation_id string, acquisition_time timestamp, sensor string, platform string, min_lon double, min_lat double, max_lon double, max_lat double"
    return spark.createDataFrame([(s, i, t, sensor, "P", *BOX.values()) for s, i, t, sensor in rows], fields)


def day(n, hour=0):
    return dt.datetime(2026, 3, 1, hour) + dt.timedelta(days=n)


def test_statuses_in_order(spark):
    obs = observations(spark, [("s", "a", day(0), "X"), ("s", "b", day(0), "x"), ("s", "c", day(0, 1), "Y"), ("s", "d", day(9), "Y")])
    config = PairingConfig(min_separation_s=7200, max_separation_s=86400, require_same_sensor=True)
    got = {r["pair_id"]: r["status"] for r in pairing.evaluate(pairing.pairs_adjacent(obs), config).select("pair_id", "check.status").collect()}
    assert got == {"pair_a__b": "IDENTICAL_TIMESTAMPS", "pair_b__c": "BELOW_MIN_INTERVAL", "pair_c__d": "EXCEEDS_MAX_INTERVAL"}
    swapped = pairing.pairs_adjacent(obs).select(pairing.pair_status(F.col("later"), F.col("earlier"))["status"].alias("s")).collect()
    assert {r["s"] for r in swapped} == {"IDENTICAL_TIMESTAMPS", "INVALID_TEMPORAL_ORDER"}


def test_all_pairs_need_a_limit(spark):
    obs = observations(spark, [("s", f"o{i}", day(i), "X") for i in range(5)])
    with pytest.raises(ValueError):
        pairing.make_pairs(obs, "all_pairwise")
    with pytest.raises(ValueError):
        pairing.make_pairs(obs, "nearest")
    assert pairing.pairs_within(obs, 2 * 86400.0).count() == 7
    assert pairing.pair_counts(obs).first()["all_pairwise"] == 10


def raster(spark, scenes, block=512):
    """Blocks of each scene: name -> (bands, height, width) array."""
    rows = []
    for n, a in scenes.items():
        for r in range(0, a.shape[1], block):
            for c in range(0, a.shape[2], block):
                part = a[:, r:r + block, c:c + block]
                rows.append((n, r, c, part.shape[1], part.shape[2], [[float(x) for x in b.ravel()] for b in part]))
    return spark.createDataFrame(rows, "obs_id string, row0 int, col0 int, height int, width int, bands array<array<double>>")


def pair_table(spark, *ids):
    return spark.createDataFrame([(f"pair_{a}__{b}", a, b) for a, b in ids], "pair_id string, earlier_id string, later_id string")


def frames(spark, pairs, n, res=10.0):
    return pairs.select("pair_id", F.lit(n).alias("frame_height"), F.lit(n).alias("frame_width"), *[F.lit(v).alias(k) for k, v in BOX.items()], F.lit(res).alias("resolution_m"))


def test_patch_becomes_one_region(spark):
    later = np.zeros((1, 100, 100))
    later[0, 40:60, 40:60] = 1.0
    pairs = pair_table(spark, ("a", "b"))
    run = pixels.detect(pairs, raster(spark, {"a": np.zeros((1, 100, 100)), "b": later}), DetectionConfig(normalization="none"), block=100)
    region = pixels.region_stats(run.members, frames(spark, pairs, 100)).collect()
    assert len(region) == 1
    r = region[0]
    assert (r["region_id"], r["area_px"], r["min_row"], r["max_col"], r["centroid_row"], r["area_m2"]) == ("reg_0001", 400, 40, 59, 49.5, 40000.0)
    m = pixels.change_metrics(run.scored, run.members, run.thresholds, frames(spark, pairs, 100)).first()
    assert (m["changed_pixels"], m["changed_fraction"], m["max_score"]) == (400, 0.04, 1.0)


def test_unchanged_pair_and_bad_pairs(spark):
    same = np.arange(12.0).reshape(1, 3, 4)
    nan = same.copy()
    nan[0, 0, 0] = np.nan
    rasters = raster(spark, {"a": same, "b": same, "c": np.zeros((1, 2, 2)), "d": np.zeros((2, 3, 4)), "e": nan})
    pairs = pair_table(spark, ("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"))
    aligned = pixels.select_bands(pixels.align(pairs, rasters), None)
    errors = {r["pair_id"]: r["error"] for r in aligned.collect()}
    assert errors == {"pair_a__b": None, "pair_a__c": "spatial dimension mismatch", "pair_a__d": "band count mismatch", "pair_a__e": None}
    scored = pixels.score_map(pixels.valid_mask(aligned))
    assert {r["pair_id"]: r["valid_pixels"] for r in pixels.valid_counts(scored).collect()} == {"pair_a__b": 12, "pair_a__e": 11}
    thresholds = pixels.threshold(scored)
    assert {r["pair_id"]: r["threshold"] for r in thresholds.collect()}["pair_a__b"] is None
    assert pixels.change_pixels(scored, thresholds).where("pair_id = 'pair_a__b'").isEmpty()


def test_tile_hash_is_the_hash_of_its_canonical_text(spark):
    px = spark.createDataFrame([("s", 0, 0, 0, 1.0), ("s", 0, 0, 1, 2.0), ("s", 0, 0, 2, 3.0)], "k string, band int, row int, col int, value double")
    rows = {r["tile_col"]: r["sha256_hash"] for r in pixels.tile_hash(pixels.pad_tiles(pixels.tile_grid(px, 2), "k", 2, -1.0), "k").collect()}
    assert rows[0] == hashlib.sha256(b"1.0,2.0,-1.0,-1.0").hexdigest() and rows[1] == hashlib.sha256(b"3.0,-1.0,-1.0,-1.0").hexdigest()


def test_shape_of_a_rectangle_and_a_line(spark):
    rows = [("p", "rect", r, c, 0.5) for r in range(4) for c in range(6)] + [("p", "line", 20, c, 0.5) for c in range(12)] + [("p", "dot", 40, 40, 0.5)]
    members = spark.createDataFrame(rows, "pair_id string, region_id string, row int, col int, score double")
    assert {r["region_id"]: r["perimeter_px"] for r in evidence.region_perimeter(members).collect()} == {"rect": 16, "line": 12, "dot": 1}
    m = {r["region_id"]: r for r in evidence.moments(members).collect()}
    assert m["line"]["linearity_score"] == 1.0 and m["line"]["orientation_deg"] == 0.0 and m["dot"]["major_axis"] == 1.0 and m["dot"]["axis_ratio"] == 1.0
    assert m["rect"]["linearity_score"] == pytest.approx((35 - 15) / (35 + 15), abs=1e-4)


def test_context_across_blocks_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    size, block, buffer = 30, 8, 3
    scores, seen = rng.random((size, size)), rng.random((size, size)) > 0.1
    boxes = {"r1": (2, 2, 9, 10), "r2": (15, 0, 17, 2), "r3": (20, 20, 29, 29)}
    taken = [(n, r, c) for n, (r0, c0, r1, c1) in boxes.items() for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r + c) % 2]
    blocks = [("p", r, c, min(block, size - r), min(block, size - c), *[[x.item() for x in a[r:r + block, c:c + block].ravel()] for a in (scores, seen)]) for r in range(0, size, block) for c in range(0, size, block)]
    scored = spark.createDataFrame(blocks, "pair_id string, row0 int, col0 int, height int, width int, scores array<double>, seen array<boolean>")
    members = spark.createDataFrame([("p", n, r, c, float(scores[r, c])) for n, r, c in taken], "pair_id string, region_id string, row int, col int, score double")
    regions = spark.createDataFrame([("p", n, 0.5, *b) for n, b in boxes.items()], "pair_id string, region_id string, mean_score double, min_row int, min_col int, max_row int, max_col int")
    got = {r["region_id"]: r for r in evidence.context_contrast(scored, members, regions, EvidenceConfig(buffer_px=buffer, min_context_pixels=10), block).collect()}
    free = seen.copy()
    for _, r, c in taken:
        free[r, c] = False
    for n, (r0, c0, r1, c1) in boxes.items():
        window = np.s_[max(0, r0 - buffer): r1 + buffer + 1, max(0, c0 - buffer): c1 + buffer + 1]
        values = scores[window][free[window]]
        assert got[n]["context_pixels"] == len(values) and got[n]["surrounding_change"] == pytest.approx(values.mean(), abs=6e-5)


BASE = dict(
    pair_id="p", region_id="r", area_px=100, rectangularity=0.9, compactness=0.6, linearity_score=0.1, aspect_ratio=1.2, axis_ratio=1.2, major_axis=12.0, minor_axis=10.0,
    brightness_delta=0.2, contrast=0.3, ndvi_delta=None, ndvi_mean=None, ndwi_mean=None, water_fraction=None, surrounding_change=0.05, mean_score=0.6, score_std=0.1,
    has_wavelength=True, spectral_available=True, context_available=True,
)
TYPES = {"pair_id": "string", "region_id": "string", "area_px": "int", "has_wavelength": "boolean", "spectral_available": "boolean", "context_available": "boolean"}


def region(spark, **changes):
    row = {**BASE, **changes}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {TYPES.get(k, 'double')}" for k in row))


@pytest.mark.parametrize(
    "changes,category,tier",
    [
        ({}, "construction", "high"),
        ({"has_wavelength": False}, "construction", "low"),
        ({"area_px": 9}, "unknown", "uncertain"),
        ({"area_px": 24}, "construction", "medium"),
        ({"spectral_available": False}, "unknown", "uncertain"),
        ({"rectangularity": 0.5, "compactness": 0.1, "brightness_delta": -0.1, "ndvi_delta": -0.3, "ndvi_mean": 0.1}, "clearance", "high"),
        ({"water_fraction": 0.9, "ndwi_mean": 0.4, "brightness_delta": -0.1}, "water_extent_change", "high"),
        ({"linearity_score": 0.95, "aspect_ratio": 9.0, "major_axis": 80.0, "minor_axis": 8.0, "rectangularity": 0.3, "compactness": 0.1, "brightness_delta": 0.0}, "road_development", "high"),
        ({"linearity_score": 0.95, "aspect_ratio": 9.0, "major_axis": 80.0, "minor_axis": 8.0, "rectangularity": 0.3, "compactness": 0.1, "brightness_delta": 0.0, "context_available": False}, "unknown", "uncertain"),
    ],
)
def test_categories(spark, changes, category, tier):
    r = rules.classify_regions(region(spark, **changes)).first()
    assert (r["category"], r["confidence_tier"]) == (category, tier)


def test_audit_adds_up_to_the_score(spark):
    rows = rules.rule_audit(region(spark, ndvi_delta=0.1, ndvi_mean=0.5)).where("category = 'clearance'").collect()
    assert sum(r["contribution"] for r in rows) == 20 + 0 + 10 - 60 and {r["rule_id"] for r in rows} >= {"disqual_clear_vegetation_gain"}


def screened(spark, bands=None, hints=None, **changes):
    df = region(spark, **changes).withColumn("bands", F.create_map(*[F.lit(x) for k, v in (bands or {"red": 0.3, "green": 0.25, "blue": 0.2, "nir": 0.4, "swir": 0.3}).items() for x in (k, v)]))
    for name, value in (hints or {}).items():
        df = df.withColumn(name, F.lit(value))
    return screening.screen_regions(df).first()


@pytest.mark.parametrize(
    "bands,hints,changes,decision,primary",
    [
        (None, None, {}, "retained", None),
        ({"red": 0.6, "green": 0.6, "blue": 0.6, "swir": 0.2}, None, {"rectangularity": 0.4}, "suppressed", "CLOUD_CONTAMINATION"),
        ({"red": 0.6, "green": 0.6, "blue": 0.6, "swir": 0.35, "cirrus": 0.02}, None, {}, "retained", "CLOUD_CONTAMINATION"),
        ({"red": 0.6, "green": 0.6, "blue": 0.6}, None, {}, "flagged", "CLOUD_CONTAMINATION"),
        ({"red": 0.05, "green": 0.05, "blue": 0.05, "nir": 0.05}, None, {}, "flagged", "CLOUD_SHADOW"),
        ({"red": 0.05, "green": 0.05, "blue": 0.05, "nir": 0.05}, {"solar_azimuth": 120.0, "cloud_candidates": 1}, {}, "suppressed", "CLOUD_SHADOW"),
        ({"red": 0.05, "green": 0.05, "blue": 0.05, "nir": 0.05}, {"solar_azimuth": 120.0}, {}, "retained", "CLOUD_SHADOW"),
        (None, {"parallax": True}, {}, "flagged", "VIEWING_GEOMETRY_PARALLAX"),
        (None, {"noise_spike": True}, {"area_px": 2}, "suppressed", "SENSOR_NOISE_DROPOUT"),
        (None, None, {"area_px": 2}, "insufficient_evidence", None),
        (None, {"tile_median": 0.4}, {"contrast": 0.05, "surrounding_change": 0.6}, "flagged", "GLOBAL_ILLUMINATION_DRIFT"),
        ({"red": 0.5, "green": 0.8, "blue": 0.7, "swir": 0.1}, None, {}, "suppressed", "SNOW_ICE"),
        (None, {"edge_overlap": 0.9, "dipole": True}, {"compactness": 0.05, "minor_axis": 1.5}, "suppressed", "COREGISTRATION_EDGE_SHEAR"),
        (None, {"cross_sensor": True, "gain_shift": True}, {}, "retained", "RADIOMETRIC_GAIN_INCONSISTENCY"),
    ],
)
def test_decisions(spark, bands, hints, changes, decision, primary):
    r = screened(spark, bands, hints, **changes)
    assert (r["decision"], r["primary_artifact"]) == (decision, primary)


def place(spark, rows, schema):
    return spark.createDataFrame(rows, schema + ", min_lon double, min_lat double, max_lon double, max_lat double, lon double, lat double")


def test_matching_prefers_overlap_then_distance(spark):
    d = 0.0001  # about eleven metres
    candidates = place(spark, [("c", p, 77.0, 12.0, 77.001, 12.001, 77.0005, 12.0005) for p in ("one", "two", "far", "near", "none")], "candidate_id string, pair_id string")

    def at(pair, rid, x, size=0.001):
        return (pair, rid, 77.0 + x, 12.0, 77.0 + x + size, 12.001, 77.0 + x + size / 2, 12.0005)

    regions = place(spark, [at("one", "r1", 0.0), at("one", "r2", 5 * d), at("two", "r1", d), at("two", "r2", -d), at("far", "r9", 1.0), at("near", "r4", 4 * d, 0.0002)], "pair_id string, region_id string")
    got = {r["pair_id"]: r for r in matching.resolve_match(candidates, matching.candidate_x_regions(candidates, regions)).collect()}
    assert got["one"]["matched_region_id"] == "r1" and got["one"]["relationship"] == "MATCHED"
    assert got["two"]["relationship"] == "AMBIGUOUS" and got["two"]["matched_region_id"] is None
    assert got["near"]["status"] == "GEOREFERENCED_CENTROID_ONLY" and got["near"]["matched_region_id"] == "r4"
    assert got["far"]["relationship"] == got["none"]["relationship"] == "NONE" and got["far"]["status"] == "DISJOINT"


def scattered(seed, n, name):
    """Boxes of very different widths over the world, some beside 180 degrees and the poles."""
    import random

    r = random.Random(seed)
    rows = []
    for i in range(n):
        lon = r.choice([r.uniform(-180, 180), 179.9999, -179.9999, r.uniform(10, 10.01)])
        lat = r.choice([r.uniform(-89, 89), r.uniform(50, 50.01)])
        half = r.choice([0.0, 0.0001, 0.003, 0.5, 20.0])
        rows.append((f"p{i % 2}", f"{name}{i}", max(-180.0, lon - half), max(-90.0, lat - half / 3), min(180.0, lon + half), min(90.0, lat + half / 3), lon, lat))
    return rows


def test_boxes_of_all_widths_meet_once(spark):
    a, b = scattered(1, 80, "c"), scattered(2, 120, "r")
    candidates = place(spark, [(r[1], r[0], *r[2:]) for r in a], "candidate_id string, pair_id string")
    regions = place(spark, b, "pair_id string, region_id string")
    met = matching.candidate_x_regions(candidates, regions)
    got = [(r["candidate_id"], r["region_id"]) for r in met.where("iou > 0 OR distance_m <= 60").collect()]
    wide, near = F.struct(*[F.col("c." + k) for k in matching.BOX]), F.struct(*[F.col("r." + k) for k in matching.BOX])
    iou, meters = geo.metric_iou(wide, near), geo.haversine_m(F.col("c.lon"), F.col("c.lat"), F.col("r.lon"), F.col("r.lat"))
    every = candidates.alias("c").join(regions.alias("r"), F.col("c.pair_id") == F.col("r.pair_id")).where((iou > 0) | (meters <= 60))
    expected = [(r["candidate_id"], r["region_id"]) for r in every.select("candidate_id", "region_id").collect()]
    assert len(expected) > 50 and sorted(got) == sorted(expected)


def test_nearest_region_is_found_at_any_distance(spark):
    a, b = scattered(3, 60, "c"), scattered(4, 90, "r")
    b += [("lone", "r", 0.0, 0.0, 0.0, 0.0, 179.99, 1.0), ("p0", "none", None, None, None, None, None, None)]
    a += [("lone", "far", 0.0, 0.0, 0.0, 0.0, 0.0, -1.0), ("lone", "over", 0.0, 0.0, 0.0, 0.0, -179.99, 1.0), ("empty", "e", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("lone", "n", None, None, None, None, None, None)]
    candidates = place(spark, [(r[1], r[0], *r[2:]) for r in a], "candidate_id string, pair_id string")
    regions = place(spark, b, "pair_id string, region_id string")
    got = {(r["candidate_id"], r["pair_id"]): r["distance_m"] for r in matching.nearest_regions(candidates, regions).collect()}
    meters = geo.haversine_m(F.col("c.lon"), F.col("c.lat"), F.col("r.lon"), F.col("r.lat"))
    every = candidates.alias("c").join(regions.alias("r"), F.col("c.pair_id") == F.col("r.pair_id")).groupBy("candidate_id", "c.pair_id").agg(F.min(meters).alias("m"))
    assert got == {(r["candidate_id"], r["pair_id"]): r["m"] for r in every.where("m IS NOT NULL").collect()}
    assert 2_000 < got["over", "lone"] < 2_300 and got["far", "lone"] > 1e7


def test_none_rows_carry_the_nearest_distance(spark):
    candidates = place(spark, [("c", p, 77.0, 12.0, 77.001, 12.001, 77.0005, 12.0005) for p in ("far", "bare")], "candidate_id string, pair_id string")
    regions = place(spark, [("far", "r", 78.0, 12.0, 78.001, 12.001, 78.0005, 12.0005)], "pair_id string, region_id string")
    found = matching.resolve_match(candidates, matching.candidate_x_regions(candidates, regions), regions=regions)
    got = {r["pair_id"]: (r["relationship"], r["distance_m"]) for r in matching.with_nearest(found, candidates, regions).collect()}
    assert got["bare"] == ("NONE", None) and got["far"][0] == "NONE" and 108_000 < got["far"][1] < 109_000


def test_an_empty_target_is_disjoint_before_metadata_is_asked_for(spark):
    candidates = place(spark, [("c", p, None, None, None, None, None, None) for p in ("full", "empty")], "candidate_id string, pair_id string")
    regions = place(spark, [("full", "r", 77.0, 12.0, 77.001, 12.001, 77.0005, 12.0005)], "pair_id string, region_id string")
    met = matching.candidate_x_regions(candidates, regions)
    got = {r["pair_id"]: r["status"] for r in matching.resolve_match(candidates, met, regions=regions).collect()}
    assert got == {"full": "INSUFFICIENT_METADATA", "empty": "DISJOINT"}


def test_reviews_skip_repeats_and_chain_hashes(spark):
    def batch(*rows):
        return spark.createDataFrame([("i", "r", day(n), n, d, note, "") for n, d, note in rows], "investigation_id string, region_id string, ts timestamp, event_id int, decision string, note string, reason string")

    first = reviews.review_append(None, batch((1, "confirm", ""), (2, "CONFIRMED", " "), (3, "reject", "")))
    second = reviews.review_append(first, batch((4, "rejected", ""), (5, "rejected", "x"), (6, "confirm", "x")))
    log = first.unionByName(second).orderBy("revision").collect()
    assert [(r["revision"], r["decision"], r["previous_decision"]) for r in log] == [(1, "CONFIRMED", None), (2, "REJECTED", "CONFIRMED"), (3, "REJECTED", "REJECTED"), (4, "CONFIRMED", "REJECTED")]
    assert {r["created_at"] for r in log} == {day(1)} and len({r["audit_hash"] for r in log}) == 4


def test_documents_with_lists_objects_and_errors(spark, tmp_path):
    tile = dict(tile_id="tile_a", source_scene_id="scene", tile_col=0, tile_row=1, crs="EPSG:4326", bounds_wgs84=BOX, file_path="x", sha256_hash="a" * 64)
    (tmp_path / "one.json").write_text(json.dumps({**tile, "tile_id": "tile_b"}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps([tile, {**tile, "sha256_hash": "short"}]))
    (tmp_path / "broken.json").write_text("{ not json")
    good, bad = manifests.read_tiles(spark, str(tmp_path))
    assert {r["tile_id"] for r in good.collect()} == {"tile_a", "tile_b"}
    assert {tuple(r["errors"])[0] for r in bad.collect()} == {"sha256_hash is not 64 characters", "document cannot be read"}
    files = {r["file_hash"]: r["error"] for r in manifests.file_inventory(spark, str(tmp_path), "*.json").collect()}
    assert hashlib.sha256(b"{ not json").hexdigest() in files


def test_files_are_hashed_as_streams(spark, tmp_path):
    """Above the length that a row of `binaryFile` may have, with names that need quoting, and with settings of this session only."""
    contents = {"a b%20c.bin": bytes(range(256)) * 400, "#é.gz": b"not compressed", "one": b"x"}
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / "sub" / name).write_bytes(content)
    limit, settings = "spark.sql.sources.binaryFile.maxLength", spark._jsc.hadoopConfiguration()
    spark.conf.set(limit, "100")
    settings.set("fs.viewfs.mounttable.hashed.link./in", f"file://{tmp_path}")
    try:
        rows = {r["path"].rsplit("/", 1)[1]: r for r in manifests.file_inventory(spark, "viewfs://hashed/in").collect()}
    finally:
        spark.conf.unset(limit)
        settings.unset("fs.viewfs.mounttable.hashed.link./in")
    assert {name: (r["length"], r["file_hash"], r["error"]) for name, r in rows.items()} == {
        name: (len(content), hashlib.sha256(content).hexdigest(), None) for name, content in contents.items()
    }


def test_strict_insert(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        tables.insert_strict(stored, stored, ["k"])
    assert tables.insert_strict(stored, spark.createDataFrame([("b", 2)], "k string, v int"), ["k"]).count() == 2


def test_search_rejects_reversed_dates():
    with pytest.raises(ValueError):
        search.TileFilter(date_from=day(2), date_to=day(1))


def test_projection_is_orthonormal_and_embedders_are_listed(spark):
    m = features.projection_matrix()
    assert m.shape == (64, 512) and np.allclose(m @ m.T, np.eye(64), atol=1e-5)
    assert [e.model_id for e in features.list_embedders(True)] == ["spectral-spatial", "text-concepts"]
    with pytest.raises(KeyError):
        features.embedder("missing")
    v = features.embedder("text-concepts").embed(spark.createDataFrame([("Water-lake",), ("???",)], "text string")).collect()
    want = np.zeros(64)
    want[:6] = 2 * np.array(features.WATER)
    want = want @ m
    assert np.allclose(v[0]["v"], want / np.linalg.norm(want), atol=1e-6) and np.linalg.norm(v[1]["v"]) == pytest.approx(1.0)


def four_epochs(spark, block):
    """Four dates; a bright square appears with the second and stays; another change shifts its number."""
    rng = np.random.default_rng(0)
    ground = np.stack([0.20 + 0.02 * rng.random((64, 64)) for _ in range(3)])
    scenes = {}
    for n in range(4):
        a = ground.copy()
        if n >= 1:
            a[:, 20:32, 20:32] = 0.80 + np.array([0.0, -0.2, -0.4])[:, None, None]
        if n >= 2:
            a[:, 45:60, 40:58] = 0.78 + np.array([0.0, -0.2, -0.4])[:, None, None]
        scenes[f"t{n}"] = a
    times = [dt.datetime(2026, m, 15) for m in (1, 2, 3, 4)]
    fields = "series_id string, observation_id string, acquisition_time timestamp, sensor string, platform string, min_lon double, min_lat double, max_lon double, max_lat double, cloud_fraction double, valid_pixel_ratio double, source_hash string"
    obs = spark.createDataFrame([("s", f"t{n}", times[n], "MSI", "S2", 77.0, 12.0, 77.006, 12.006, 0.02, 0.99, f"h{n}") for n in range(4)], fields)
    boxes = obs.select("observation_id", F.lit(64).alias("frame_height"), F.lit(64).alias("frame_width"), "min_lon", "min_lat", "max_lon", "max_lat", F.lit(10.0).alias("resolution_m"))
    return obs, raster(spark, scenes, block), boxes


@pytest.mark.parametrize("block", [64, 16])
def test_investigation_end_to_end(spark, block):
    obs, rasters, boxes = four_epochs(spark, block)
    asked = spark.createDataFrame(
        [("c", "s", "pair_t0__t1", "reg_0001"), ("x", "nowhere", "pair_t0__t1", "reg_0001"), ("y", "s", "pair_t0__t9", "reg_0001"), ("z", "s", "pair_t0__t1", "reg_0099")],
        "candidate_id string, series_id string, pair_id string, region_id string",
    )
    settings = plan.Settings(strategy="baseline", block=block, band_names=("Red", "Green", "Blue"), evidence=EvidenceConfig(band_roles={"red": 0, "green": 1, "blue": 2}),
                             detection=DetectionConfig(threshold_method="fixed", fixed_threshold=0.3, normalization="none"))
    result = plan.investigate(asked, obs, rasters, boxes, settings)
    assert {(r["candidate_id"], r["stage"]) for r in result.errors.collect()} == {("x", "series_resolution"), ("y", "discovery_pair_resolution"), ("z", "candidate_region_validation")}
    nodes = result.timeline.orderBy("acquisition_time").collect()
    assert [n["node_status"] for n in nodes] == ["PRE_CHANGE_ABSENCE", "EARLIEST_SUPPORTING", "PERSISTENT_SUPPORT", "PERSISTENT_SUPPORT"]
    assert {n["category"] for n in nodes[1:]} == {"construction"}
    shifted = {r["pair_id"]: r["matched_region_id"] for r in result.matches.collect()}
    assert shifted["pair_t0__t1"] == "reg_0001" and shifted["pair_t0__t2"] == shifted["pair_t0__t3"] == "reg_0002"
    s = plan.dossiers(result, asked, obs).collect()
    assert len(s) == 1
    assert (s[0]["support_status"], s[0]["confidence_tier"], s[0]["interval_days"], s[0]["interval"]) == ("STRONG_TEMPORAL_SUPPORT", "high", 31.0, "(2026-01-15, 2026-02-15]")
    assert s[0]["completeness"] == "COMPLETE" and s[0]["shifted_ids"] == 2
    areas = {r["region_id"]: r["area_px"] for r in result.regions.where("pair_id = 'pair_t0__t2'").collect()}
    assert areas == {"reg_0001": 270, "reg_0002": 144}


def test_nodata_of_a_date_counts_for_that_date_only(spark):
    rasters = spark.createDataFrame(
        [(1, 0, 0, 1, 3, [[1.0, 2.0, 0.0]], -99.0), (2, 0, 0, 1, 3, [[5.0, -99.0, 3.0]], 0.0)],
        "obs_id int, row0 int, col0 int, height int, width int, bands array<array<double>>, nodata double",
    )
    both = pixels.align(spark.createDataFrame([("p", 1, 2)], "pair_id string, earlier_id int, later_id int"), rasters)
    assert pixels.valid_mask(both).first()["valid"] == [True, True, True]
    own = pixels.align(spark.createDataFrame([("p", 2, 1)], "pair_id string, earlier_id int, later_id int"), rasters)
    assert pixels.valid_mask(own).first()["valid"] == [True, True, True]
    assert pixels.valid_mask(both, DetectionConfig(nodata=-99.0)).first()["valid"] == [True, False, True]


def test_a_pair_scores_the_same_beside_a_larger_one(spark):
    import random

    r = random.Random(1)
    block = lambda obs, side: (obs, 0, 0, side, side, [[r.random() for _ in range(side * side)] for _ in range(2)], None)
    rows = [block(1, 6), block(2, 6), block(3, 200), block(4, 200)]
    schema = "obs_id int, row0 int, col0 int, height int, width int, bands array<array<double>>, nodata double"
    pairs = spark.createDataFrame([("small", 1, 2), ("large", 3, 4)], "pair_id string, earlier_id int, later_id int")

    def scores(part):
        masked = pixels.valid_mask(pixels.select_bands(pixels.align(part, spark.createDataFrame(rows, schema)), None))
        return pixels.score_map(masked).where("pair_id = 'small'").first()["scores"]

    assert scores(pairs) == scores(pairs.where("pair_id = 'small'"))


def test_blocks_give_what_their_pixels_give(spark):
    rng = np.random.default_rng(17)
    rows = []
    for obs in range(3):
        for row0, col0, h, w in ((0, 0, 4, 6), (0, 6, 4, 3), (4, 0, 2, 6)):
            bands = [[float(v) for v in rng.choice([-99.0, 1.0, 2.5, 7.0], h * w)] for _ in range(2)]
            rows.append((obs, row0, col0, h, w, [[3.0] * (h * w)] * 2 if obs == 2 else bands))
    blocks = spark.createDataFrame(rows, "obs_id int, row0 int, col0 int, height int, width int, bands array<array<double>>")
    px = pixels.explode_raster(blocks, "obs_id")
    for nodata in (-99.0, None):
        want = pixels.tile_nodata(pixels.tile_grid(px, 3), "obs_id", nodata).collect()
        assert sorted(map(tuple, pixels.nodata_of_blocks(blocks, "obs_id", 3, nodata).collect())) == sorted(map(tuple, want))
    got = pixels.explode_raster(pixels.rescale_blocks(blocks, "obs_id"), "obs_id").collect()
    want = pixels.rescale_8bit(px, "obs_id").select("obs_id", "band", "row", "col", "byte").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert pixels.nodata_of_blocks(blocks.limit(0), "obs_id", 3, -99.0).count() == 0


def test_scores_read_blocks_that_are_aligned_once(spark):
    pair = spark.createDataFrame([(1, "a", "b")], "pair_id int, earlier_id string, later_id string")
    grid = [[float(i) for i in range(16)]]
    rasters = spark.createDataFrame([("a", 0, 0, 4, 4, grid), ("b", 0, 0, 4, 4, [grid[0][::-1]])], "obs_id string, row0 int, col0 int, height int, width int, bands array<array<double>>")
    run = pixels.detect(pair, rasters, block=4)
    for table in (run.aligned, run.scored):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert run.aligned.count() == 1


def test_large_tiles_are_padded(spark):
    px = spark.range(256 * 256).selectExpr("'k' AS key", "0 AS band", "CAST(id DIV 256 AS INT) AS row", "CAST(id % 256 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    tile = pixels.pad_tiles(pixels.tile_grid(px.where("id % 7 > 0"), 256), "key", 256, -1.0).first()
    assert tile["values"] == [float(i) if i % 7 else -1.0 for i in range(256 * 256)]


def test_investigation_ids_ignore_retries_and_keep_missing_parts_apart(spark):
    schema = "investigation_key string, series_id string, pair_key string, region_id string, pair_id string, result_id string, evidence_id string, classification_id string, suppression_id string, acquisition_time timestamp"
    base = lambda key, **parts: (key, "s", "p", "r", *[parts.get(c) for c in ("pair", "result", "evidence", "cls", "sup")], day(1))
    stages = spark.createDataFrame([
        base("once", pair="A", result="B"), base("twice", pair="A", result="B"), base("twice", pair="A", result="B"),
        base("other", pair="C", result="D"), base("other", pair="C", result="D"), base("x_result", result="X"), base("x_evidence", evidence="X"),
        base("two", pair="A"), base("two", pair="C"), base("owt", pair="C"), base("owt", pair="A"),
    ], schema)
    hashes = spark.createDataFrame([], "investigation_key string, key string, hash string")
    got = {r["investigation_key"]: r["content_hash"] for r in lineage.investigation_ids(stages, hashes).collect()}
    assert got["once"] == got["twice"] and got["two"] == got["owt"]
    assert len({got[k] for k in ("once", "other", "x_result", "x_evidence", "two")}) == 5


def test_investigation_ids_of_a_very_large_investigation_are_dealt_over_tasks(spark, monkeypatch):
    """Every id was shuffled twice with the four texts of its key, the second time as eight sums."""
    rows = [(f"k{i % 3}", "s", None if i % 3 == 1 else "p", "r", f"pair{i % 40}", f"res{i}", None, f"cls{i % 7}", f"sup{i}", day(1)) for i in range(120)]
    schema = "investigation_key string, series_id string, pair_key string, region_id string, pair_id string, result_id string, evidence_id string, classification_id string, suppression_id string, acquisition_time timestamp"
    stages = spark.createDataFrame(rows, schema)
    hashes = spark.createDataFrame([("k0", "a", "h")], "investigation_key string, key string, hash string")
    plain = {tuple(r) for r in lineage.investigation_ids(stages, hashes).collect()}
    monkeypatch.setattr(lineage, "HOT_ROWS", 7)
    assert {tuple(r) for r in lineage.investigation_ids(stages, hashes).collect()} == plain and len(plain) == 3

    def digest(values):
        hashed = [hashlib.sha256(v.encode()).hexdigest() for v in values]
        sums = [f"{sum(int(h[8 * i:8 * i + 8], 16) for h in hashed):016x}" for i in range(8)]
        return hashlib.sha256(("".join(sums) + str(len(hashed))).encode()).hexdigest()

    mine = [r for r in rows if r[0] == "k1"]
    parts = [digest({r[i] for r in mine} - {None}) for i in range(4, 9)]
    seed = ":".join(["s", lineage.MISSING, "r", *parts, lineage.MISSING, ""])
    assert hashlib.sha256(seed.encode()).hexdigest()[:16] in {r[3] for r in plain if r[0] == "k1"}


def test_a_text_is_split_and_hashed_once(spark):
    """Each signature and each byte of the hash took the whole text again."""
    texts = spark.createDataFrame([(1, "Water lake-city, no"), (2, "nothing"), (3, None), (4, "forest  trees\nsoil")], "id int, text string")
    shown = texts.select(features.concept_vector(F.col("text")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("split(") == 1 and shown.count("sha2(") == 1
    got = {r["id"]: r["v"] for r in texts.select("id", features.concept_vector(F.col("text")).alias("v")).collect()}
    sha = hashlib.sha256(b"nothing").digest()
    # "city," is no known word.
    assert got[1][:6] == pytest.approx([2 * x for x in features.WATER]) and len(got[1]) == features.FEATURES
    assert got[2] == [b / 255.0 for b in sha] + [0.0] * 32
    assert got[3][0] is None
    assert got[4][:6] == pytest.approx([2 * a + b for a, b in zip(features.GREEN, features.BARE)])


def test_kinds_of_a_timeline_come_from_one_pass(spark):
    rows = [("c", f"o{i}", s, d) for i, (s, d) in enumerate([
        ("EARLIEST_SUPPORTING", "retained"), ("PERSISTENT_SUPPORT", "flagged"), ("PRE_CHANGE_ABSENCE", None), ("FLAGGED_SUPPORT", "Flagged"), ("INSUFFICIENT_DATA", "retained"), (None, "suppressed"), (None, None),
    ])]
    nodes = spark.createDataFrame(rows, "candidate_id string, observation_id string, node_status string, decision string")
    kinds = ("supporting", "absence", "flagged_suppressed")
    got = sorted((r["kind"], r["observation_id"]) for r in timeline.timeline_kinds(nodes, kinds).collect())
    assert got == sorted((k, r["observation_id"]) for k in kinds for r in timeline.filter_timeline(nodes, k).collect())
    assert len(got) == 6
    with pytest.raises(ValueError):
        timeline.timeline_kinds(nodes, ("none",))


def test_the_last_update_counts(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("a", 9, 1), ("a", 3, 2), ("c", 5, 1)], "k string, v int, arrived int")
    assert sorted(map(tuple, tables.upsert(table, updates, ["k"], "arrived").collect())) == [("a", 3), ("b", 2), ("c", 5)]


@pytest.mark.parametrize("few", [0, 64])
def test_nearest_region_searches_a_place_once(spark, monkeypatch, few):
    """Copies of a place were each followed through the hierarchy, so the shuffle grew with the copies."""
    monkeypatch.setattr(matching, "FEW_REGIONS", few)
    places = [((i * 37) % 360 - 180.0, (i * 11) % 160 - 80.0) for i in range(40)]
    regions = spark.createDataFrame([("p", f"r{i}", lon + 1.5, lat + 0.5) for i, (lon, lat) in enumerate(places[:30])], "pair_id string, region_id string, lon double, lat double")

    def search(copies):
        rows = [(f"c{i}_{k}", "p", *place) for i, place in enumerate(places) for k in range(copies)]
        asked = spark.createDataFrame(rows, "candidate_id string, pair_id string, lon double, lat double")
        store = spark.sparkContext._jsc.sc().statusStore()
        before = store.executorList(False).apply(0).totalShuffleWrite()
        found = {r["candidate_id"]: r["distance_m"] for r in matching.nearest_regions(asked, regions).collect()}
        return found, store.executorList(False).apply(0).totalShuffleWrite() - before

    one, small = search(1)
    many, large = search(50)
    assert len(one) == 40 and all(many[f"c{i}_{k}"] == one[f"c{i}_0"] for i in range(40) for k in range(50))
    if not few:
        assert large < 6 * small


def test_json_lists_are_bounded(spark, monkeypatch):
    """A partition was one list, which a reader holds whole."""
    from epochlens.catalogue import tables as queries

    monkeypatch.setattr(queries, "LIST_ROWS", 10, raising=False)
    path = queries._json_lists(spark.range(0, 95, 1, 2).select(F.concat(F.lit("t"), "id").alias("tile_id")))
    lists = [r[0] for r in spark.read.option("wholetext", True).text(path).collect()]
    assert max(x.count("tile_id") for x in lists) == 10
    assert spark.read.option("multiLine", True).schema("tile_id string").json(path).distinct().count() == 95


@pytest.mark.parametrize("rows", [0, 3000])
def test_json_lists_are_compressed(spark, rows):
    """Plain documents took about 20 times the room of the table that they were made of."""
    from epochlens.catalogue import tables as queries

    df = spark.range(0, 3000, 1, 2).where(F.col("id") < F.lit(rows)).select(F.concat(F.lit("tile_"), "id").alias("tile_id"), F.lit('a "quoted",\n[text]').alias("sensor"), F.lit(None).cast("string").alias("crs"))
    path = queries._json_lists(df)
    stored = spark.read.format("binaryFile").load(path)
    documents = [json.loads(r[0]) for r in spark.read.option("wholetext", True).text(path).collect()]
    assert sorted(x["tile_id"] for one in documents for x in one) == sorted(f"tile_{i}" for i in range(rows)) and documents
    assert all(x["sensor"] == 'a "quoted",\n[text]' and "crs" not in x for one in documents for x in one)
    assert not rows or stored.agg(F.sum("length")).first()[0] < len(json.dumps(documents)) / 4


def test_catalog_metrics_join_only_tiles_without_a_time(spark):
    """All tiles were joined with all their columns; a scene listed twice counts its tiles twice, as a left join does."""
    scenes = spark.createDataFrame(
        [("a", "2024-01-01", "S", "P", 1.0), ("b", None, "S", "P", 1.0), ("b", "2024-01-02", "S", "P", 1.0), ("c", None, "S", "P", 1.0), ("d", "2024-01-01", "S", "P", None)] + [("d", None, "S", "P", None)] * 2,
        "scene_id string, time string, sensor string, platform string, cloud_cover_percentage double",
    ).withColumn("acquisition_time", F.to_timestamp("time")).drop("time")
    tiles = spark.createDataFrame(
        [("t1", "a", None, "h1", 0), ("t2", "b", None, "h2", 1), ("t3", "c", None, "h3", 2), ("t4", "x", None, "h4", 3), ("t5", "d", "2024-03-01", "h5", 4), ("t5", "d", "2024-03-01", "h5", 4),
         ("t6", "x", "2024-03-01", "h6", 0), ("t7", None, "2024-03-01", "h7", 5), ("t8", None, None, "h8", 6)],
        "tile_id string, source_scene_id string, time string, sha256_hash string, tile_col long",
    ).withColumn("acquisition_time", F.to_timestamp("time")).drop("time").withColumns({
        "tile_row": F.lit(1), "zoom_level": F.lit(14), "sensor": F.lit("S"), "valid_pixel_ratio": F.lit(1.0),
        "min_lon": F.lit(1.0), "min_lat": F.lit(1.0), "max_lon": F.lit(2.0), "max_lat": F.lit(2.0),
    })
    found = catalog.catalog_metrics(scenes, tiles)
    # Rows of the left join: t1 1 valid, t2 1 of 2, t3 0 of 1, t4 0 of 1, t5 twice 3, t6 1, t7 1, t8 0 of 1.
    row = found.first().asDict()
    assert row == {"scenes": 7, "accepted_rows": 10, "invalid_observations": 4, "valid_observations": 5, "series": 4}
    # Hand-made from the joined table, too.
    joined = catalog.series_key(catalog.tiles_with_scene(tiles, scenes))
    good = joined.where(F.size("errors") == 0)
    assert (row["accepted_rows"], row["valid_observations"], row["series"]) == (good.count(), good.select("observation_id").distinct().count(), good.select("series_id").distinct().count())
    assert "Filter isnull(" in found._jdf.queryExecution().optimizedPlan().toString()
