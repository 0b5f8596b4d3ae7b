"""Hand-computed cases, invariants and error paths of the operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import names as N
from landloom.operators import accuracy as A
from landloom.operators import bootstrap as B
from landloom.operators import change as C
from landloom.operators import grid as G
from landloom.operators import models as M
from landloom.operators import parcels as PA
from landloom.operators import pixels as P
from landloom.operators import raster as R
from landloom.operators import runs as RU
from landloom.operators import sampling as S
from landloom.operators import vector as V
from landloom.plans import block_bootstrap, change_analysis, sampling
from landloom.queries import QUERIES, load
from landloom.sources import tables as T
from landloom.sources.derived import table


def test_transition_rows_sum_to_class_areas(spark, sf):
    p = table(spark, sf, "class_pair")
    m = C.transition_matrix(p).groupBy("scope", "c1").agg(F.sum("n").alias("n"))
    valid = p.filter(C.valid()).groupBy("c1").count()
    assert m.filter("scope = 'all'").join(valid, "c1").filter("n <> count").count() == 0
    zones = C.transition_matrix(p).filter("scope <> 'all'").agg(F.sum("n")).first()[0]
    assert zones == p.filter(C.valid()).count()


def test_results_do_not_depend_on_partitions(spark, sf):
    p = table(spark, sf, "class_pair")
    want = sorted(map(tuple, C.transition_shares(p).collect()))
    for k in (1, 7):
        assert sorted(map(tuple, C.transition_shares(p.repartition(k)).collect())) == want
    s = table(spark, sf, "ae_pixels")
    order = [F.xxhash64("sample_id"), F.col("sample_id")]
    want = sorted(r[0] for r in S.capped(s, ["class_id"], order, 5).select("sample_id").collect())
    assert want == sorted(r[0] for r in S.capped(s.repartition(9), ["class_id"], order, 5, salts=3).select("sample_id").collect())


def test_pair_in_both_reciprocal_categories_raises(spark):
    p = spark.createDataFrame([(9, 9), (5, 9), (8, 7)], "c1 int, c2 int")
    assert [r[0] for r in p.select(C.reciprocal_category("ecology")).collect()] == [0, 2, 3]


def test_hillshade_of_flat_ground(spark):
    flat = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(3)], "px_row int, px_col int, z double")
    got = {round(r.shade, 9) for r in R.hillshade(flat).collect()}
    assert got == {round((np.sin(np.pi / 4) + 1) / 2, 9)}


def test_bilinear_scales_weights_over_valid_neighbours(spark):
    src = spark.createDataFrame([(0, 0, 10.0), (0, 1, None), (1, 0, 30.0), (1, 1, 40.0)], "px_row int, px_col int, value double")
    at = spark.createDataFrame([(0, 0, 1.0, 1.0)], "px_row int, px_col int, u double, v double")
    assert R.warped(src, at, "bilinear").first().value == pytest.approx((10 + 30 + 40) / 3)
    assert R.warped(src, at, "nearest").first().value == 40.0


def test_point_in_polygon_with_a_hole(spark):
    f = spark.createDataFrame([(0, 0.0, 4.0, 1.0, 3.0)], "feature_id int, a double, b double, c double, d double")
    f = f.select("feature_id", F.concat(V.rectangle("a", "a", "b", "b"), V.rectangle("c", "c", "d", "d")).alias("rings"))
    p = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([(0.5, 0.5), (2.0, 2.0), (3.5, 2.0), (5.0, 1.0)])], "k int, x double, y double")
    assert sorted(r.k for r in V.pixels_in(p, f, 2.0).collect()) == [0, 2]
    assert f.select(V.polygon_area()["area_m2"]).first()[0] == 12.0
    plan = V.pixels_in(p, f, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_utm_round_trip(spark):
    p = spark.createDataFrame([(90.4125, 23.8103), (93.0, 21.5), (96.0, 24.0)], "lon double, lat double")
    u = p.withColumns(V.to_utm(F.col("lon"), F.col("lat")))
    b = u.withColumns({f"{k}2": v for k, v in V.from_utm(F.col("easting"), F.col("northing")).items()})
    for r in b.collect():
        assert abs(r.lon - r.lon2) < 1e-7 and abs(r.lat - r.lat2) < 1e-7
    centre = p.limit(1).select(V.to_utm(F.lit(93.0), F.lit(0.0))["easting"]).first()[0]
    assert centre == pytest.approx(500000.0)


def test_undefined_quotients(spark):
    m = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 1, 5)], "run_name string, y_true int, y_pred int, n long")
    zero = A.run_metrics(m, ["run_name"]).first()
    skip = A.run_metrics(m, ["run_name"], missing=None).first()
    assert zero.macro_recall == pytest.approx(0.1) and skip.macro_recall == pytest.approx(0.5)
    assert zero.accuracy == skip.accuracy == 0.5


def test_draws_are_stable_and_gate_passes(spark, sf):
    a = sorted(map(tuple, B.draws(spark, 7, 5, 42).collect()))
    assert a == sorted(map(tuple, B.draws(spark, 7, 5, 42).repartition(3).collect())) and len(a) == 35
    p = table(spark, sf, "predictions").filter("split = 'test'").select("run_name", "block_id", "y_true", "y_pred")
    out = block_bootstrap.intervals(p, A.confusion(p, ["run_name"]), ["run_name"], 20, 42)
    assert out["gate"].filter("not equal").count() == 0
    assert out["runs"].filter("lower > mean or mean > upper").count() == 0


def test_split_shares_are_checked():
    for val, test in ((-0.1, 0.2), (0.5, 0.5)):
        with pytest.raises(ValueError, match="shares"):
            P.check_shares(val, test)


def test_blocks_do_not_cross_splits(spark, sf):
    s = sampling.extracted(table(spark, sf, "ae_pixels"), 5, 42, 0.15, 0.15, 20, ["sample_id"])
    assert s.groupBy("block_id").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    assert s.groupBy("class_id").count().filter("count > 20").count() == 0
    d = sampling.described(s)
    assert d["checks"].filter("not ok").count() == 0 and d["features"].count() == 64


def test_mosaic_extent_needs_one_system(spark):
    g = spark.createDataFrame([(1, 10.0, -10.0, 0.0, 0.0, 5, 5), (2, 10.0, -10.0, 50.0, 0.0, 5, 5)], "epsg int, a double, e double, c double, f double, width int, height int")
    with pytest.raises(Exception, match="differ in system"):
        G.mosaic_extent(g).collect()
    assert G.mosaic_extent(g.withColumn("epsg", F.lit(1))).first().width == 10


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: b, c"):
        T.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_nested_fields_become_dotted_columns(spark):
    d = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": 1, "c": [1, 2]}, "d": "x"}']))
    assert T.flattened(d).first().asDict() == {"a.b": 1, "a.c": "[1,2]", "d": "x"}


def test_nan_sorts_as_missing(spark):
    r = spark.createDataFrame([("a", float("nan"), 0.1, 0.1), ("b", 0.5, 0.1, 0.1), ("c", None, 0.1, 0.1)], "run_name string, val_f1 double, test_f1 double, val_loss double")
    assert r.orderBy(*RU.best_order()).first().run_name == "b"


def test_majority_of_a_parcel_without_pixels(spark):
    px = spark.createDataFrame([("a", 3), ("a", 2), ("a", 3), ("a", 2)], "parcel string, class_id int")
    got = {r.parcel: (r.class_id, r.valid_px) for r in PA.majority(px, spark.createDataFrame([("a",), ("b",)], "parcel string"), "parcel").collect()}
    assert got == {"a": (2, 4), "b": (0, 0)}


def test_scoring_follows_numpy(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(10, 4)), rng.normal(size=10))]
    x = rng.normal(size=(5, 3))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, v array<double>")
    got = np.array([r.p for r in M.scored(df, "v", layers, batch=2).orderBy("k").collect()])
    h = np.maximum(x @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1]
    want = np.exp(h - h.max(axis=1, keepdims=True))
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_statistics_guard(spark):
    s = spark.createDataFrame([(0, 1.0, 2.0)], "pos int, mu double, sigma double")
    with pytest.raises(Exception, match="differ from those of training"):
        M.require_same_statistics(s, s.withColumn("mu", F.lit(3.0))).collect()


def test_degree_carry(spark):
    d = spark.createDataFrame([(89.9999,), (-10.5,)], "v double")
    assert [r[0] for r in d.select(N.degree_minute("v", "lon")).collect()] == ["90°00′E", "10°30′W"]


def test_nearest_scene_and_same_day(spark):
    t = dt.datetime(2024, 1, 15)
    o = spark.createDataFrame([(1, 1, "b", t, 5, 0.5), (2, 1, "b", t + dt.timedelta(hours=3), 7, None)], "scene int, pixel int, band string, ts timestamp, dn int, qa double")
    assert R.nearest_scenes(o, "2024-01-15 02:00:00", 1).first().scene == 2
    assert R.same_day_mosaic(o, "2024-01-15").first().dn == 5


def test_analysis_has_all_reports(spark, sf):
    for name, df in change_analysis.reports(table(spark, sf, "class_pair")).items():
        assert df.count() > 0, name


def test_multinomial_draws_keep_row_totals(spark):
    rows = [(run, t, p, 5 * t + p) for run in ("a", "b") for t in range(1, 11) for p in range(1, 11)]
    matrix = spark.createDataFrame(rows, "run_name string, y_true int, y_pred int, n long")
    got = B.multinomial_matrices(matrix, ["run_name"], 60, 42, batch=25).cache()
    assert got.count() == 2 * 60 * 100
    totals = got.groupBy("run_name", "replicate", "y_true").agg(F.sum("n").alias("n")).collect()
    want = {t: sum(5 * t + p for p in range(1, 11)) for t in range(1, 11)}
    assert len(totals) == 1200 and all(r.n == want[r.y_true] for r in totals)
    cells = got.groupBy("y_true", "y_pred", "replicate").agg(F.count_distinct("n").alias("k")).agg(F.avg("k")).first()[0]
    assert cells > 1.5  # the runs have streams of their own
    assert got.select("replicate").distinct().count() == 60


def test_multinomial_areas_of_zones_differ(spark):
    areas = spark.createDataFrame([(z, c, 100) for z in "xyz" for c in range(1, 6)], "zone string, class_id int, n long")
    got = B.multinomial_areas(areas, ["zone"], 200, 42, 1.0).collect()
    assert len({tuple(r.mean for r in got if r.zone == z) for z in "xyz"}) == 3 and all(75 < r.lower < r.mean < r.upper < 125 for r in got)


def test_balanced_draw_has_as_many_rows(spark):
    rows = spark.createDataFrame([(k, 1 if k < 900 else 2 if k < 990 else 3) for k in range(1000)], "sample_id long, class_id int")
    got = S.balanced_draw(rows, 42, ["sample_id"]).cache()
    per = {r.class_id: r["count"] for r in got.groupBy("class_id").count().collect()}
    assert got.count() == 1000 and all(abs(n - 1000 / 3) < 60 for n in per.values())
    assert got.filter("class_id = 3").select("sample_id").distinct().count() == 10  # each often, with replacement
    assert got.join(rows, ["sample_id", "class_id"]).count() == 1000
    assert S.balanced_draw(rows.filter("false"), 1, ["sample_id"]).count() == 0
    n = S.numbered(rows, "class_id", ["sample_id"], per_task=7).groupBy("class_id").agg(F.count_distinct("_place").alias("k"), F.max("_place").alias("top"), F.count("*").alias("n")).collect()
    assert all(r.k == r.n == r.top + 1 for r in n)


def test_history_falls_back_on_the_master_table(spark):
    master = spark.createDataFrame([("/r/run_1", 1), ("/r/run_2", 2), ("/r/run_2", 3)], "run_dir string, epoch int")
    own = spark.createDataFrame([(9,)], "epoch int")
    assert [r.epoch for r in RU.history_of(master, "run_2", own).collect()] == [9]
    assert sorted(r.epoch for r in RU.history_of(master, "run_2", own.filter("false")).collect()) == [2, 3]
    assert RU.history_of(master, "run_2").count() == 2 and RU.history_of(master, "none", own.filter("false")).count() == 0


def test_pixels_of_a_region_come_once(spark):
    p = spark.createDataFrame([(k, float(k), 0.5) for k in range(10)], "k int, x double, y double")
    f = spark.createDataFrame([(1, 0.5, 0.0, 4.5, 1.0), (2, 2.5, 0.0, 6.5, 1.0)], "feature_id int, a double, b double, c double, d double")
    f = f.select("feature_id", V.rectangle("a", "b", "c", "d").alias("rings"))
    assert sorted(r.k for r in V.pixels_in(p, f, 2.0, "left_semi").collect()) == [1, 2, 3, 4, 5, 6]


def test_entry_works_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tokenizers'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 222 and int(out[1]) >= 200


def test_known_indices_are_computed_below_the_filter(spark, sf):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, nan, 2.0), (4, 1.0, inf), (5, 1.0, -inf), (6, 0.0, -3.0), (7, 1.0, None)], "id int, a double, b double")
    assert [r.id for r in P.known(df, {"s": F.col("a") + 0, "t": F.col("b") * 2}).collect()] == [1, 6]
    load()
    plan = QUERIES["p15_known_indices"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("CASE WHEN" in line for line in filters)


def test_standardised_pixels_equal_sql_to_the_sign_of_zero(spark, tmp_path):
    """Values next to the mean, ties, large ones, none, and vectors of other lengths."""
    import duckdb

    from landloom.queries import ORACLES

    load()
    near = [0.125 - k * 2.0**-27 for k in range(40)] + [0.125 + k * 2.0**-27 for k in range(24)]
    odd = [None, float("nan"), float("inf"), -float("inf"), 3e38, -3e38, 1e10, 123456.79, 0.126953125, 0.123046875, -0.0]
    rows = [(0, near, 1), (1, odd, 1), (2, [0.5] * 63, 2), (3, [0.1] * 65, 2), (4, None, 3), (5, [], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = duckdb.connect().execute(ORACLES["p18_standardised"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = QUERIES["p18_standardised"](spark, str(tmp_path)).collect()
    assert {r.sample_id: repr(r.z) for r in got} == {k: repr(z) for k, z in want}
    assert any(repr(v) == "-0.0" for v in dict(want)[0])


def test_raster_files_do_not_grow_with_rows_of_tiles(spark, tmp_path):
    """Each file holds a range of tile rows in order, and no two files of a year share one."""
    rows = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("px_row"), F.lit(3).alias("px_col"), F.when(F.col("id") % 2 == 0, 2017).otherwise(2024).alias("year"), F.col("id").alias("v"))
    T.write_raster(rows, str(tmp_path / "r"), 16)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert back.filter("tile_r <> px_row div 16").count() == 0
    spans = back.groupBy(F.input_file_name().alias("f"), "year").agg(F.min("px_row").alias("lo"), F.max("px_row").alias("hi")).orderBy("year", "lo").collect()
    assert len({s.f for s in spans}) <= 20
    assert all(a.year != b.year or a.hi < b.lo for a, b in zip(spans, spans[1:], strict=False))


def test_features_are_not_broadcast_to_cells(spark, sf):
    load()
    for name in ("g24_burned_labels", "g25_touched_cells"):
        assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def test_sides_are_dealt_before_equal_ones_are_sought(spark, sf):
    load()
    plan = QUERIES["g24_burned_labels"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
