"""Operators of the load-profile engine on small hand-made inputs with known results."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.config import DetectorConfig, Thresholds
from wattloom.functions import exprs as X
from wattloom.operators import detectors, export, features, ingest, quality, reasons, registry, runs, scoring, weather


def at(day, minutes):
    return datetime.fromisoformat(day) + timedelta(minutes=minutes)


def one(df):
    return df.collect()[0]


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", float: "double", int: "bigint", datetime: "timestamp_ntz"}[type(v)]) for k, v in row.items())))
    return df.select(column.alias("v")).first().v


def test_slots_name_the_end_of_an_interval(spark):
    df = spark.createDataFrame([("00:15",), ("00:00",), ("2:15",), ("24:00",), ("x",)], "s string")
    assert [r.v for r in df.select(X.slot_minutes("s").alias("v")).collect()] == [0, 1425, 120, None, None]


def test_wide_file_to_building_series(spark):
    cols = ["MP ID", "OBIS-Code", "Datum", "PLZ", "00:15", "00:30", "00:00"]
    I, E = ingest.IMPORT, ingest.EXPORT
    rows = [("m1", I, "01.01.2024", "5000", "1.0", "", "0.25"), ("m1", E, "01.01.2024", "5000", "0.25", "0.0", "0.5"), ("m2", I, "01.01.2024", "5000", "0.5", "0.5", ""), ("m2", E, "01.01.2024", "5000", "0", "0", ""), ("excluded", I, "01.01.2024", "5105", "999", "999", "999")]
    wide = spark.createDataFrame(rows, cols)
    mapping = spark.createDataFrame([("m1", 1), ("m2", 1), ("excluded", 2)], "mp_id string, gp_nr bigint")
    out = ingest.ingest(wide, mapping, spark.createDataFrame([(1,)], "gp_nr bigint")).orderBy("ts").collect()
    assert [r.ts for r in out] == [at("2024-01-01", m) for m in (0, 15, 1425)]
    assert [r.net_kw for r in out] == [5.0, None, None] and [r.num_mp_with_data for r in out] == [2, 1, 1]


def test_missing_export_row_is_zero_but_an_empty_cell_is_null(spark):
    r = spark.createDataFrame([("a", 1, "import", 2.0), ("b", 1, "import", 2.0), ("b", 1, "export", None), ("c", 1, "export", 1.0)], "mp_id string, ts int, channel string, kw double")
    got = {x.mp_id: (x.import_kw, x.export_kw, x.net_kw) for x in ingest.pivot_channels(r, ["mp_id", "ts"]).collect()}
    assert got == {"a": (2.0, 0.0, 2.0), "b": (2.0, None, None), "c": (None, 1.0, None)}


def test_numbers_marks_and_keys(spark):
    assert value(spark, X.decimal("s", 4), s=" 1,5 ") == 6.0 and value(spark, X.decimal("s"), s="x") is None and value(spark, X.decimal("s"), s="nan") is None
    assert [value(spark, X.mark_to_flag("s"), s=s) for s in (" X", "-", "?", "")] == [1, 0, None, None]
    assert value(spark, X.clean_key("s"), s=" 0500001.0") == "500001" and value(spark, X.first_digits("s"), s="GP 42 b") == 42
    assert [value(spark, X.percent("p"), p=p) for p in (0.125, 0.375, -1.0, 2.0)] == [12, 38, 0, 100]
    assert [value(spark, X.confidence_label("p"), p=p) for p in (80.0, 50.0, 49.9, float("nan"))] == ["Likely", "Possible", "Unlikely", "Unlikely"]
    assert value(spark, X.clip("p", 0.0, 1.0), p=3.0) == 1.0


def test_local_time_with_offset(spark):
    got = [value(spark, X.local_iso("t"), t=datetime.fromisoformat(t)) for t in ("2024-03-31 00:00", "2024-03-31 02:15", "2024-03-31 12:00", "2024-12-01 00:00")]
    assert got == ["2024-03-31T00:00:00+01:00", "2024-03-31T02:15:00+01:00", "2024-03-31T12:00:00+02:00", "2024-12-01T00:00:00+01:00"]


def test_quantile_is_the_nearest_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)] + [(None,)], "x double")
    assert one(df.agg(X.quantile_nearest("x", 0.95).alias("q"))).q == 11.0 and one(df.agg(X.quantile_nearest("x", 0.25).alias("q"))).q == 4.0
    assert one(df.filter("x is null").agg(X.quantile_nearest("x", 0.5).alias("q"))).q is None


def test_correlation_needs_rows_and_variance(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(40)], "a double, b double, c double")
    r = one(df.agg(X.safe_corr("a", "b").alias("x"), X.safe_corr("a", "c").alias("y"), X.safe_corr("a", "b", F.col("a") < 29).alias("z")))
    assert abs(r.x - 1) < 1e-12 and r.y is None and r.z is None


def mask(spark, bits):
    return spark.createDataFrame([(1, at("2024-01-01", 15 * i), int(b)) for i, b in enumerate(bits)], "gp_nr bigint, ts timestamp_ntz, b int")


def test_runs_and_merged_runs(spark):
    df = runs.with_index(mask(spark, "01100100011"), ["gp_nr"], "ts")
    found = runs.index_runs(df, F.col("b") == 1, ["gp_nr"], "i")
    assert sorted((r.s, r.e) for r in found.collect()) == [(1, 3), (5, 6), (9, 11)]
    assert sorted((r.s, r.e) for r in runs.merge_runs(found, ["gp_nr"], 2).collect()) == [(1, 6), (9, 11)]


def test_runs_end_at_gaps_and_changes(spark):
    df = mask(spark, "1111").filter("ts <> timestamp_ntz'2024-01-01 00:30:00'")
    out = runs.add_runs(df, F.col("b") == 1, ["gp_nr"], "ts", 15).orderBy("ts").collect()
    assert [r.run_id for r in out] == [1, 1, 2] and [r.run_len for r in out] == [2, 2, 1]
    ramped = df.withColumn("x", F.minute("ts").cast("double"))
    assert [r.r for r in ramped.withColumn("r", runs.ramp("x", ["gp_nr"], "ts", 15)).orderBy("ts").collect()] == [None, 15.0, None]


def test_labels_fold_and_train(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "-"), (2, "-"), (2, ""), (3, "")], "gp_nr bigint, PV string")
    assert {r.gp_nr: r.label_pv for r in registry.fold_labels(rows, {"label_pv": "PV"}).collect()} == {1: 1, 2: 0, 3: None}
    flags = spark.createDataFrame([(1, 1, None, None), (2, 1, None, date(2025, 8, 1)), (3, 0, None, None), (4, None, 1, None), (5, None, None, None), (6, 1, 0, date(2025, 7, 1))], "gp_nr bigint, label_pv int, label_ev int, commissioned_pv date")
    got = {r.gp_nr: (r.label, r.weight, r.source) for r in registry.training_labels(flags, "pv", others=["pv", "ev"]).collect()}
    assert got == {1: (1, 1.0, "registry"), 3: (0, 1.0, "registry"), 5: (0, 0.5, "unlabeled"), 6: (1, 1.0, "registry")}


def test_cohort(spark):
    mapping = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "gp_nr bigint")
    labels = spark.createDataFrame([(1, "5000", 1), (2, None, None), (9, "5001", 0)], "gp_nr bigint, plz string, label_pv int")
    got = ingest.select_cohort(mapping, labels, extra=1, forced=[4]).collect()
    assert {r.gp_nr for r in got if r.is_labeled} == {1} and 4 in {r.gp_nr for r in got} and len(got) in (2, 3)
    assert {r.gp_nr for r in ingest.select_cohort(mapping, labels, labelled_only=True).collect()} == {1}


def test_weather_relabel_and_clock_changes(spark):
    df = spark.createDataFrame([("5000", at("2024-01-01", 60 * i), float(10 * i)) for i in range(6) if i != 4], "plz string, ts timestamp_ntz, r double")
    by_row = [r.r for r in weather.relabel_by_row(df, ["r"]).orderBy("ts").collect()]
    by_time = [r.r for r in weather.relabel_by_time(df, ["r"]).orderBy("ts").collect()]
    assert by_row == [10.0, 20.0, 30.0, 50.0, 50.0] and by_time == [10.0, 20.0, 30.0, None, None]
    utc = spark.createDataFrame([("5000", datetime(2024, 10, 26, 23) + timedelta(hours=i), i) for i in range(4)], "plz string, utc timestamp_ntz, x int")
    local = weather.to_local(utc.withColumn("ts", F.col("utc")), "ts")
    kept = weather.first_per_hour(local, ["plz", "ts"], "utc").orderBy("ts").collect()
    assert [r.ts.hour for r in kept] == [1, 2, 3] and [r.x for r in kept] == [0, 1, 3]


def test_upsampling(spark):
    df = spark.createDataFrame([("p", at("2024-01-01", 0), 0.0, 100.0), ("p", at("2024-01-01", 60), 4.0, 200.0)], "plz string, ts timestamp_ntz, t double, r double")
    out = weather.fill_grid(df, 15, ["r"], ["t"]).orderBy("ts").collect()
    assert [r.t for r in out] == [0, 1, 2, 3, 4] and [r.r for r in out] == [100, 100, 100, 100, 200]


def test_valid_days(spark):
    rows = [(1, at(f"2024-01-0{d}", 15 * i), 1.0 if i < n else None) for d, n in ((1, 96), (2, 90), (3, 89), (4, 0)) for i in range(96)]
    out = one(features.day_features(spark.createDataFrame(rows, "gp_nr bigint, ts timestamp_ntz, net_kw double")))
    assert out.n_valid_days == 2 and out.days_with_export_ratio == 0.0


def test_sessions_and_their_features(spark):
    kw = [0, 4, 4, 0, 5, 0, 3, 3, 3]
    s = spark.createDataFrame([(1, at("2024-01-01", 15 * i), float(k)) for i, k in enumerate(kw)] + [(2, at("2024-01-01", 0), 1.0)], "gp_nr bigint, ts timestamp_ntz, net_kw double")
    found = features.sessions(s)
    assert sorted((r.start_timestamp.minute, r.duration_minutes, r.energy_kwh) for r in found.collect()) == [(15, 30, 2.0), (30, 45, 2.25)]
    out = {r.gp_nr: r for r in features.session_features(found, features.spans(s)).collect()}
    assert out[1].session_count == 2 and out[1].session_mean == 3.5 and out[2].session_count == 0 and out[2].sessions_per_week == 0.0 and out[2].session_mean is None


def day_series(spark, import_kw, **more):
    cols = {"export_kw": 0.0, "net_kw": None, "quality": "ok", "shortwave_radiation": None, "temperature_2m": None, "is_sunny_day": True} | more
    rows = []
    for i, k in enumerate(import_kw):
        v = {c: (x[i] if isinstance(x, list) else x) for c, x in cols.items()}
        rows.append((1, at(more.get("day", "2024-06-01"), 15 * i), float(k), v["export_kw"], k - v["export_kw"] if v["net_kw"] is None else v["net_kw"], v["quality"], v["shortwave_radiation"], v["temperature_2m"], v["is_sunny_day"]))
    return spark.createDataFrame(rows, "gp_nr bigint, ts timestamp_ntz, import_kw double, export_kw double, net_kw double, quality string, shortwave_radiation double, temperature_2m double, is_sunny_day boolean")


def test_high_load_band_gives_way_to_other_events(spark):
    load = [0.4] * 96
    load[72:80], load[30:33] = [3.0] * 8, [2.0] * 3
    s = day_series(spark, load)
    nothing = spark.createDataFrame([], "gp_nr bigint, start timestamp_ntz, end timestamp_ntz")
    r = one(detectors.high_consumption(s, nothing))
    assert (r.start, r.end, r.peak_kw, r.energy_kwh) == (at("2024-06-01", 1080), at("2024-06-01", 1200), 3.0, 6.0)
    claimed = spark.createDataFrame([(1, at("2024-06-01", 1140), at("2024-06-01", 1260))], "gp_nr bigint, start timestamp_ntz, end timestamp_ntz")
    assert detectors.high_consumption(s, claimed).count() == 0


def test_charging_is_found_with_its_power(spark):
    load = [0.5] * 96
    load[40:48] = [11.5] * 8
    r = one(detectors.ev_charging(day_series(spark, load)))
    assert (r.start, r.end) == (at("2024-06-01", 600), at("2024-06-01", 720)) and abs(r.peak_kw - 11) < 0.01 and r.confidence > 0.95


def test_generation_heating_and_battery(spark):
    sun = [0.0] * 24 + [10.0 * i for i in range(24)] + [10.0 * (24 - i) for i in range(24)] + [0.0] * 24
    out = [x / 100 for x in sun]
    r = one(detectors.pv_export_days(day_series(spark, [0.2] * 96, export_kw=out, shortwave_radiation=sun)))
    assert r.confidence == 0.9 and r.peak_kw == 2.4
    winter = [0.5 + 2.0 * ((i // 2) % 2) for i in range(96)]
    h = one(detectors.heating_days(day_series(spark, winter, day="2024-01-10", temperature_2m=[5.0 - k for k in winter])))
    assert h.type == "heat_pump_heating" and h.confidence == 0.9
    block = lambda a, b: detectors.heating_days(day_series(spark, [2.0 if a <= i < b else 0.1 for i in range(96)], day="2024-01-10", temperature_2m=[0.0] * 96)).count()
    assert block(8, 60) == 0 and block(17, 39) == 1 and block(15, 39) == 0 and block(17, 42) == 0  # a run counts only if it lies in the morning as a whole
    idle = [0.0 if 28 <= i < 40 or 70 <= i < 80 else 1.0 for i in range(96)]
    b = detectors.battery_cycles(day_series(spark, idle, export_kw=[0.5 if i == 48 else 0.0 for i in range(96)], net_kw=idle, shortwave_radiation=sun)).collect()
    assert len(b) == 2 and {x.confidence for x in b} == {0.8}


def test_dips_and_showcase(spark):
    load = [1.0 if i < 36 or i >= 60 else 0.1 for i in range(96)]
    s = day_series(spark, load)
    d = one(detectors.pv_dip_windows(s))
    assert (d.start, d.end, d.confidence) == (at("2024-06-01", 540), at("2024-06-01", 900), 0.5)
    ev = spark.createDataFrame([(1, "a", at("2024-06-01", 60), 0.7), (1, "b", at("2024-06-01", 90), 0.6), (1, "a", at("2024-06-02", 0), 0.9), (1, "c", at("2024-06-03", 0), 0.5), (1, "c", at("2024-06-03", 0), 0.5)], "gp_nr bigint, type string, start timestamp_ntz, confidence double")
    r = one(detectors.showcase(ev, s))
    assert (r.showcase_date, r.n_event_types) == (date(2024, 6, 1), 2)
    empty = one(detectors.showcase(ev.limit(0), s))
    assert (empty.showcase_date, empty.n_event_types) == (date(2024, 6, 1), 0)


def test_day_grid_events_and_documents(spark):
    s = spark.createDataFrame([(1, at("2024-03-31", 0), 1.5)], "gp_nr bigint, ts timestamp_ntz, net_kw double")
    days = spark.createDataFrame([(1, date(2024, 3, 31))], "gp_nr bigint, day date")
    grid = export.day_grid(s, days).orderBy("i").collect()
    assert len(grid) == 96 and grid[0].net_kw == 1.5 and {r.net_kw for r in grid[1:]} == {0.0}
    starts = [-30, 10, 20, 30, 40, 50, 60, 70, 80, 90, 1430, -400]
    ev = spark.createDataFrame([(1, "t", at("2024-03-31", m), at("2024-03-31", m + 60), 0.5) for m in starts], "gp_nr bigint, type string, start timestamp_ntz, end timestamp_ntz, confidence double")
    shown = export.day_events(ev, days).orderBy("rank").collect()
    assert len(shown) == 8 and shown[0].start == at("2024-03-30", 1410)
    truth = spark.createDataFrame([(1, 1, 0, None, None), (2, None, None, None, None)], "gp_nr bigint, label_pv int, label_ev int, label_heatpump int, label_battery int")
    got = {r.gp_nr: r.groundTruth for r in export.ground_truth(truth).collect()}
    assert got[2] is None and got[1].pv is True and got[1].ev is False and got[1].heatpump is None


def test_bands_search_boxes_and_round_robin(spark):
    ev = spark.createDataFrame([(1, -30, 60), (2, 1400, 1500), (3, 0, 2000), (4, 5, 5), (5, 1500, 1600), (6, 100, 1600), (7, -200, -10), (8, -10, 1440)], "k int, s int, e int")
    assert sorted((r.k, r.a, r.b) for r in export.fold_bands(ev).collect()) == [(1, 0, 60), (1, 1410, 1440), (2, 0, 60), (2, 1400, 1440), (3, 0, 1440), (6, 0, 160), (6, 100, 1440), (8, 0, 1440)]
    places = spark.createDataFrame([("Zürich", "8000"), ("Genève", "1200")], "city string, plz string")
    assert [r.city for r in export.search(places, "zuri 80", ["city", "plz"]).collect()] == ["Zürich"] and export.search(places, "", ["city"]).count() == 2
    areas = spark.createDataFrame([("a", [[[1.0, 2.0], [3.0, 0.5]]])], "k string, coordinates array<array<array<double>>>")
    assert tuple(one(export.ring_boxes(areas, "k")))[1:] == (1.0, 0.5, 3.0, 2.0)
    r = spark.createDataFrame([(1, "a", 9), (2, "a", 8), (3, "b", 1)], "gp_nr bigint, plz string, s int")
    assert [x.gp_nr for x in export.round_robin(r, "plz", [F.desc("s")], 2).collect()] == [1, 3]
    r = spark.createDataFrame([(1, "a", 9), (2, "a", 2), (3, "b", 5), (4, "b", 4), (5, None, 1)], "gp_nr bigint, plz string, s int")
    assert [x.gp_nr for x in export.round_robin(r, "plz", [F.desc("s")], 5).collect()] == [1, 3, 5, 2, 4]  # groups keep their order in later turns


def test_featured_ranks_by_sure_and_right_assets(spark):
    preds = spark.createDataFrame([(1, 0.9, 0.9, 0.6, 0.6), (2, 0.85, 0.85, 0.85, 0.1), (3, 0.9, 0.1, 0.1, 0.1)], "gp_nr bigint, prob_pv double, prob_ev double, prob_heatpump double, prob_battery double")
    labels = spark.createDataFrame([(k, 1, 1, 1, 1) for k in (1, 2, 3)], "gp_nr bigint, label_pv int, label_ev int, label_heatpump int, label_battery int")
    kinds = spark.createDataFrame([(k, 3) for k in (1, 2, 3)], "gp_nr bigint, n_event_types int")
    meters = spark.createDataFrame([(k, 1) for k in (1, 2, 3)], "gp_nr bigint, num_mp_ids int")
    rows = export.featured_candidates(preds, labels, kinds, meters).orderBy(F.desc("agree"), F.desc("total")).collect()
    assert [(r.gp_nr, r.agree) for r in rows] == [(2, 3), (1, 2)]


def test_overlaps_are_met_by_the_day(spark):
    ev = spark.createDataFrame([(1, at("2024-01-01", 0), at("2024-01-01", 60)), (1, at("2024-01-01", 23 * 60), at("2024-01-02", 60)), (1, at("2024-01-05", 0), at("2024-01-05", 15)), (2, at("2024-01-01", 0), at("2024-01-01", 60))], "gp_nr bigint, start timestamp_ntz, end timestamp_ntz").withColumnRenamed("end", "end")
    claims = spark.createDataFrame([(1, at("2024-01-01", 60), at("2024-01-01", 90)), (1, at("2024-01-02", 30), at("2024-01-04", 0)), (1, at("2024-01-05", 5), at("2024-01-05", 5))], "gp_nr bigint, start timestamp_ntz, end timestamp_ntz")
    assert sorted((r.gp_nr, r.start) for r in detectors.not_overlapping(ev, claims).collect()) == [(1, at("2024-01-01", 0)), (2, at("2024-01-01", 0))]


def test_folds_deal_each_class_evenly(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = scoring.stratified_folds(df, "y", 5, "k").groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in rows if r.y == 1) == [66, 67, 67, 67, 67] and sorted(r["count"] for r in rows if r.y == 0) == [133, 133, 133, 133, 134]


def test_rule_baselines(spark):
    f = spark.createDataFrame([(1, 0.06, None, 0.2), (2, 0.05, -0.5, 0.2), (3, None, None, None)], "gp_nr bigint, days_with_export_ratio double, correlation_solar_radiation_consumption double, evening_near_zero_ratio double").withColumns({"sunny_day_midday_mean": F.lit(1.0), "cloudy_day_midday_mean": F.lit(2.0)})
    got = {r.gp_nr: (r.base_pv, r.base_battery, r.base_heat_pump, r.base_ev) for r in scoring.baseline_scores(f).collect()}
    assert got == {1: (0.9, 0.7, 0.15, 0.15), 2: (0.7, 0.1, 0.15, 0.15), 3: (0.2, 0.1, 0.15, 0.15)}
    full = f.withColumns({"sessions_per_week": F.lit(1), "session_median": F.lit(3), "winter_night_mean_consumption": F.lit(2.1), "summer_night_mean_consumption": F.lit(1.0), "correlation_outside_temperature_consumption": F.lit(-0.31)})
    assert {(r.base_heat_pump, r.base_ev) for r in scoring.baseline_scores(full).collect()} == {(0.8, 0.85)}


def test_calibration_takes_registry_rows_and_falls_back(spark):
    rows = [(0.2, 0, 1.0, "registry"), (0.8, 1, 1.0, "registry"), *[(0.8, 0, 1.0, "unlabeled")] * 9]
    df = spark.createDataFrame(rows, "score double, label int, weight double, source string")
    top = lambda model: max(r.prob for r in scoring.calibrated(model, df).collect())
    assert top(scoring.calibrate(df, source="source")) == 1.0 and top(scoring.calibrate(df)) < 0.2
    assert top(scoring.calibrate(df.filter("score = 0.8 or source = 'unlabeled'"), source="source")) < 0.2  # one label in the registry: all rows
    assert sorted({round(r.prob, 9) for r in scoring.calibrated(scoring.calibrate(df.filter("label = 0")), df).collect()}) == [0.2, 0.8]  # one label at all: the score


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([("g", 0.9, 1, 1), ("g", 0.5, 0, 1), ("g", 0.5, 1, 1), ("g", 0.1, 0, 1)], "k string, score double, y int, w int")
    assert one(scoring.roc_auc(df, ["k"])).roc_auc == 0.875
    assert abs(one(scoring.average_precision(df, ["k"])).average_precision - (0.5 + 0.5 * 2 / 3)) < 1e-12
    m = one(scoring.threshold_metrics(df, ["k"]))
    assert m.precision_50 == 2 / 3 and m.recall_80 == 0.5 and abs(m.brier - (0.01 + 0.25 + 0.25 + 0.01) / 4) < 1e-12
    assert one(scoring.roc_auc(df.filter("y = 1"), ["k"])).roc_auc is None


def test_boosted_trees_tell_an_easy_class(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i), int(i % 7 > 3), 1.0) for i in range(140)]
    df = spark.createDataFrame(rows, "gp_nr bigint, a double, b double, label int, weight double")
    assert scoring.usable_features(df.withColumn("none", F.lit(None).cast("double")), ["gp_nr", "label", "weight"]) == ["a", "b"]
    fitted = scoring.train_boosted(df, ["a", "b"], folds=2, rounds=3)
    oof, model = fitted.oof, fitted.model
    assert one(scoring.roc_auc(oof.withColumnsRenamed({"label": "y", "weight": "w"}).withColumn("k", F.lit(1)), ["k"])).roc_auc > 0.95
    assert scoring.importance(model, ["a", "b"])[0][0] == "a"
    p = [r.prob for r in scoring.calibrated(scoring.calibrate(oof), oof).orderBy("score").collect()]
    assert p == sorted(p)


def test_quality(spark):
    df = spark.createDataFrame([("31.12.2024", "ja"), ("01.01.2024", "nein"), ("bad", " X ")], "d string, m string")
    r = one(quality.best_date_format(df, "d"))
    assert (r.format, r.n_parsed, r.first) == ("dd.MM.yyyy", 2, date(2024, 1, 1))
    assert [(r.column, r.n) for r in quality.yes_counts(df.withColumn("one", F.lit(1)), ["m", "d", "one"]).collect()] == [("m", 2)]
    assert tuple(one(quality.best_date_format(spark.createDataFrame([("31.12.98",), ("01.02.24",), ("2024-01-01",)], "d string"), "d"))) == ("dd.MM.yy", 2, date(1998, 12, 31), date(2024, 2, 1))
    assert one(quality.best_date_format(spark.createDataFrame([("31.12.2024 23:59:59",)], "d string"), "d")).format == "dd.MM.yyyy HH:mm:ss" and one(quality.best_date_format(spark.createDataFrame([("x",)], "d string"), "d")).format is None
    units = [one(quality.unit_guess(spark.createDataFrame([(float(x),) for x in v], "s double"), "s")).unit for v in ((10, 20), (30, 51), (39, 40))]
    assert units == ["kwh_per_15min", "kw", "kwh_per_15min"] and one(quality.unit_guess(spark.createDataFrame([], "s double"), "s")).unit == "kw"
    assert [tuple(r) for r in registry.explode_keys(spark.createDataFrame([("500001 / 500002",), ("12",)], "c string"), "c", 6).orderBy("key").collect()] == [("12", None), ("500001 / 500002", 500001), ("500001 / 500002", 500002)]
    gaps = spark.createDataFrame([("p", at("2024-01-01", m)) for m in (0, 0, 60, 180)], "plz string, ts timestamp_ntz")
    assert tuple(one(weather.gap_report(gaps)))[1:] == (4, 1, 1)


@pytest.mark.parametrize("kind", [features.all_features])
def test_feature_table_has_all_features(spark, kind):
    assert len(kind(Thresholds())) + len(["days_with_export_ratio"]) + 15 >= 60
    assert DetectorConfig().ev_window == 32


def test_local_times_that_are_twice_or_never_there(spark):
    df = spark.createDataFrame([(at("2024-03-31", 150),), (at("2024-10-27", 150),), (at("2024-07-01", 0),)], "t timestamp_ntz")
    assert [r.u for r in df.select(X.local_to_utc("t").alias("u")).collect()] == [None, at("2024-10-27", 30), at("2024-06-30", 22 * 60)]


def test_reasons_and_formats(spark):
    say = lambda asset, prob, **f: value(spark, F.array_join(reasons.reasons(asset, {k: F.col(k) for k in f}, F.lit(prob)), "|"), **f)
    assert say("pv", 0.5, days_with_export_ratio=0.125) == "12% of days feed power back to the grid"
    assert say("pv", 0.2, correlation_solar_radiation_consumption=-0.001) == "Midday net load does not follow solar radiation (r = -0.00)|No midday reduction in net load"
    assert say("heatpump", 0.9, winter_night_mean_consumption=1.0, summer_night_mean_consumption=0.0) == "Consumption pattern is consistent with a heat pump"
    assert say("battery", 0.9, near_zero_interval_ratio=float("nan")) == "Consumption pattern is consistent with a battery"
    assert say("ev", 0.9, evening_start_ratio=0.5, night_start_ratio=0.25) == "75% of sessions start in the evening or at night"


def test_documents_are_checked(spark):
    good = '{"id":"AG-1","postcode":"5000","city":"Aarau","canton":"AG","predictions":{"pv":1,"battery":2,"heatPump":3,"ev":100},"electricity":[],"events":[{"type":"ev_charging","start":"a","end":"b","confidence":null}],"explanation":{"model":"m"},"featured":true}'
    bad = {2: good.replace('"ev":100', '"ev":101'), 3: good.replace("ev_charging", "other"), 4: good.replace("null", "1.5"), 5: good.replace('"city":"Aarau",', ""), 6: good[:-1] + ',"more":1}', 7: "no json"}
    rows = spark.createDataFrame([(1, good), *bad.items()], "gp_nr bigint, document string")
    found = {}
    for r in export.document_violations(rows).collect():
        found.setdefault(r.gp_nr, []).append(r.problem)
    assert found.pop(7) and found == {2: ["ev is no percent"], 3: ["unknown kind of event"], 4: ["confidence out of range"], 5: ["city is missing"], 6: ["unknown field"]}


def test_settings_and_overrides():
    from wattloom.config import Config, config_from, settings_from

    s = settings_from({"WATTLOOM_DATA_DIR": "/d", "wattloom_store_dir": "/s", "WATTLOOM_WEATHER_DIR": "", "DATA_DIR": "x"})
    assert (s.data_dir, s.store_dir, s.weather_dir, s.registry_root) == ("/d", "/s", "data/weather", "/d")
    c = config_from('{"events": {"ev_run": 5, "hp_hours": [3, 9]}}')
    assert (c.events.ev_run, c.events.hp_hours, c.features) == (5, (3, 9), Config().features) and config_from() == Config()
    for text in ('{"other": {}}', '{"events": {"nothing": 1}}'):
        with pytest.raises(ValueError, match="unknown"):
            config_from(text)


def test_unknown_strategy_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        ingest.sum_meters(spark.range(1), spark.range(1), strategy="mean")


def test_wide_files_come_back(spark):
    long = spark.createDataFrame([("m", at("2024-01-01", 15 * i), float(i)) for i in range(96)], "mp_id string, ts timestamp_ntz, value double")
    wide = ingest.to_wide(long, ["mp_id"])
    assert wide.columns[2:4] == ["00:15", "00:30"] and wide.columns[-1] == "00:00"
    back = ingest.unpivot_slots(wide, ["mp_id"], "day")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
