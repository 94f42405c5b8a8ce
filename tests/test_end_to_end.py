"""Stages by command line on synthetic buildings; explanations; the viewer."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from wattloom import api, cli
from wattloom.operators import explain, ingest, scoring


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two buildings over four days, one with a plateau of 11 kW each evening."""
    root = tmp_path_factory.mktemp("store")
    labels = [f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 15, 30, 45)][1:] + ["00:00"]
    load = root / "load"
    load.mkdir()
    for d in range(1, 5):
        lines = [";".join(["MP ID", "OBIS-Code", "Datum", "PLZ", *labels, ""])]
        for mp in ("m1", "m2"):
            kw = [0.4 + (11.0 if mp == "m1" and 72 <= i < 80 else 0.0) + 0.01 * (i % 3) for i in range(96)]
            lines.append(";".join([mp, ingest.IMPORT, f"0{d}.06.2024", "5000", *[f"{k / 4:.4f}".replace(".", ",") for k in kw], ""]))
        (load / f"day{d}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(root / name))
    write([("m1", 1), ("m2", 2)], "mp_id string, gp_nr bigint", "mapping")
    hours = [datetime(2024, 6, 1) + timedelta(hours=h) for h in range(96)]
    write([("5000", t, 20.0, 100.0 * max(0.0, 6 - abs(t.hour - 12)), 0.0) for t in hours], "plz string, ts timestamp_ntz, temperature_2m double, shortwave_radiation double, sunshine_duration double", "weather")
    write([(1, "5000"), (2, "5000")], "gp_nr bigint, plz string", "cohort")
    return root


def test_stages(spark, store):
    at = lambda x: str(store / x)
    assert cli.main(["ingest", "--load", at("load"), "--mapping", at("mapping"), "--out", at("in")]) == 0
    series = spark.read.parquet(at("in/series"))
    assert series.count() == 2 * 4 * 96
    placed = series.join(spark.read.parquet(at("cohort")), "gp_nr")
    placed.write.parquet(at("placed"))
    assert cli.main(["features", "--series", at("placed"), "--weather", at("weather"), "--cohort", at("cohort"), "--out", at("features")]) == 0
    f = {r.gp_nr: r for r in spark.read.parquet(at("features")).collect()}
    assert f[1].count_events_above_11kw == 4 and f[2].session_count == 0 and f[1].n_valid_days == 4 and len(f[1]) >= 60
    assert cli.main(["events", "--series", at("placed"), "--weather", at("weather"), "--out", at("ev")]) == 0
    ev = spark.read.parquet(at("ev/events"))
    assert ev.filter("gp_nr = 1 and type = 'ev_charging'").count() == 4 and ev.filter("gp_nr = 2 and type = 'ev_charging'").count() == 0
    probs = [(1, 0.9, 0.95, 0.1, 0.1), (2, 0.1, 0.1, 0.2, 0.1)]
    spark.createDataFrame(probs, "gp_nr bigint, prob_pv double, prob_ev double, prob_heatpump double, prob_battery double").write.parquet(at("probs"))
    spark.createDataFrame([(1, 1, 1, 0, None), (2, None, None, None, None)], "gp_nr bigint, label_pv int, label_ev int, label_heatpump int, label_battery int").write.parquet(at("labels"))
    spark.createDataFrame([(1, "5000", "Aarau", None), (2, "5000", None, None)], "gp_nr bigint, plz string, city string, canton string").write.parquet(at("buildings"))
    args = ["--events", at("ev"), "--series", at("in/series"), "--buildings", at("buildings"), "--predictions", at("probs"), "--labels", at("labels"), "--out", at("docs"), "--min-types", "1"]
    assert cli.main(["export", *args]) == 0
    view = api.Viewer(spark, at("docs"), at("in/series"))
    assert view.health()["buildings"] == 2 and view.buildings(query="aarau").count() == 1 and view.counts().first().n == 2
    doc = json.loads(view.building("AG-1"))
    assert doc["featured"] and list(doc["predictions"]) == ["pv", "battery", "heatPump", "ev"] and doc["groundTruth"]["heatPump"] is False and doc["groundTruth"]["battery"] is None
    assert len(doc["electricity"]) == 96 and doc["electricity"][0]["timestamp"].endswith("+02:00") and doc["explanation"]["assets"]["ev"]["reasons"][0].startswith("Prediction based on")
    kept = json.loads((store / "docs_selection.json").read_text())
    assert kept == {"featured": [1], "others": [2]}
    (store / "docs_selection.json").write_text('{"featured": [2], "others": []}')
    assert cli.main(["export", *args, "--feature-table", at("features")]) == 0  # the kept selection counts
    only = [json.loads(r.value) for r in spark.read.text(at("docs")).collect()]
    assert [(d["id"], d["featured"]) for d in only] == [("AG-2", True)] and "Only 0.0 high-load sessions per week" in only[0]["explanation"]["assets"]["ev"]["reasons"]
    assert cli.main(["export", *args, "--recurate"]) == 0
    view = api.Viewer(spark, at("docs"), at("in/series"))
    assert '"featured":true' in view.building("AG-1") and view.profile("AG-1", "2024-06-02").count() == 96
    for bad in (lambda: view.building("AG-9"), lambda: view.profile("AG-1", "2020-01-01"), lambda: view.profile("x", "2024-06-02")):
        with pytest.raises(api.Unknown):
            bad()
    assert cli.main(["check-data", "--load", at("load/day1.csv"), "--mapping", at("mapping"), "--weather", at("weather"), "--report", at("report.md")]) == 0
    report = (store / "report.md").read_text()
    assert "## unit" in report and "## ambiguous" in report and "## weather" in report
    assert cli.main(["preview", "--load", at("none")]) == 1


@pytest.mark.parametrize("utc", [True, False])
def test_weather_by_path(spark, tmp_path, utc):
    name, first = ("timestamp_utc", "2024-06-01T10:00:00Z") if utc else ("time", "2024-06-01T12:00")
    rows = [first, first.replace("T10", "T11").replace("T12", "T13")]
    for place in ("5000", "8000"):
        (tmp_path / "in" / place).mkdir(parents=True)
        (tmp_path / "in" / place / "2024-06.csv").write_text(f"{name},temperature_2m,precipitation\n{rows[0]},1.5,2\n{rows[1]},2.5,3\n")
    assert cli.main(["weather", "--load", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    got = sorted((str(r.plz), r.ts.hour, r.temperature_2m, r.precipitation) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(p, h, t, x) for p in ("5000", "8000") for h, t, x in ((12, 1.5, 3.0), (13, 2.5, None))]


def test_a_broken_ingest_goes_on(spark, store, monkeypatch):
    out, write = store / "broken", cli.sinks.write_table
    args = ["ingest", "--load", str(store / "load"), "--mapping", str(store / "mapping"), "--out", str(out)]
    parts = []

    def fails(df, path, **how):
        if len(parts) == 2 and not (store / "load" / "day9.csv").exists():
            (store / "load" / "day9.csv").write_text((store / "load" / "day1.csv").read_text().replace("01.06.2024", "09.06.2024"))  # arrives meanwhile
            raise OSError("broke off")
        parts.append(path)
        write(df, path, **how)

    monkeypatch.setattr(cli.sinks, "write_table", fails)
    with pytest.raises(OSError, match="broke off"):
        cli.main(args)
    assert len(cli.sinks.finished_files(spark, f"{out}/manifest.json", {"load": str(store / "load")})) == 2
    assert cli.main(args) == 0
    (store / "load" / "day9.csv").unlink()
    written = [p for p in parts if "/parts/" in p]
    assert len(written) == len(set(written)) == 5 and spark.read.parquet(str(out / "series")).count() == 2 * 5 * 96


def test_training_chain(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, flags = [], []
    for i in range(240):
        pv, ev, hp, battery = (int(rng.random() < 0.4) for _ in range(4))
        battery = int(battery or (pv and rng.random() < 0.8))
        noise = lambda s=0.25: float(rng.normal() * s)  # noqa: B023, E731
        rows.append((i, 0.3 * pv + noise(0.1), ev + noise(), hp + noise(), 0.4 * battery + noise(), None))
        known = i % 3 != 0
        flags.append((i, *[(x if known else None) for x in (pv, ev, hp, battery)]))
    spark.createDataFrame(rows, "gp_nr bigint, days_with_export_ratio double, b double, c double, d double, empty double").write.parquet(str(tmp_path / "features"))
    names = ("pv", "ev", "heatpump", "battery")
    lab = spark.createDataFrame(flags, "gp_nr bigint, " + ", ".join(f"label_{a} int" for a in names))
    for a in names:
        lab = lab.selectExpr("*", f"cast(null as date) as commissioned_{a}")
    lab.write.parquet(str(tmp_path / "labels"))
    assert cli.main(["train", "--features", str(tmp_path / "features"), "--labels", str(tmp_path / "labels"), "--out", str(tmp_path / "p"), "--folds", "3", "--rounds", "8"]) == 0
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.columns == ["gp_nr", *[f"{k}_{a}" for a in scoring.TRAIN_ORDER for k in ("raw", "prob", "shap")]] and got.count() == 240
    rows = got.collect()
    assert all(0 <= r[f"prob_{a}"] <= 1 and len(r[f"shap_{a}"]) >= 4 for r in rows for a in names)
    m = {(r.asset, r.scorer, r.subset): r for r in spark.read.parquet(str(tmp_path / "p_metrics")).collect()}
    assert len(m) == 4 * 3 * 2 and m["ev", "model", "registry"].roc_auc > 0.9 and m["ev", "model", "all"].n == 240 and m["ev", "model", "registry"].n == 160
    assert m["pv", "baseline", "registry"].roc_auc > 0.6 and m["heatpump", "calibrated", "registry"].brier <= m["heatpump", "baseline", "registry"].brier
    gains = {(r.asset, r.feature): r.gain for r in spark.read.parquet(str(tmp_path / "p_importance")).collect()}
    assert ("battery", scoring.SECOND_STAGE) in gains and not any(f == scoring.SECOND_STAGE for a, f in gains if a != "battery") and not any(f == "empty" for _, f in gains)


def test_entry_without_the_corpus_package(tmp_path):
    """The domain queries stay where that package, or what it needs, can't be imported."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['public_tokenizers'] = None; sys.modules['zstandard'] = None; sys.modules['wattloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert said.returncode == 0 and int(said.stdout.split()[0]) >= 80, said.stderr


def test_contributions_add_up_to_the_log_odds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    rows = [(i, *map(float, r), int(r[0] + r[1] * r[2] > 0), 1.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "gp_nr bigint, a double, b double, c double, label int, weight double")
    model = scoring.train_boosted(df, ["a", "b", "c"], folds=2, rounds=3).model
    leaves = explain.leaves_of(model)
    phi, base = explain.contributions(leaves, x)
    from pyspark.ml.functions import vector_to_array

    raw = {r.gp_nr: r.m for r in model.transform(scoring.vectors(df, ["a", "b", "c"])).select("gp_nr", (2 * vector_to_array("rawPrediction")[1]).alias("m")).collect()}
    assert np.allclose(phi.sum(axis=1) + base, [raw[i] for i in range(200)], atol=1e-9)
    top = explain.explain(df, model, ["a", "b", "c"], top=2).collect()
    assert len(top) == 200 and all(len(r.contributions) == 2 and abs(r.contributions[0].contribution) >= abs(r.contributions[1].contribution) for r in top)
