"""Command line: python -m wattloom.cli STAGE ...; exit code 1 where an input is missing."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.config import INTERVAL_END
from wattloom.functions import exprs as X
from wattloom.operators import detectors, export, features, ingest, quality, registry, scoring, weather
from wattloom.session import local_session, settled
from wattloom.sources import files, sinks

ASSETS = ("pv", "ev", "heatpump", "battery")


def run_ingest(spark, a) -> None:
    """Wide files and a meter mapping (mp_id, gp_nr) to the series.

    Every file has a part of its own and, once that is written, an entry in the manifest; so a run that broke off
    goes on with the files that are left, and a file that arrives meanwhile is left for the next run.  Files done
    before keep their entries.
    """
    config, at = {"load": a.load}, f"{a.out}/manifest.json"
    mapping = spark.read.parquet(a.mapping)
    done = sinks.finished_files(spark, at, config)
    todo = sinks.check_resume(spark, at, config, files.list_files(spark, a.load))[: a.limit_files]
    for path, size, time in todo:
        part = ingest.ingest(files.read_delimited(spark, path), mapping)
        sinks.write_table(part, f"{a.out}/parts/source={sinks.config_hash({'path': path})[:16]}")
        done = [f for f in done if f[0] != path] + [(path, size, time)]
        sinks.write_manifest(spark, at, "ingest", config, {"files": len(done)}, done)
    sinks.write_table(ingest.resum_parts(spark.read.parquet(f"{a.out}/parts")), f"{a.out}/series", sort=["gp_nr", "ts"])


def run_weather(spark, a) -> None:
    """Hourly files to local interval starts by place.  The place is a column or comes from the path; times are UTC
    (timestamp_utc) or local already (time)."""
    found = files.list_files(spark, a.load)
    raw = files.read_delimited(spark, a.load, files.sniff(files.first_line(spark, found[0][0])))
    place, utc = files.find_column(raw.columns, "PLZ"), files.find_column(raw.columns, "timestamp_utc")
    time = utc or files.find_column(raw.columns, "time")
    cols = [c for c in raw.columns if c not in (place, time)]
    parsed = raw.select((F.col(place) if place else files.place_from_path()).alias("plz"), F.try_to_timestamp(F.col(time)).cast("timestamp_ntz").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in cols])
    parsed = parsed.filter("plz is not null and ts is not null").withColumn("utc", F.col("ts"))
    local = weather.first_per_hour(weather.to_local(parsed, "ts") if utc else parsed, ["plz", "ts"], "utc").drop("utc")
    sinks.write_table(weather.relabel_by_time(local, [c for c in cols if c in INTERVAL_END]), a.out, by=["plz"], sort=["ts"])


def run_features(spark, a) -> None:
    series, wx = spark.read.parquet(a.series), spark.read.parquet(a.weather)
    days = weather.sun_class(weather.daily_sum(wx, "shortwave_radiation").withColumn("month", F.month("day")), ["plz", "month"])
    cohort = spark.read.parquet(a.cohort)
    placed = series.drop("plz").join(cohort.select("gp_nr", "plz"), "gp_nr")
    joined = weather.join_days(weather.join_hourly(placed, wx, ["temperature_2m", "shortwave_radiation", "sunshine_duration"]), days)
    sinks.write_table(features.feature_table(joined.drop("plz"), cohort, spark.read.parquet(a.labels) if a.labels else None), a.out)


def run_events(spark, a) -> None:
    series, wx = ingest.detector_series(spark.read.parquet(a.series)), spark.read.parquet(a.weather)
    days = weather.sun_class(weather.daily_sum(wx, "shortwave_radiation").withColumn("year", F.year("day")), ["plz", "year"])
    joined = weather.join_days(weather.join_hourly(series, wx, ["temperature_2m", "shortwave_radiation"]), days)
    sinks.write_table(detectors.detect(joined), f"{a.out}/events")
    sinks.write_table(detectors.showcase(spark.read.parquet(f"{a.out}/events"), joined), f"{a.out}/showcase")


def run_train(spark, a) -> None:
    """Predictions at ``out``; metrics and importances in tables beside it."""
    table, flags = spark.read.parquet(a.features), spark.read.parquet(a.labels)
    known = [x for x in ASSETS if f"label_{x}" in flags.columns]
    names = scoring.usable_features(table, ["gp_nr", *[c for c in table.columns if c.startswith("label_")]])
    labels = reduce(DataFrame.unionByName, [registry.training_labels(flags, x, others=known) for x in known])
    if a.show_labels:
        registry.label_counts(labels).show()
    predictions, metrics, gains = scoring.train_assets(table, labels, names, folds=a.folds, rounds=a.rounds)
    sinks.write_table(predictions, a.out)
    sinks.write_table(metrics, f"{a.out}_metrics")
    sinks.write_table(gains, f"{a.out}_importance")


def run_export(spark, a) -> None:
    events, series, shown = spark.read.parquet(f"{a.events}/events"), spark.read.parquet(a.series), spark.read.parquet(f"{a.events}/showcase")
    days = shown.select("gp_nr", F.col("showcase_date").alias("day"))
    buildings, probs = spark.read.parquet(a.buildings), spark.read.parquet(a.predictions)
    labels = spark.read.parquet(a.labels)
    table = spark.read.parquet(a.feature_table) if a.feature_table else None
    kept = None if a.recurate else export.pinned(sinks.get_text(spark, f"{a.out}_selection.json"))
    if kept is None:
        meters = series.groupBy("gp_nr").agg(F.max("num_mp_with_data").alias("num_mp_ids"))
        ranked = export.featured_candidates(probs, labels, shown.select("gp_nr", "n_event_types"), meters, a.min_types).join(buildings.select("gp_nr", "plz"), "gp_nr")
        # both lists are bounded by --featured and --others
        best = export.round_robin(ranked, "plz", [F.desc("agree"), F.desc("total"), F.col("gp_nr")], a.featured).select("gp_nr", "plz").collect()
        if len(best) < a.featured or len({r.plz for r in best}) < a.min_plz:
            print(f"featured: {len(best)} of {a.featured}, over {len({r.plz for r in best})} places ({a.min_plz} wanted)", file=sys.stderr)
        taken = spark.createDataFrame([(r.gp_nr,) for r in best], "gp_nr bigint")
        kept = [r.gp_nr for r in best], [r.gp_nr for r in export.sample_others(buildings, taken, a.others).collect()]
        sinks.put_text(spark, f"{a.out}_selection.json", export.selection_text(*kept))
    featured, chosen = (spark.createDataFrame([(k,) for k in keys], "gp_nr bigint") for keys in (kept[0], kept[0] + kept[1]))
    shown_events = export.day_events(events, days)
    docs = settled(export.documents(buildings.join(chosen, "gp_nr", "left_semi"), probs, export.day_grid(series, days), shown_events, export.ground_truth(labels), featured, table), "documents")
    wrong = export.document_violations(docs).head(5)
    if wrong:
        raise ValueError(f"documents break the schema: {wrong}")
    sinks.write_documents(docs, a.out)


def run_check(spark, a) -> None:
    """The quality report: columns, channels and the unit of the load files; of a registry the dates, marks and empty
    cells; of a mapping the meters that lead nowhere or to several buildings; of weather the gaps."""
    df = files.read_delimited(spark, a.load)
    slots = ingest.slot_columns(df)
    parts = {"columns": quality.null_profile(df)}
    find = lambda *names: files.find_column(df.columns, *names)
    if slots:
        parts["channels"] = quality.file_profile(df, find("OBIS-Code"), find("Datum"), slots, find("PLZ"))
        imported = df.filter(F.col(f"`{find('OBIS-Code')}`") == ingest.IMPORT)
        parts["unit"] = quality.unit_guess(imported.select(X.total_of([X.decimal(f"`{c}`") for c in slots]).alias("total")), "total")
        parts["clock_forward"] = df.filter(F.array_contains(quality.dst_days(), F.try_to_date(F.col(f"`{find('Datum')}`"), "dd.MM.yyyy"))).agg(F.count(F.lit(1)).alias("n_rows"))
    if a.registry:
        reg = files.read_delimited(spark, a.registry)
        parts |= {"registry": quality.null_profile(reg), "marks": quality.yes_counts(reg, reg.columns)}
        parts |= {f"dates of {c}": quality.best_date_format(reg, c) for c in reg.columns if "datum" in c.lower()}
    if a.mapping and slots:
        mapping = spark.read.parquet(a.mapping)
        meters = df.select(F.trim(F.col(f"`{find('MP ID')}`")).alias("mp_id"))
        n = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"))
        parts |= {"meters": n(files.distinct_keys(meters, "mp_id")), "unmapped": n(registry.unmapped(meters, mapping.select("mp_id").distinct())), "ambiguous": n(registry.ambiguous(mapping))}
    if a.weather:
        parts["weather"] = weather.gap_report(spark.read.parquet(a.weather))
    sections: dict[str, list] = {}
    for r in quality.report(parts).collect():
        print(r.section, r.row)
        sections.setdefault(r.section, []).append(json.loads(r.row))
    if a.report:
        sinks.put_text(spark, a.report, sinks.markdown_report(sections))


def run_preview(spark, a) -> None:
    files.preview(spark, a.load).show(truncate=False)


STAGES = {
    "ingest": (run_ingest, ["load", "mapping"], ["out"]),
    "weather": (run_weather, ["load"], ["out"]),
    "features": (run_features, ["series", "weather", "cohort"], ["out"]),
    "events": (run_events, ["series", "weather"], ["out"]),
    "train": (run_train, ["features", "labels"], ["out"]),
    "export": (run_export, ["events", "series", "buildings", "predictions", "labels"], ["out"]),
    "check-data": (run_check, ["load"], []),
    "preview": (run_preview, ["load"], []),
}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="wattloom")
    subs = top.add_subparsers(dest="stage", required=True)
    for name, (_, inputs, outputs) in STAGES.items():
        p = subs.add_parser(name)
        for x in (*inputs, *outputs):
            p.add_argument(f"--{x}", required=True)
        if name == "ingest":
            p.add_argument("--limit-files", type=int)
        if name == "features":
            p.add_argument("--labels")
        if name == "check-data":
            for x in ("registry", "mapping", "weather", "report"):
                p.add_argument(f"--{x}")
        if name == "train":
            p.add_argument("--folds", type=int, default=5)
            p.add_argument("--rounds", type=int, default=20)
            p.add_argument("--show-labels", action="store_true")
        if name == "export":
            p.add_argument("--feature-table")
            p.add_argument("--recurate", action="store_true", help="choose anew instead of the selection kept beside the output")
            p.add_argument("--min-plz", type=int, default=5)
            p.add_argument("--featured", type=int, default=10)
            p.add_argument("--others", type=int, default=200)
            p.add_argument("--min-types", type=int, default=3)
    a = top.parse_args(argv)
    spark = local_session("wattloom")
    run, inputs, _ = STAGES[a.stage]
    missing = [getattr(a, x) for x in inputs if not files.list_files(spark, getattr(a, x))]
    if missing:
        print("missing:", *missing, file=sys.stderr)
        return 1
    run(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
