"""Rule-based event detectors as window queries, and the showcase day.

Inputs have gp_nr, ts, import_kw, export_kw, net_kw, quality and, joined before,
shortwave_radiation, temperature_2m and is_sunny_day.  Each detector returns
(gp_nr, type, start, end, confidence, peak_kw, energy_kwh).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DetectorConfig
from wattloom.functions import exprs as X
from wattloom.operators import runs
from wattloom.session import settled

KEY, TS = "gp_nr", "ts"
EVENT = ["gp_nr", "type", "start", "end", "confidence", "peak_kw", "energy_kwh"]


def _hours(c: DetectorConfig) -> float:
    return c.interval_minutes / 60


def _after(ts, c: DetectorConfig):
    return ts + F.expr(f"INTERVAL {c.interval_minutes} MINUTES")


def _pick(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("type", F.lit(kind)).select(*EVENT)


def ev_residuals(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Import above its centred rolling median, with the row's index."""
    base = runs.rolling_median("import_kw", [KEY], TS, c.ev_window)
    return runs.with_index(series, [KEY], TS).withColumn("resid", F.col("import_kw") - base)


def ev_charging(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Long flat plateaus above the base load, near a usual charging power."""
    rows = ev_residuals(series, c).select(KEY, TS, "i", "resid")
    found = runs.merge_runs(runs.index_runs(rows, F.col("resid") >= c.ev_residual_kw, [KEY], "i"), [KEY], c.ev_gap).filter(F.col("e") - F.col("s") >= c.ev_run)
    spread = found.select(KEY, "s", "e", F.explode(F.sequence("s", F.col("e") - 1)).alias("i"))
    seg = rows.join(spread, [KEY, "i"])
    stats = seg.groupBy(KEY, "s").agg(F.min(TS).alias("start"), _after(F.max(TS), c).alias("end"), F.percentile("resid", F.lit(0.5)).alias("peak_kw"), F.stddev_pop("resid").alias("sd"), (F.sum("resid") * _hours(c)).alias("energy_kwh"))
    cv = F.when(F.col("peak_kw") > 0, F.col("sd") / F.col("peak_kw")).otherwise(F.lit(9.0))
    off = F.least(*[F.abs(F.col("peak_kw") - k) / F.lit(k) for k in c.ev_levels])
    scored = stats.withColumn("cv", cv).filter(F.col("cv") <= c.ev_max_cv)
    return _pick(scored.withColumn("confidence", X.clip(0.5 * (1 - F.col("cv") / c.ev_max_cv) + 0.5 * (1 - F.least(off, F.lit(1.0))), 0.0, 1.0)), "ev_charging")


def pv_export_days(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """From the first to the last exporting interval of a day; surer where export follows radiation."""
    days = series.withColumn("day", F.to_date(TS))
    on = F.col("export_kw") > c.export_kw
    radiation = F.coalesce("shortwave_radiation", F.lit(0.0))
    corr = F.try_divide(F.covar_pop("export_kw", radiation), F.sqrt(F.var_pop("export_kw") * F.var_pop(radiation)))
    out = days.groupBy(KEY, "day").agg(
        F.min(F.when(on, F.col(TS))).alias("start"), _after(F.max(F.when(on, F.col(TS))), c).alias("end"), F.max("export_kw").alias("peak_kw"), (F.sum(F.when(on, F.col("export_kw"))) * _hours(c)).alias("energy_kwh"),
        F.when((F.count("shortwave_radiation") > 0) & (F.coalesce(corr, F.lit(0.0)) > c.pv_corr), 0.9).otherwise(0.7).alias("confidence"),
    )
    return _pick(out.filter("start is not null"), "pv_generation")


def night_baseline(series: DataFrame) -> DataFrame:
    """(gp_nr, baseline): median import of measured rows before six o'clock; 0 if there are none."""
    night = (F.hour(TS) < 6) & (F.col("quality") == "ok")
    return series.groupBy(KEY).agg(F.coalesce(F.percentile(F.when(night, F.col("import_kw")), F.lit(0.5)), F.lit(0.0)).alias("baseline"))


def pv_dip_windows(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """On sunny days without export: the longest run, within hours, of load well below the night's."""
    days = series.withColumn("day", F.to_date(TS)).join(night_baseline(series), KEY)
    quiet = days.withColumn("top", F.max("export_kw").over(Window.partitionBy(KEY, "day"))).filter(F.col("is_sunny_day") & (F.col("top") <= c.export_kw))
    hours = runs.with_index(quiet.filter(X.in_hours(F.hour(TS), c.dip_hours)), [KEY, "day"], TS)
    low = F.col("net_kw") < F.col("baseline") * c.dip_share
    best = runs.index_runs(hours, low, [KEY, "day"], "i").filter(F.col("n") >= c.dip_run)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy(KEY, "day").orderBy(F.desc("n"), "s"))).filter("r = 1")
    seg = hours.join(best.select(KEY, "day", "s", "e"), [KEY, "day"]).filter((F.col("i") >= F.col("s")) & (F.col("i") < F.col("e")))
    out = seg.groupBy(KEY, "day").agg(F.min(TS).alias("start"), _after(F.max(TS), c).alias("end"), (-F.min("net_kw")).alias("peak_kw"), (F.sum(F.greatest(F.col("baseline") - F.col("net_kw"), F.lit(0.0))) * _hours(c)).alias("energy_kwh"))
    return _pick(out.withColumn("confidence", F.lit(0.5)), "pv_generation")


def heating_days(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Winter days on which load above the summer night's cycles, or has a long run that begins and ends within the
    morning hours."""
    part, season = X.daypart(TS, c.dayparts, "other"), X.season(TS)
    night = part == "night"
    base = series.groupBy(KEY).agg(
        F.coalesce(F.percentile(F.when(night & (season == "summer"), F.col("import_kw")), F.lit(0.5)), X.quantile_nearest(F.when(night, F.col("import_kw")), 0.1), F.lit(0.0)).alias("base"),
        X.safe_corr("temperature_2m", "import_kw", season == "winter", 2).alias("r"),
    )
    winter = runs.with_index(series.filter(season == "winter").withColumn("day", F.to_date(TS)), [KEY, "day"], TS).join(base, KEY)
    on = (F.col("import_kw") - F.col("base")) >= c.hp_excess_kw
    w = Window.partitionBy(KEY, "day").orderBy("i")
    marked = winter.withColumn("on", on).withColumn("switch", F.coalesce((F.lag("on").over(w) != F.col("on")).cast("int"), F.lit(0)))
    marked = marked.withColumn("switches", F.sum("switch").over(w.rowsBetween(1 - c.hp_window, 0))).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(KEY, "day")))
    full = (F.col("i") >= c.hp_window) | (F.col("rows") <= c.hp_window)
    hour = F.hour(TS)
    whole = runs.index_runs(marked, F.col("on"), [KEY, "day"], "i", F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))
    early = whole.filter((F.col("first_hour") >= c.hp_hours[0]) & (F.col("last_hour") < c.hp_hours[1])).groupBy(KEY, "day").agg(F.max("n").alias("early"))
    daily = marked.groupBy(KEY, "day").agg(
        F.max(F.when(full, F.col("switches"))).alias("most"), F.min(F.when(F.col("on"), F.col(TS))).alias("start"), _after(F.max(F.when(F.col("on"), F.col(TS))), c).alias("end"), F.max(F.when(F.col("on"), F.col("import_kw"))).alias("peak_kw"),
        (F.sum(F.when(F.col("on"), F.col("import_kw") - F.col("base"))) * _hours(c)).alias("energy_kwh"), F.max("r").alias("r"),
    )
    kept = daily.join(early, [KEY, "day"], "left").filter(F.col("start").isNotNull() & ((F.col("most") >= c.hp_switches) | (F.coalesce("early", F.lit(0)) >= c.hp_run)))
    return _pick(kept.withColumn("confidence", F.coalesce(X.clip(-F.col("r"), 0.3, 0.9), F.lit(0.5))), "heat_pump_heating")


def battery_cycles(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """On sunny exporting days: runs of load near zero, charging before the radiation peak or
    discharging in the evening; surer where a day has both."""
    d = Window.partitionBy(KEY, "day")
    rows = runs.with_index(series.withColumn("day", F.to_date(TS)), [KEY, "day"], TS).withColumn("rad", F.coalesce("shortwave_radiation", F.lit(0.0)))
    rows = rows.withColumn("top", F.max("export_kw").over(d)).withColumn("peak_i", F.min_by("i", F.struct(-F.col("rad"), F.col("i"))).over(d)).filter(F.col("is_sunny_day") & (F.col("top") > c.export_kw))
    idle = F.abs("net_kw") < c.battery_kw
    kinds = {"charging": idle & (F.col("i") < F.col("peak_i")) & (F.col("rad") > c.battery_radiation), "discharging": idle & X.in_hours(F.hour(TS), c.battery_evening)}
    parts = [runs.index_runs(rows, cond, [KEY, "day"], "i").filter(F.col("n") >= c.battery_run).withColumn("kind", F.lit(k)) for k, cond in kinds.items()]
    found = reduce(DataFrame.unionByName, parts).withColumn("both", F.min("kind").over(d) != F.max("kind").over(d))
    seg = rows.select(KEY, "day", TS, "i", "net_kw").join(found.select(KEY, "day", "s", "kind", "both", F.explode(F.sequence("s", F.col("e") - 1)).alias("i")), [KEY, "day", "i"])
    out = seg.groupBy(KEY, "day", "kind", "s").agg(F.min(TS).alias("start"), _after(F.max(TS), c).alias("end"), F.max(F.abs("net_kw")).alias("peak_kw"), (F.sum(F.abs("net_kw")) * _hours(c)).alias("energy_kwh"), F.max(F.when(F.col("both"), 0.8).otherwise(0.6)).alias("confidence"))
    return _pick(out, "battery_cycle")


def not_overlapping(events: DataFrame, claimed: DataFrame) -> DataFrame:
    """Events of a building that overlap none of its claimed intervals (half-open).

    Both sides are taken apart into the days they touch, so that an event meets the claims of its days alone, not
    all of its building.
    """
    days = lambda s, e: F.explode(F.sequence(F.to_date(F.col(s)), F.to_date(F.greatest(s, e))))
    c = claimed.select(F.col(KEY).alias("_w_key"), F.col("start").alias("_w_start"), F.col("end").alias("_w_end"), days("start", "end").alias("_w_day"))
    cut = events.select(KEY, "start", "end").distinct().withColumn("_w_of", days("start", "end"))
    taken = cut.join(c, (F.col(KEY) == F.col("_w_key")) & (F.col("_w_of") == F.col("_w_day")) & (F.col("start") < F.col("_w_end")) & (F.col("end") > F.col("_w_start")), "left_semi")
    return events.join(taken.select(KEY, "start", "end").distinct(), [KEY, "start", "end"], "left_anti")


def high_load_runs(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Runs, by consecutive row, of import at its day's high quantile or above; day is that of the first row."""
    rows = runs.with_index(series.withColumn("day", F.to_date(TS)), [KEY], TS)
    bound = rows.groupBy(KEY, "day").agg(X.quantile_nearest("import_kw", c.high_quantile).alias("bound"))
    hits = rows.join(bound, [KEY, "day"]).filter(F.col("import_kw") >= F.col("bound"))
    group = F.col("i") - F.row_number().over(Window.partitionBy(KEY).orderBy("i"))
    out = hits.withColumn("g", group).groupBy(KEY, "g").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("day"), F.min(TS).alias("start"), _after(F.max(TS), c).alias("end"), F.max("import_kw").alias("peak_kw"), (F.sum("import_kw") * _hours(c)).alias("energy_kwh"))
    return out.filter((F.col("n") >= c.high_run) & (F.col("n") < c.day_rows)).drop("g")


def high_consumption(series: DataFrame, claimed: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The longest high-load run of each day that no other event claims."""
    free = not_overlapping(high_load_runs(series, c), claimed)
    best = free.withColumn("r", F.row_number().over(Window.partitionBy(KEY, "day").orderBy(F.desc("n"), "start"))).filter("r = 1")
    return _pick(best.withColumn("confidence", F.lit(0.5)), "high_consumption")


DETECTORS = {"ev_charging": ev_charging, "pv_export": pv_export_days, "pv_dip": pv_dip_windows, "heat_pump_heating": heating_days, "battery_cycle": battery_cycles}


def detect(series: DataFrame, c: DetectorConfig = DetectorConfig(), detectors: dict = DETECTORS) -> DataFrame:
    """All detectors, then the high-load fallback on what they leave.

    The series and the detectors' events are tables: each is made once, however many read it.
    """
    series = settled(series, "detector-series")
    claimed = settled(reduce(DataFrame.unionByName, [f(series, c) for f in detectors.values()]), "claimed")
    return claimed.unionByName(high_consumption(series, claimed, c))


def last_full_day(series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(gp_nr, day): the last day with all measured rows, else the last day."""
    days = series.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.count_if(F.col("quality") == "ok").alias("n"))
    return days.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col("n") >= c.day_rows, F.col("day"))), F.max("day")).alias("day"))


def showcase_day(events: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(gp_nr, showcase_date, n_event_types): most kinds of sure events, then most confidence, then latest."""
    days = events.filter(F.col("confidence") >= c.showcase_confidence).groupBy(KEY, F.to_date("start").alias("day")).agg(F.count_distinct("type").alias("types"), F.sum("confidence").alias("sure"))
    ranked = days.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("types"), F.desc("sure"), F.desc("day"))))
    return ranked.filter("r = 1").select(KEY, F.col("day").alias("showcase_date"), F.col("types").cast("int").alias("n_event_types"))


def showcase(events: DataFrame, series: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The showcase day of every building; without sure events the last full day, with 0 kinds."""
    best = showcase_day(events, c)
    rest = last_full_day(series, c).join(best, KEY, "left")
    return rest.select(KEY, F.coalesce("showcase_date", "day").alias("showcase_date"), F.coalesce("n_event_types", F.lit(0)).alias("n_event_types"))
