"""One row of features for each building, from a prepared series, and its high-load sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import FEATURE_DAYPARTS, TEMPERATURE_BINS, Thresholds
from wattloom.functions import exprs as X
from wattloom.operators import runs

KEY, TS, P = "gp_nr", "ts", "net_kw"


def prepare(series: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds calendar columns, threshold flags, run columns and the gap-aware ramp.

    series: gp_nr, ts, net_kw and, joined before, temperature_2m, shortwave_radiation,
    sunshine_duration, is_sunny_day, is_cloudy_day.
    """
    hour = F.hour(TS)
    out = series.withColumns({f"is_{k}": X.in_hours(hour, w) for k, w in FEATURE_DAYPARTS.items()} | {"season": X.season(TS), "day": F.to_date(TS)})
    out = runs.add_runs(out, F.abs(P) <= t.near_zero_kw, [KEY], TS, t.interval_minutes, "near")
    for k in t.event_kw:
        out = runs.add_runs(out, F.col(P) > k, [KEY], TS, t.interval_minutes, f"above_{k:g}")
    out = runs.add_runs(out, F.col(P) >= t.session_kw, [KEY], TS, t.interval_minutes, "session")
    return out.withColumn("ramp", runs.ramp(P, [KEY], TS, t.interval_minutes))


def near_zero(t: Thresholds = Thresholds()) -> dict[str, Column]:
    zero, known = F.abs(P) <= t.near_zero_kw, F.col(P).isNotNull()
    share = lambda c: X.safe_ratio(X.count_where(zero & c), X.count_where(known & c))
    return {
        "near_zero_interval_ratio": share(F.lit(True)),
        "number_of_near_zero_blocks": X.count_where(runs.block_start("near", t.near_zero_run)),
        "daytime_near_zero_ratio": share(F.col("is_midday")),
        "evening_near_zero_ratio": share(F.col("is_evening")),
    }


def daypart_means() -> dict[str, Column]:
    mean = lambda c: F.avg(F.when(c, F.col(P)))
    summer, winter = F.col("season") == "summer", F.col("season") == "winter"
    midday, night = F.col("is_midday"), F.col("is_night")
    return {
        "daytime_mean_power": mean(midday), "morning_mean_power": mean(F.col("is_morning")), "evening_mean_power": mean(F.col("is_evening")),
        "summer_midday_mean": mean(midday & summer), "winter_midday_mean": mean(midday & winter), "summer_vs_winter_midday_diff": mean(midday & winter) - mean(midday & summer),
        "winter_night_mean_consumption": mean(night & winter), "summer_night_mean_consumption": mean(night & summer),
    }


def sunny_means() -> dict[str, Column]:
    return {f"{k}_day_midday_mean": F.avg(F.when(F.col("is_midday") & F.col(f"is_{k}_day"), F.col(P))) for k in ("sunny", "cloudy")}


def negative(t: Thresholds = Thresholds()) -> dict[str, Column]:
    below, known = F.col(P) < -t.near_zero_kw, F.col(P).isNotNull()
    hours = t.interval_minutes / 60
    return {
        "negative_consumption_ratio": X.safe_ratio(X.count_where(below), X.count_where(known)),
        "negative_daytime_consumption_ratio": X.safe_ratio(X.count_where(below & F.col("is_midday")), X.count_where(known & F.col("is_midday"))),
        "total_export_kwh": X.sum_or_zero(F.when(F.col(P) < 0, -F.col(P))) * hours,
    }


def solar(t: Thresholds = Thresholds()) -> dict[str, Column]:
    bright = F.col("shortwave_radiation") >= t.min_radiation
    return {
        "consumption_per_unit_solar_radiation": F.percentile(F.when(bright, F.try_divide(F.col(P).cast("double"), F.col("shortwave_radiation").cast("double"))), F.lit(0.5)),
        "correlation_solar_radiation_consumption": X.safe_corr(P, "shortwave_radiation", bright, t.min_pairs),
        "correlation_sunshine_duration_consumption": X.safe_corr(P, "sunshine_duration", None, t.min_pairs),
        "correlation_outside_temperature_consumption": X.safe_corr(P, "temperature_2m", None, t.min_pairs),
    }


def events(t: Thresholds = Thresholds()) -> dict[str, Column]:
    return {f"count_events_above_{k:g}kw": X.count_where(runs.block_start(f"above_{k:g}", t.event_run)) for k in t.event_kw}


def distribution() -> dict[str, Column]:
    up, down = F.when(F.col("ramp") > 0, F.col("ramp")), F.when(F.col("ramp") < 0, F.col("ramp"))
    return {
        "median_consumption": F.percentile(F.col(P), F.lit(0.5)), "p95_consumption": X.quantile_nearest(P, 0.95), "p99_consumption": X.quantile_nearest(P, 0.99), "max_consumption": F.max(P),
        "max_positive_ramp": F.max(up), "max_negative_ramp": F.min(down), "p95_positive_ramp": X.quantile_nearest(up, 0.95), "p99_positive_ramp": X.quantile_nearest(up, 0.99),
        "p95_negative_ramp": X.quantile_nearest(-down, 0.95), "p99_negative_ramp": X.quantile_nearest(-down, 0.99),
    }


def high_load(t: Thresholds = Thresholds()) -> dict[str, Column]:
    high = F.col(P) >= t.session_kw
    return {f"{w}_high_load_ratio": X.safe_ratio(X.count_where(high & F.col(f"is_{w}")), X.count_where(high)) for w in FEATURE_DAYPARTS}


def temperature_means(t: Thresholds = Thresholds()) -> dict[str, Column]:
    out = {}
    for name in TEMPERATURE_BINS:
        c = (X.temperature_bin("temperature_2m") == name) & F.col(P).isNotNull()
        out[f"mean_consumption_T_{name}"] = F.when(X.count_where(c) >= t.min_bin_rows, F.avg(F.when(c, F.col(P))))
    return out


def all_features(t: Thresholds = Thresholds()) -> dict[str, Column]:
    return near_zero(t) | daypart_means() | sunny_means() | negative(t) | solar(t) | events(t) | distribution() | high_load(t) | temperature_means(t)


def aggregate(prepared: DataFrame, features: dict[str, Column], key: str = KEY) -> DataFrame:
    return prepared.groupBy(key).agg(*[c.alias(n) for n, c in features.items()])


def day_features(series: DataFrame, t: Thresholds = Thresholds(), valid_rows: int | None = None) -> DataFrame:
    """n_valid_days (enough values) and days_with_export_ratio, by way of days."""
    days = series.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.count(P).alias("n"), F.max(F.col(P) < -t.near_zero_kw).alias("exports"))
    seen = days.filter("n > 0")
    ratio = seen.groupBy(KEY).agg(X.safe_ratio(X.count_where(F.col("exports")), F.count(F.lit(1))).alias("days_with_export_ratio"), F.count_if(F.col("n") >= (valid_rows or t.valid_day_rows)).alias("n_valid_days"))
    return days.select(KEY).distinct().join(ratio, KEY, "left").select(KEY, "days_with_export_ratio", F.coalesce("n_valid_days", F.lit(0)).cast("int").alias("n_valid_days"))


def sessions(series: DataFrame, t: Thresholds = Thresholds(), key: str = KEY, ts: str = TS, p: str = P) -> DataFrame:
    """High-load sessions: runs at the threshold or above of enough rows, with their statistics."""
    marked = runs.add_runs(series, F.col(p) >= t.session_kw, [key], ts, t.interval_minutes, "session").filter(F.col("session_flag") & (F.col("session_len") >= t.session_run))
    x = F.col(p)
    return marked.groupBy(key, "session_id").agg(
        F.min(ts).alias("start_timestamp"), (F.max(ts) + F.expr(f"INTERVAL {t.interval_minutes} MINUTES")).alias("end_timestamp"), F.avg(x).alias("mean_power"), F.percentile(x, F.lit(0.5)).alias("median_power"),
        F.stddev_samp(x).alias("std_power"), F.var_samp(x).alias("variance_power"), (F.sum(x) * (t.interval_minutes / 60)).alias("energy_kwh"), (F.count(F.lit(1)) * t.interval_minutes).alias("duration_minutes"),
        F.try_divide(F.stddev_samp(x), F.avg(x)).alias("cv_power"),
    ).drop("session_id")


def session_features(found: DataFrame, spans: DataFrame, key: str = KEY) -> DataFrame:
    """Per building: statistics of the sessions' mean power, shares of start and finish hours, sessions a week.

    spans: key, first_ts, last_ts of the series.  Buildings without sessions have count 0 and rate 0.
    """
    x = F.col("mean_power")
    shares = {f"{w}_{k}_ratio": X.safe_ratio(X.count_where(X.in_hours(F.hour(f"{c}_timestamp"), h)), F.count(F.lit(1))) for w, h in FEATURE_DAYPARTS.items() for k, c in (("start", "start"), ("finish", "end"))}
    stats = found.groupBy(key).agg(
        F.count(F.lit(1)).alias("session_count"), F.avg(x).alias("session_mean"), F.percentile(x, F.lit(0.5)).alias("session_median"), F.stddev_samp(x).alias("session_std"), F.var_samp(x).alias("session_variance"),
        F.try_divide(F.stddev_samp(x), F.avg(x)).alias("session_cv"), *[c.alias(n) for n, c in shares.items()],
    )
    joined = spans.join(stats, key, "left").withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    weeks = F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")) / F.lit(7 * 86400.0)
    rate = F.when(F.col("session_count") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("session_count").cast("double"), weeks))
    return joined.withColumn("sessions_per_week", rate).drop("first_ts", "last_ts")


def spans(series: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    return series.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def feature_table(series: DataFrame, cohort: DataFrame, labels: DataFrame | None = None, t: Thresholds = Thresholds(), valid_rows: int | None = None) -> DataFrame:
    """Star assembly: cohort, main features, day features, session features, labels."""
    prepared = prepare(series, t)
    out = cohort.join(aggregate(prepared, all_features(t)), KEY, "left").join(day_features(series, t, valid_rows), KEY, "left").join(session_features(sessions(series, t), spans(series)), KEY, "left")
    out = out.withColumns({"session_count": F.coalesce("session_count", F.lit(0)), "sessions_per_week": F.coalesce("sessions_per_week", F.lit(0.0))})
    return out if labels is None else out.join(labels, KEY, "left")
