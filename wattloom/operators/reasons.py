"""Sentences that explain a score by the features of its building, and labels of features."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions import exprs as X

#: Labels of features.
FEATURE_LABELS = {
    "n_valid_days": "Days with valid data",
    "pv_prob": "Estimated PV probability",
    "near_zero_interval_ratio": "Share of intervals with net load near zero",
    "number_of_near_zero_blocks": "Number of near-zero load blocks",
    "daytime_near_zero_ratio": "Share of midday intervals near zero",
    "evening_near_zero_ratio": "Share of evening intervals near zero",
    "consumption_per_unit_solar_radiation": "Net load per unit of solar radiation",
    "daytime_mean_power": "Mean midday net load",
    "morning_mean_power": "Mean morning net load",
    "evening_mean_power": "Mean evening net load",
    "negative_consumption_ratio": "Share of intervals exporting to the grid",
    "negative_daytime_consumption_ratio": "Share of midday intervals exporting",
    "total_export_kwh": "Total energy exported",
    "days_with_export_ratio": "Share of days with export",
    "summer_midday_mean": "Summer midday net load",
    "winter_midday_mean": "Winter midday net load",
    "summer_vs_winter_midday_diff": "Winter minus summer midday load",
    "correlation_solar_radiation_consumption": "Correlation of net load with solar radiation",
    "correlation_sunshine_duration_consumption": "Correlation of net load with sunshine hours",
    "sunny_day_midday_mean": "Midday net load on sunny days",
    "cloudy_day_midday_mean": "Midday net load on cloudy days",
    "count_events_above_3kw": "Load runs above 3 kW",
    "count_events_above_5kw": "Load runs above 5 kW",
    "count_events_above_7kw": "Load runs above 7 kW",
    "count_events_above_11kw": "Load runs above 11 kW",
    "median_consumption": "Median load",
    "p95_consumption": "95th percentile load",
    "p99_consumption": "99th percentile load",
    "max_consumption": "Peak load",
    "max_positive_ramp": "Largest load step up",
    "max_negative_ramp": "Largest load step down",
    "p95_positive_ramp": "95th percentile step up",
    "p99_positive_ramp": "99th percentile step up",
    "p95_negative_ramp": "95th percentile step down",
    "p99_negative_ramp": "99th percentile step down",
    "session_mean": "Mean power of high-load sessions",
    "session_median": "Median power of high-load sessions",
    "session_std": "Spread of session power",
    "session_variance": "Variance of session power",
    "session_cv": "Session power variability",
    "morning_start_ratio": "Sessions starting in the morning",
    "midday_start_ratio": "Sessions starting at midday",
    "evening_start_ratio": "Sessions starting in the evening",
    "night_start_ratio": "Sessions starting at night",
    "morning_finish_ratio": "Sessions ending in the morning",
    "midday_finish_ratio": "Sessions ending at midday",
    "evening_finish_ratio": "Sessions ending in the evening",
    "night_finish_ratio": "Sessions ending at night",
    "morning_high_load_ratio": "High load in the morning",
    "midday_high_load_ratio": "High load at midday",
    "evening_high_load_ratio": "High load in the evening",
    "night_high_load_ratio": "High load at night",
    "sessions_per_week": "Charging-like sessions per week",
    "correlation_outside_temperature_consumption": "Correlation of load with outdoor temperature",
    "mean_consumption_T_below_minus5": "Mean load below -5 °C",
    "mean_consumption_T_minus5_to_0": "Mean load between -5 and 0 °C",
    "mean_consumption_T_0_to_5": "Mean load between 0 and 5 °C",
    "mean_consumption_T_5_to_10": "Mean load between 5 and 10 °C",
    "mean_consumption_T_10_to_15": "Mean load between 10 and 15 °C",
    "mean_consumption_T_above_15": "Mean load above 15 °C",
    "winter_night_mean_consumption": "Winter night load",
    "summer_night_mean_consumption": "Summer night load",
}

#: Sentences for each asset, from 0.5 on and below; a value's name and format stand in braces.
LIKELY = {
    "pv": (
        "{days_with_export_ratio:.0%} of days feed power back to the grid",
        "Net load correlates with solar radiation (r = {correlation_solar_radiation_consumption:.2f})",
        "Midday net load is {sunny_day_midday_mean:.1f} kW on sunny days vs {cloudy_day_midday_mean:.1f} kW on cloudy days",
    ),
    "battery": (
        "Net load sits near zero in {near_zero_interval_ratio:.0%} of intervals",
        "{evening_near_zero_ratio:.0%} of evening intervals are near zero, consistent with discharging",
        "Estimated PV probability {pv_prob:.0%}, a battery usually pairs with PV",
    ),
    "heatpump": (
        "Load below -5 °C is {cold_warm_load_ratio:.1f}× the load above 15 °C",
        "Winter nights use {winter_summer_night_ratio:.1f}× the power of summer nights",
        "Load rises as it gets colder (r = {correlation_outside_temperature_consumption:.2f})",
    ),
    "ev": (
        "{sessions_per_week:.1f} charging-like sessions per week, plateau ≈ {session_median:.1f} kW",
        "{evening_night_start_ratio:.0%} of sessions start in the evening or at night",
        "{count_events_above_7kw:.0f} load runs above 7 kW",
    ),
}
UNLIKELY = {
    "pv": (
        "Only {days_with_export_ratio:.0%} of days show any export to the grid",
        "Midday net load does not follow solar radiation (r = {correlation_solar_radiation_consumption:.2f})",
        "No midday reduction in net load",
    ),
    "battery": (
        "Net load sits near zero in only {near_zero_interval_ratio:.0%} of intervals",
        "Midday surplus is exported rather than stored",
    ),
    "heatpump": (
        "Load barely changes with outdoor temperature (r = {correlation_outside_temperature_consumption:.2f})",
        "Winter and summer night loads are similar ({winter_summer_night_ratio:.1f}×)",
    ),
    "ev": (
        "Only {sessions_per_week:.1f} high-load sessions per week",
        "Peak load stays below {p99_consumption:.1f} kW",
        "No repeated high-power plateaus",
    ),
}
NAMES = {"pv": "a PV system", "battery": "a battery", "heatpump": "a heat pump", "ev": "an EV charger"}
WITHOUT_VALUES = ("Consumption pattern is consistent with {}", "No sign of {} in the consumption pattern")
WITHOUT_FEATURES = "Prediction based on the building's 15-minute load profile"
SHOWN = "Visible on the selected day as a highlighted band"
EVENT_TYPES = {"pv": "pv_generation", "battery": "battery_cycle", "heatpump": "heat_pump_heating", "ev": "ev_charging"}


def finite(c: Column) -> Column:
    """The value as a double; null for null, NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def known_values(features: dict[str, Column]) -> dict[str, Column]:
    """Values that sentences may name: features that are there, and ratios of two of them where the lower is above 0."""
    x = {n: finite(c) for n, c in features.items()}
    ratio = lambda a, b: F.when(b > 0, a / b)
    made = {
        "evening_night_start_ratio": ("evening_start_ratio", "night_start_ratio", lambda a, b: a + b),
        "winter_summer_night_ratio": ("winter_night_mean_consumption", "summer_night_mean_consumption", ratio),
        "cold_warm_load_ratio": ("mean_consumption_T_below_minus5", "mean_consumption_T_above_15", ratio),
    }
    return x | {k: finite(f(x[a], x[b])) for k, (a, b, f) in made.items() if a in x and b in x}


def shown(x: Column, form: str) -> Column:
    """A value in one of the formats .0%, .0f, .1f, .2f; halves, by the shortest decimal, to even; a negative value
    keeps its sign where it rounds to zero."""
    if form.endswith("%"):
        return F.concat(F.format_string("%.0f", F.rint(x * 100)), F.lit("%"))
    text = F.format_string(f"%{form}", F.abs(F.bround(x, int(form[1]))))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def sentence(text: str, values: dict[str, Column]) -> Column:
    """The text with its values; null if any is missing."""
    parts = re.split(r"\{(\w+):([^}]+)\}", text)
    if any(n not in values for n in parts[1::3]):
        return F.lit(None).cast("string")
    made = [F.lit(parts[0])]
    for i in range(1, len(parts), 3):
        x = values[parts[i]]
        made += [F.when(x.isNotNull(), shown(x, parts[i + 1])), F.lit(parts[i + 2])]
    return F.concat(*made)


def reasons(asset: str, features: dict[str, Column], prob: Column, has_event: Column | None = None, known: Column | None = None, most: int = 3) -> Column:
    """Array of sentences for one asset: those of its side whose values are all there, ``most`` at most, or one
    general sentence; and one more where the shown day has an event of its kind.

    features: the row's features by name.  prob: the score; null counts as 0.  known: false where the building has
    no row of features, which gives one fixed sentence.
    """
    values = known_values(features)
    likely = F.coalesce(F.nanvl(prob.cast("double"), F.lit(0.0)), F.lit(0.0)) >= 0.5

    def lines(texts: tuple[str, ...], without: str) -> Column:
        made = F.slice(F.array_compact(F.array(*[sentence(t, values) for t in texts])), 1, most)
        return F.when(F.size(made) > 0, made).otherwise(F.array(F.lit(without.format(NAMES[asset]))))

    out = F.when(likely, lines(LIKELY[asset], WITHOUT_VALUES[0])).otherwise(lines(UNLIKELY[asset], WITHOUT_VALUES[1]))
    if has_event is not None:
        out = F.when(F.coalesce(has_event, F.lit(False)), F.concat(out, F.array(F.lit(SHOWN)))).otherwise(out)
    return out if known is None else F.when(F.coalesce(known, F.lit(False)), out).otherwise(F.array(F.lit(WITHOUT_FEATURES)))


def human_label(name: str | Column, known: dict[str, str] = FEATURE_LABELS) -> Column:
    """Label of a feature; an unknown one is its name with blanks and a capital."""
    c = X.col(name)
    plain = F.replace(c, F.lit("_"), F.lit(" "))
    pretty = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1000)))
    table = F.create_map(*[F.lit(v) for kv in known.items() for v in kv]) if known else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, c), pretty)


def labelled(contributions: Column) -> Column:
    """Of array<struct<feature, contribution>>: the same with labels for names; empty for null."""
    out = F.transform(contributions, lambda x: F.struct(human_label(x["feature"]).alias("feature"), x["contribution"].cast("double").alias("contribution")))
    return F.coalesce(out, F.array().cast("array<struct<feature:string,contribution:double>>"))


def has_type(events: Column, kind: str) -> Column:
    """Whether an array of events has one of a type."""
    return F.coalesce(F.exists(events, lambda e: e["type"] == kind), F.lit(False))

