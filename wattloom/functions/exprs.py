"""Column expressions with the null, zero and rounding rules that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.config import FEATURE_DAYPARTS, SUMMER, TEMPERATURE_BINS, WINTER


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def count_where(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def quantile_nearest(x: str | Column, q: float) -> Column:
    """The value at index round((n - 1) * q), half up, of the sorted non-null values; null if none."""
    values = F.sort_array(F.collect_list(col(x)))
    return F.try_element_at(values, F.greatest(F.round((F.count(col(x)) - 1) * F.lit(q)).cast("int") + 1, F.lit(1)))


def safe_corr(a: str | Column, b: str | Column, where: Column | None = None, least: int = 30) -> Column:
    """Pearson correlation of rows with both values (and ``where``); null under ``least`` rows or for constants."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when(F.count(x) >= least, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null."""
    x = out = col(x)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def complete_sum(x: str | Column, expected: str | Column) -> Column:
    """Sum, if there are exactly ``expected`` rows and none is null; null otherwise."""
    return F.when((F.count(F.lit(1)) == col(expected)) & (F.count(col(x)) == F.count(F.lit(1))), F.sum(col(x)))


def in_hours(hour: Column, window: tuple[int, int]) -> Column:
    """Half-open hour window; one that starts after it ends wraps around midnight."""
    start, end = window
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def daypart(ts: str | Column, windows: dict = FEATURE_DAYPARTS, other: str | None = None) -> Column:
    hour = F.hour(col(ts))
    return reduce(lambda c, kv: c.when(in_hours(hour, kv[1]), F.lit(kv[0])), list(windows.items())[1:], F.when(in_hours(hour, next(iter(windows.values()))), F.lit(next(iter(windows))))).otherwise(F.lit(other))


def season(ts: str | Column) -> Column:
    month = F.month(col(ts))
    return F.when(month.isin(*SUMMER), "summer").when(month.isin(*WINTER), "winter")


def temperature_bin(t: str | Column, bins: dict = TEMPERATURE_BINS) -> Column:
    """Name of the half-open bin; null for a null temperature."""
    t = col(t)
    out = None
    for name, (low, high) in bins.items():
        inside = (F.lit(True) if low is None else t >= low) & (F.lit(True) if high is None else t < high)
        out = F.when(t.isNotNull() & inside, name) if out is None else out.when(t.isNotNull() & inside, name)
    return out


def decimal(text: str | Column, factor: float = 1.0) -> Column:
    """Number with decimal comma or point; null for blanks, junk and NaN."""
    x = F.replace(F.trim(col(text)), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(x), x) * F.lit(factor)


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def mark_to_flag(text: str | Column) -> Column:
    """x or X is 1, - is 0, anything else null."""
    mark = F.lower(F.trim(col(text)))
    return F.when(mark == "x", F.lit(1)).when(mark == "-", F.lit(0)).cast("tinyint")


def clean_key(text: str | Column) -> Column:
    """Identifier: blanks, a trailing .0 and leading zeros go; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"\.0$", ""), "^0+", ""), F.lit(""))


def first_digits(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def slot_minutes(label: str | Column, slot: int = 15, day: int = 1440) -> Column:
    """Start of the interval whose end a slot label names: 00:15 starts at minute 0, 00:00 at 1425 the
    same day; null for anything that is no HH:MM."""
    hh = F.nullif(F.regexp_extract(col(label), r"^([01]?\d|2[0-3]):([0-5]\d)$", 1), F.lit("")).try_cast("int")
    mm = F.nullif(F.regexp_extract(col(label), r"^([01]?\d|2[0-3]):([0-5]\d)$", 2), F.lit("")).try_cast("int")
    return F.pmod(hh * 60 + mm - slot, F.lit(day))


def percent(p: str | Column) -> Column:
    """Probability as whole percent, 0 to 100, halves to even."""
    return F.rint(clip(p, 0.0, 1.0) * 100).cast("int")


def confidence_label(p: str | Column) -> Column:
    """Likely from 80, Possible from 50, else Unlikely; null and NaN count as 0."""
    x = clip(F.coalesce(F.nanvl(col(p).cast("double"), F.lit(0.0)), F.lit(0.0)), 0.0, 100.0)
    return F.when(x >= 80, "Likely").when(x >= 50, "Possible").otherwise("Unlikely")


def last_sunday(year: Column, month: int) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), "SUN")


def local_iso(ts: str | Column, zone: str = "Europe/Zurich") -> Column:
    """Local naive time with its offset as ISO 8601; a time that the clock skips keeps the offset before."""
    ts = col(ts)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    seconds = F.timestamp_diff("SECOND", utc, ts)
    seconds = F.when(back != ts, F.timestamp_diff("SECOND", utc, back) - 3600).otherwise(seconds)
    sign = F.when(seconds < 0, "-").otherwise("+")
    minutes = F.abs(seconds / 60).cast("int")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols])


def total_of(cols: list[Column]) -> Column:
    """Horizontal sum that skips nulls."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])


def top_contributions(pairs: str | Column, k: int = 6) -> Column:
    """Of array<struct<feature, value>>: the k largest by magnitude, as tanh(value / 2) to 3 decimals."""
    ranked = F.array_sort(col(pairs), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["feature"].alias("feature"), F.round(F.tanh(x["value"] / 2), 3).alias("contribution")))


def local_to_utc(ts: str | Column, zone: str = "Europe/Zurich") -> Column:
    """Local naive time as UTC: the earlier of two instants where the clock goes back, null where it skips the time."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), col(ts))
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) == col(ts), utc)


def minutes_from(ts: str | Column, start: str | Column) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(ts)) / F.lit(60.0)


def _half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def hour_tick(minute: str | Column) -> Column:
    """0 is 00, 240 is 04, 1440 is 24."""
    return F.format_string("%02d", _half_up(col(minute) / F.lit(60.0)))


def clock(minute: str | Column) -> Column:
    """1335 is 22:15."""
    whole = _half_up(col(minute))
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


#: Short names of the assets.
SHORT_NAMES = {"pv": "PV", "battery": "Battery", "heatpump": "Heat pump", "ev": "EV"}


def prediction_text(asset: str, p: str | Column) -> Column:
    """A percent as a sentence, as in EV — 76% possible; null and NaN count as 0."""
    x = clip(F.coalesce(F.nanvl(col(p).cast("double"), F.lit(0.0)), F.lit(0.0)), 0.0, 100.0)
    return F.concat(F.lit(f"{SHORT_NAMES[asset]} — "), _half_up(x).cast("string"), F.lit("% "), F.lower(confidence_label(p)))


def signed(value: str | Column) -> Column:
    """Two decimals with a sign; the minus is the typographic one."""
    v = col(value)
    return F.concat(F.when(v < 0, "−").otherwise("+"), F.format_string("%.2f", F.abs(v)))
