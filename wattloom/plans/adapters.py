"""The driver's tables as domain tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as meter readings: value in whole cents, so that sums are exact."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    gp = F.col("user_id") % 8
    return e.select(
        F.col("user_id").alias("mp_id"), (gp + 100000).alias("gp_nr"), (gp % 5 + 5000).cast("string").alias("plz"), "ts", F.when(F.col("event_type").isin("click", "view", "purchase"), "import").otherwise("export").alias("channel"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


READINGS = """readings AS (
  SELECT user_id AS mp_id, 100000 + user_id % 8 AS gp_nr, CAST(5000 + (user_id % 8) % 5 AS VARCHAR) AS plz, ts,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'import' ELSE 'export' END AS channel, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of each building, from readings."""
    r = readings(spark, sf_dir)
    side = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("cents"))), F.lit(0))
    out = r.groupBy("gp_nr", "plz", F.date_trunc("hour", F.col("ts")).alias("ts")).agg(side("import").alias("i"), side("export").alias("e"))
    return out.select("gp_nr", "plz", "ts", (F.col("i") / F.lit(1000.0)).alias("import_kw"), (F.col("e") / F.lit(1000.0)).alias("export_kw"), ((F.col("i") - F.col("e")) / F.lit(1000.0)).alias("net_kw"))


SERIES = READINGS + """, series AS (
  SELECT gp_nr, plz, ts, CAST(i AS DOUBLE) / 1000.0 AS import_kw, CAST(e AS DOUBLE) / 1000.0 AS export_kw, CAST(i - e AS DOUBLE) / 1000.0 AS net_kw
  FROM (SELECT gp_nr, plz, date_trunc('hour', ts) AS ts, coalesce(sum(cents) FILTER (WHERE channel = 'import'), 0) AS i, coalesce(sum(cents) FILTER (WHERE channel = 'export'), 0) AS e
        FROM readings GROUP BY 1, 2, 3))"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of each place, with natural gaps."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    mean = lambda kind: F.try_divide(F.sum(F.when(F.col("event_type") == kind, cents)).cast("double"), F.count(F.when(F.col("event_type") == kind, cents)).cast("double"))
    out = e.groupBy(((F.col("user_id") % 8) % 5 + 5000).cast("string").alias("plz"), F.date_trunc("hour", F.col("ts")).alias("ts")).agg(mean("view").alias("v"), mean("click").alias("c"), mean("purchase").alias("p"))
    return out.select("plz", "ts", (F.col("v") / 500.0 - 5.0).alias("temperature_2m"), (F.col("c") / 10.0).alias("shortwave_radiation"), (F.col("p") * 0.36).alias("sunshine_duration"))


WEATHER = """weather AS (
  SELECT plz, ts, v / 500.0 - 5.0 AS temperature_2m, c / 10.0 AS shortwave_radiation, p * CAST(0.36 AS DOUBLE) AS sunshine_duration FROM (
    SELECT CAST(5000 + (user_id % 8) % 5 AS VARCHAR) AS plz, date_trunc('hour', ts) AS ts,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'view') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS v,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'click') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS c,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS p
    FROM events GROUP BY 1, 2))"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as registry rows with marks."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    mark = lambda c: F.when(F.col(c) == 1, "x").when(F.col(c) == 0, "-").otherwise("")
    return d.join(lab, "doc_id", "left").select((F.col("doc_id") % 50).alias("gp_nr"), "doc_id", F.col("source").alias("plz"), mark("quality").alias("PV"), mark("toxic").alias("Batterie"))


FLAGS = """flags AS (
  SELECT d.doc_id % 50 AS gp_nr, d.doc_id, d.source AS plz, CASE quality WHEN 1 THEN 'x' WHEN 0 THEN '-' ELSE '' END AS pv, CASE toxic WHEN 1 THEN 'x' WHEN 0 THEN '-' ELSE '' END AS battery
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities shipped each day by ten supplier groups: years of daily values."""
    q = F.round("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("plz"), F.to_date("l_shipdate").alias("day")).agg(F.sum(q).alias("daily"))


DAILY = "daily AS (SELECT l_suppkey % 10 AS plz, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS daily FROM lineitem GROUP BY 1, 2)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored rows: score in tenths, label, whole weight, source."""
    s = table(spark, sf_dir, "lineitem")
    return s.select((F.round(F.col("l_discount") * 100).cast("bigint") / F.lit(10.0)).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round("l_quantity").cast("bigint").alias("w"), F.col("l_linestatus").alias("source"))


SCORES = "scores AS (SELECT CAST(round(l_discount * 100) AS BIGINT) / CAST(10.0 AS DOUBLE) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(round(l_quantity) AS BIGINT) AS w, l_linestatus AS source FROM lineitem)"
