"""Read access to exported documents and series, as DataFrames; serve them with any HTTP server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import export


class Unknown(LookupError):
    """No such building, or no data on that day: 404."""


class Viewer:
    def __init__(self, spark: SparkSession, documents: str, series: str):
        """documents: folder of one JSON document a line; series: Parquet of gp_nr, ts, net_kw."""
        self.spark, self.series = spark, spark.read.parquet(series)
        self.documents = spark.read.text(documents).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.postcode").alias("postcode"), F.get_json_object("value", "$.city").alias("city"), F.col("value").alias("document"))

    def health(self) -> dict:
        return {"status": "ok", "buildings": self.documents.count()}

    def buildings(self, postcode: str | None = None, query: str = "") -> DataFrame:
        """Documents, of one postcode and by search tokens if given."""
        found = self.documents if postcode is None else self.documents.filter(F.col("postcode") == postcode)
        return export.search(found, query, ["id", "postcode", "city"])

    def counts(self) -> DataFrame:
        """Buildings by postcode, whatever the filters."""
        return export.count_by(self.documents, "postcode")

    def building(self, building_id: str) -> str:
        row = self.documents.filter(F.col("id") == building_id).select("document").first()
        if row is None:
            raise Unknown(building_id)
        return row.document

    def profile(self, building_id: str, day: str) -> DataFrame:
        """The day's grid of a building; unknown ones and days without data raise ``Unknown``."""
        key = self.spark.range(1).select(export.parse_building_id(F.lit(building_id)).alias("k")).first().k
        rows = self.series.filter((F.col("gp_nr") == key) & (F.to_date("ts") == F.lit(day).cast("date"))) if key is not None else None
        if rows is None or rows.isEmpty():
            raise Unknown(f"{building_id} on {day}")
        return export.profile(rows, key, day)
