"""Readers, writers and streams on real files."""

import gzip

import pytest
from pyspark.sql import functions as F

from wattloom.sources import files, sinks
from wattloom.streaming import live


def test_column_names_fold():
    assert files.normalise("Wärme-Pumpe (x)") == "waermepumpex"
    assert files.find_column(["MP ID", "Datum"], "date", "mp_id") == "MP ID" and files.find_column(["a"], "b") is None
    assert files.sniff("a;b;c,d") == ";" and files.sniff("abc") == "," and files.find_containing(["Ladestation für E"], "station") == "Ladestation für E"


def test_delimited_files(spark, tmp_path):
    folder = tmp_path / "2024" / "5012"
    folder.mkdir(parents=True)
    (folder / "a_2024-03.csv").write_text("﻿MP ID;00:15;\nm1;1,5;\nm2;\n", encoding="utf-8")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("PLZ,temperature_2m\n5000,1.5\n")
    df = files.read_delimited(spark, str(folder / "a_2024-03.csv"))
    assert df.columns == ["MP ID", "00:15"] and [tuple(r) for r in df.collect()] == [("m1", "1,5"), ("m2", None)]
    assert files.read_delimited(spark, str(tmp_path / "b.csv.gz")).collect()[0]["PLZ"] == "5000"
    found = files.discover(spark, str(tmp_path), {"weather": ["temperature_2m"], "load": ["MP ID", "00:15"]})
    assert [len(v) for v in found.values()] == [1, 1]
    place = spark.read.text(str(folder)).select(files.place_from_path().alias("p"), *[c.alias(n) for c, n in zip(files.period_from_path(F.lit("/x/2024/a_2024-03.csv")), ("y", "m"), strict=True)]).first()
    assert tuple(place) == ("5012", 2024, 3)
    assert files.preview(spark, str(folder), 1).count() == 1
    named = files.rename_found(df, {"mp_id": ["mp id"], "nothing": ["zzz"]})
    assert named.columns == ["mp_id", "nothing"] and named.first()["nothing"] is None


def test_manifest_and_resume(spark, tmp_path):
    at, listed = str(tmp_path / "m.json"), [("a", 1, 2), ("b", 1, 2)]
    assert sinks.check_resume(spark, at, {"k": 1}, listed) == listed
    sinks.write_manifest(spark, at, "ingest", {"k": 1}, {"rows": 5}, listed[:1])
    assert sinks.check_resume(spark, at, {"k": 1}, [("a", 1, 3), *listed]) == [("a", 1, 3), ("b", 1, 2)]
    with pytest.raises(ValueError):
        sinks.check_resume(spark, at, {"k": 2}, listed)


def test_tables_documents_and_optional_inputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "5000", 0.5), (2, "5001", 0.7)], "gp_nr bigint, plz string, v double")
    sinks.write_table(df, str(tmp_path / "t"), by=["plz"], sort=["gp_nr"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("plz = 5001").count() == 1
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.write_documents(spark.createDataFrame([(1, False, "{}"), (2, True, '{"a":1}')], "gp_nr bigint, featured boolean, document string"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 2
    files.assert_schema(df, df.schema)
    with pytest.raises(ValueError):
        files.assert_schema(df.drop("v"), df.schema)


def test_streams_resume_and_sum(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    make = lambda rows: spark.createDataFrame(rows, "ts string, k int, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    make([("2024-01-01 00:00:00", 1, 5.0), ("2024-01-01 00:15:00", 1, 4.0), ("2024-01-01 01:00:00", 1, 6.0)])
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        live.drain(live.windowed_sums(live.file_stream(spark, src, schema), "ts", ["k"], "v", late="0 seconds"), out, mark)
    make([("2024-01-01 05:00:00", 1, 1.0)])
    live.drain(live.windowed_sums(live.file_stream(spark, src, schema), "ts", ["k"], "v", late="0 seconds"), out, mark)
    assert spark.read.parquet(out).agg(F.sum("total")).first()[0] == 15.0
    batch = live.live_sessions(spark.read.parquet(src), "ts", ["k"], "v", 4.0)
    assert sorted(r.n for r in batch.collect()) == [1, 2]


def test_headers_in_latin_1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Zähler;Ort\n1;2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("Zähler;Ort\n1;2\n".encode())
    assert files.header(spark, str(tmp_path / "a.csv")) == files.header(spark, str(tmp_path / "b.csv")) == ["Zähler", "Ort"]
