"""Reading: delimited files of any dialect, keys from paths, discovery by header, optional inputs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How umlauts fold in column names.
FOLDS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def normalise(name: str) -> str:
    """Lower case, umlauts folded, letters and digits only."""
    low = name.strip().lower().lstrip("﻿")
    return re.sub("[^0-9a-z]", "", "".join(FOLDS.get(c, c) for c in low))


def find_column(columns: Iterable[str], *candidates: str) -> str | None:
    """The first candidate, in their order, that a column equals when both are normalised."""
    known = {normalise(c): c for c in reversed(list(columns))}
    return next((known[n] for n in map(normalise, candidates) if n in known), None)


def find_containing(columns: Iterable[str], needle: str) -> str | None:
    return next((c for c in columns if needle.lower() in c.lower()), None)


def sniff(line: str, candidates: str = ";,\t|") -> str:
    """The candidate that occurs most in a first line; a comma if none does."""
    best = max(candidates, key=line.count)
    return best if line.count(best) else ","


def first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).head(1)
    return rows[0][0].lstrip("﻿") if rows else ""


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", pattern: str | None = None) -> DataFrame:
    """All columns as strings; the dialect is sniffed, gzip is transparent, ragged lines are kept, a byte
    order mark and unnamed trailing columns go."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("encoding", encoding).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path, sep=sep or sniff(first_line(spark, path)))
    named = [c for c in df.columns if c and not re.fullmatch(r"_c\d+", c)]
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in named])


def header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line, read as UTF-8 or, where it is none, as Latin-1."""
    line = first_line(spark, path)
    if "\ufffd" in line:
        line = spark.read.option("encoding", "ISO-8859-1").option("delimiter", "\x01").option("quote", "").csv(path).head()[0]
    return [c.strip().strip('"') for c in line.split(sniff(line))] if line else []


def preview(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    return read_delimited(spark, path).limit(n)


def rename_found(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns under wanted names, found by normalised candidates; missing ones become null strings."""
    found = {k: find_column(df.columns, *v) for k, v in wanted.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def place_from_path(path: Column | None = None) -> Column:
    """A folder of four or five digits right above the file, else four digits in the file's name; else null."""
    p = F.col("_metadata.file_path") if path is None else path
    return F.coalesce(F.nullif(F.regexp_extract(p, r"/(\d{4,5})/[^/]+$", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"(?:^|[^0-9])(\d{4})(?:[^0-9][^/]*)?$", 1), F.lit("")))


def period_from_path(path: Column | None = None) -> tuple[Column, Column]:
    """Year folder above the file, and the month in a name like 2024-03 or 202403."""
    p = F.col("_metadata.file_path") if path is None else path
    year = F.nullif(F.regexp_extract(p, r"/((?:19|20)\d{2})/[^/]+$", 1), F.lit("")).try_cast("int")
    month = F.nullif(F.regexp_extract(p, r"(?:19|20)\d{2}[-_]?(0[1-9]|1[0-2])[^/]*$", 1), F.lit("")).try_cast("int")
    return year, month


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> list[tuple[str, int, int]]:
    """(path, size, mtime) of files under a folder, by any Hadoop file system, sorted by path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    rx, out = re.compile(pattern.replace(".", r"\.").replace("*", ".*")), []
    found = fs.listFiles(folder, True)
    while found.hasNext():
        f = found.next()
        if rx.fullmatch(f.getPath().getName()):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def discover(spark: SparkSession, path: str, kinds: dict[str, list[str]]) -> dict[str, list[str]]:
    """Files of each kind: those whose header has all the kind's columns, the first kind that fits."""
    out: dict[str, list[str]] = {k: [] for k in kinds}
    for name, _, _ in list_files(spark, path):
        columns = header(spark, name)
        for kind, needed in kinds.items():
            if all(find_column(columns, n) for n in needed):
                out[kind].append(name)
                break
    return out


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def look_up(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted keys in one scan."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def assert_schema(df: DataFrame, schema, exact: bool = True) -> DataFrame:
    """Raises unless the columns and types are those of ``schema`` (at least those, if not exact)."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in schema}
    wrong = {k: (have.get(k), v) for k, v in want.items() if have.get(k) != v}
    if wrong or (exact and list(have) != list(want)):
        raise ValueError(f"schema differs: {wrong or sorted(set(have) ^ set(want)) or 'order of columns'}")
    return df


def union_relaxed(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts: columns by name, missing ones null, each with the widest of its types."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
