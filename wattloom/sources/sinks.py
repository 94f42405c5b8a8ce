"""Writing: partitioned tables, JSON documents, manifests."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] = (), sort: list[str] = ()) -> None:
    """Parquet, committed as a whole; rows of one partition value are written together and sorted."""
    if by:
        df = df.repartition(*by)
    if sort:
        df = df.sortWithinPartitions(*by, *sort)
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_documents(docs: DataFrame, path: str, order: list[str] = ("featured", "gp_nr")) -> None:
    """One JSON document a line, featured ones first."""
    cols = [F.col(c).desc() if c == "featured" else F.col(c) for c in order]
    docs.orderBy(*cols).select("document").write.mode("overwrite").text(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a text file; readers see the old text or the new one.  On a mounted file system it has no checksum
    beside it, so that it may be edited by hand."""
    p, part = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.part"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs = fs.getRawFileSystem()
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.crc"), False)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def config_hash(config: dict) -> str:
    return sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, stage: str, config: dict, counts: dict[str, int], files: list[tuple[str, int, int]] = ()) -> dict:
    entry = {"stage": stage, "config": config, "config_hash": config_hash(config), "rows": counts, "files": [list(f) for f in files]}
    put_text(spark, path, json.dumps(entry, default=str))
    return entry


def finished_files(spark: SparkSession, path: str, config: dict) -> list[tuple[str, int, int]]:
    """The files that a manifest has, of this configuration; after a break in its writing, those of the part."""
    text = get_text(spark, path) or get_text(spark, f"{path}.part")
    entry = json.loads(text) if text else {"files": [], "config_hash": config_hash(config)}
    return [tuple(f) for f in entry["files"]] if entry["config_hash"] == config_hash(config) else []


def check_resume(spark: SparkSession, path: str, config: dict, files: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Files still to do: those that the manifest doesn't have with this size and time.

    A manifest of another configuration is an error, since its parts can't be mixed with new ones.
    """
    text = get_text(spark, path) or get_text(spark, f"{path}.part")
    if text is None:
        return list(files)
    entry = json.loads(text)
    if entry["config_hash"] != config_hash(config):
        raise ValueError("the manifest was written under another configuration")
    done = {tuple(f) for f in entry["files"]}
    return [f for f in files if tuple(f) not in done]


def markdown_report(sections: dict[str, dict]) -> str:
    return "\n".join(f"## {k}\n\n```json\n{json.dumps(v, indent=2, default=str)}\n```\n" for k, v in sections.items())
