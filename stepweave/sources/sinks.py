"""Writers: atomic, write-once, strict JSON, resume."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; local sessions without one get their own."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stepweave-")
    return f"{base}/{uuid.uuid4().hex}"


def strict_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON in which NaN and infinities are null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias(name))


def row_hash(df: DataFrame, name: str = "row_sha256") -> DataFrame:
    """SHA-256 of the canonical JSON (columns by name) of each row."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a committed table is at a path of any file system that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> str:
    """Writes Parquet; what is there already must hold the same rows. Returns ``written`` or ``kept``."""
    spark = df.sparkSession
    if exists(spark, path):
        if not same_rows(spark.read.parquet(path), df):
            raise FileExistsError(f"{path} holds other rows")
        return "kept"
    df.write.mode("errorifexists").parquet(path)
    return "written"


def resume(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """Whether a committed table with the columns is there, so that its step can be skipped."""
    return exists(spark, path) and set(columns) <= set(spark.read.parquet(path).columns)


def publish(df: DataFrame, path: str, order: list[str], columns: list[str]) -> str:
    """A compact export: chosen columns, ordered, written once."""
    return write_once(df.select(*columns).orderBy(*order), path)


def atomic_json(path: str, value: object) -> None:
    """A small JSON file on the driver's side: written beside its place, then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def shared_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON file in any store that Spark can write: written beside its place, then renamed; for a moment there may be none."""
    place, part = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"{path} could not be written")


def shared_text(spark: SparkSession, path: str) -> str:
    """The text of a small file in any store that Spark can read."""
    return spark.read.text(path, wholetext=True).first()[0]


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; at most ``most`` rows are taken."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
