"""Readers: declared schemas, multi-format tables, JSON containers, prefiltered lines, marked and hashed packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A normalised trace; the reference answer is a tagged JSON string.
TRACE = T.StructType(
    [
        T.StructField("problem_id", T.StringType()), T.StructField("source_dataset", T.StringType()), T.StructField("source_subset", T.StringType()), T.StructField("source_generator", T.StringType()),
        T.StructField("problem_text", T.StringType()), T.StructField("reasoning_steps", T.ArrayType(T.StringType())), T.StructField("final_answer_text", T.StringType()), T.StructField("reference_answer", T.StringType()),
        T.StructField("first_error_index", T.IntegerType()), T.StructField("index_base", T.StringType()), T.StructField("final_answer_correct", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

FORBIDDEN = ("free_running", "final_test_outcomes")


class AccessError(ValueError):
    """A path that an analysis must not read."""


def guard(path: str, forbidden: tuple[str, ...] = FORBIDDEN) -> str:
    found = [x for x in forbidden if x in path.lower()]
    if found:
        raise AccessError(f"{path}: {found}")
    return path


def refused(path: Column, forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """The forbidden names in a path of a manifest, an empty list if it may be read; none of a null."""
    low = F.lower(path)
    return F.filter(F.array(*[F.lit(x) for x in forbidden]), lambda x: F.coalesce(low.contains(x), F.lit(False)))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TRACE) -> DataFrame:
    """One object a line, with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(guard(path))


def read_container(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """A JSON file with rows below ``data``, ``examples`` or ``rows``."""
    lists = T.StructType([T.StructField(k, T.ArrayType(row)) for k in ("data", "examples", "rows")])
    df = spark.read.schema(lists).option("multiLine", True).json(guard(path))
    return df.select(F.explode(F.coalesce("data", "examples", "rows")).alias("_r")).select("_r.*")


def read_globbed(spark: SparkSession, root: str, schema: T.StructType | str, pattern: str = "*.annotated.json", folders: tuple[str, ...] = ()) -> DataFrame:
    """JSON rows of all files below ``root`` whose names match, in the named folders or in any, with the ``file`` and its ``folder``."""
    df = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(guard(root))
    df = df.withColumn("file", F.col("_metadata.file_path")).withColumn("folder", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return df.where(F.col("folder").isin(*folders)) if folders else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV with a header, by suffix; only the named columns."""
    guard(path)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("jsonl", "ndjson", "json"):
        df = spark.read.json(path)
    elif suffix == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.select(*columns) if columns else df


def read_selected_lines(spark: SparkSession, path: str, ids: DataFrame, schema: T.StructType, id_: str = "trace_id") -> DataFrame:
    """Rows of a JSON-lines file whose id is in ``ids``; other lines are never decoded."""
    lines = spark.read.text(guard(path))
    found = lines.withColumn(id_, F.regexp_extract("value", rf'"{id_}"\s*:\s*"([^"]*)"', 1)).join(ids.select(id_).distinct(), id_, "left_semi")
    return found.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_packs(spark: SparkSession, manifest: DataFrame, markers: DataFrame, data: str) -> DataFrame:
    """Rows of complete packs: each pack of the manifest (pack_id, path) needs a marker (pack_id, status, sha256) that equals its bytes.

    Hashes are computed where the files are read, through the binary reader.
    """
    files = spark.read.format("binaryFile").load([r["path"] for r in manifest.select("path").collect()] if data == "" else data)
    hashed = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("actual"))
    named = manifest.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).join(markers, "pack_id", "left").join(hashed, "file", "left")
    bad = named.where("status is null or status <> 'complete' or sha256 is null or actual is null or sha256 <> actual")
    if not bad.isEmpty():
        raise ValueError(f"incomplete or changed packs: {[r['pack_id'] for r in bad.select('pack_id').limit(20).collect()]}")
    return spark.read.parquet(*[r["path"] for r in manifest.select("path").collect()])


def index_vectors(features: DataFrame, index: str) -> DataFrame:
    """Checks that a row index runs from 0 to n - 1 without gaps or repeats."""
    r = features.agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("k"), F.count(F.lit(1)).alias("n")).first()
    if r["n"] and not (r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["k"] == r["n"]):
        raise ValueError(f"{index} is no index of {r['n']} rows: {r}")
    return features


def decode_lines(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """JSON texts as rows of a declared schema; what does not parse fails the read."""
    return lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def selected_lines(lines: DataFrame, ids: DataFrame, id_: str, column: str = "value") -> DataFrame:
    """JSON texts whose id, taken by pattern, is wanted: the others are not decoded."""
    own = F.regexp_extract(column, rf'"{id_}":\s*"?([^",}}]*)', 1)
    return lines.withColumn("_id", own).join(ids.select(F.col(id_).cast("string").alias("_id")).distinct(), "_id", "left_semi").drop("_id")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a path, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
