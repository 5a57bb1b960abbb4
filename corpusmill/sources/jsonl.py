"""JSON lines: scans with a policy for bad lines and missing files, and sinks.

A scan reads text, so every line keeps its file; blank lines are skipped. Lines are parsed by Spark's own JSON reader
functions against a schema. Positions (line_no) cost a pass over the line counts of the partitions, so they are made only
on demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions import jsonx


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """value, file (and line_no, 0-based within the file) of the lines that aren't blank.

    numbered: the lines of a file are numbered in one task a file; for files of a size that one task reads."""
    raw = spark.read.text(path, wholetext=numbered).withColumn("file", F.input_file_name())
    if numbered:
        raw = raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return raw.where(F.col("value").rlike(r"\S"))


def scan(spark: SparkSession, path: str | list[str], schema: StructType | str, bad: str = "fail", missing: str = "fail", required: tuple[str, ...] = (), numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records with file, rejected lines: file, value, reason).

    bad: "fail" raises on a line that is no JSON object or lacks a required key when the records are read, "skip" leaves it
    to the rejects. missing: what a path without files gives: "fail" or "empty". A required key must be there; its value
    may be null unless the schema says otherwise."""
    paths = [path] if isinstance(path, str) else path
    if missing == "empty":
        paths = [p for p in paths if exists(spark, p)]
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not paths:
        none = spark.createDataFrame([], struct).withColumn("file", F.lit(None).cast("string"))
        return none, spark.createDataFrame([], "file string, value string, reason string")
    raw = lines(spark, paths, numbered)
    keys = F.json_object_keys("value")
    lacking = F.array_except(F.array(*map(F.lit, required)), keys) if required else F.array().cast("array<string>")
    reason = F.when(~jsonx.is_strict(F.col("value")) | keys.isNull(), F.lit("not a JSON object")).when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    tagged = raw.withColumn("reason", reason)
    at = [c for c in ("file", "line_no") if c in raw.columns]
    parsed = F.from_json("value", struct).alias("r")
    if bad == "fail":
        message = F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.col("reason"))
        checked = tagged.withColumn("value", F.when(F.col("reason").isNull(), F.col("value")).otherwise(F.raise_error(message).cast("string")))
        return checked.select(parsed, *at).select("r.*", *at), tagged.limit(0).select("file", "value", "reason")
    return tagged.where("reason is null").select(parsed, *at).select("r.*", *at), tagged.where("reason is not null").select("file", "value", "reason")


def with_default_id(records: DataFrame, column: str = "id", prefix: str = "record_") -> DataFrame:
    """A null id becomes the prefix and the line's number (1-based)."""
    return records.withColumn(column, F.coalesce(column, F.concat(F.lit(prefix), (F.col("line_no") + 1).cast("string"))))


def suites(spark: SparkSession, folder: str, schema: str = "id string, prompt string") -> DataFrame:
    """All *.jsonl files of a folder, with suite (the file's name without its ending); none is an error."""
    got, _ = scan(spark, f"{folder.rstrip('/')}/*.jsonl", schema, required=("id", "prompt"))
    return got.withColumn("suite", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).drop("file")


def last_by_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """A cache of one row a key: the last one holds; rows without the key are dropped."""
    from corpusmill.operators import joins

    return joins.last_of(records, key, order)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file of earlier results; a missing file has none, bad lines are ignored."""
    got, _ = scan(spark, path, "id string", bad="skip", missing="empty")
    return got.where("id is not null").select("id").distinct()


def write(df: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None, nulls: bool = True) -> None:
    """JSON lines. nulls: null fields are written too. order: range-partitioned and sorted, so that the parts in turn are
    in order."""
    out = df if not order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode(mode).option("ignoreNullFields", str(not nulls).lower()).json(path)


def write_parted(tagged: DataFrame, accepted: str, rejected: str, mode: str = "append") -> None:
    """Rows without a reason to one folder, the others to the other. The tagged table should be staged if it is dear."""
    write(tagged.where("reason is null").drop("reason"), accepted, mode)
    write(tagged.where("reason is not null"), rejected, mode)


def without_private(df: DataFrame) -> DataFrame:
    """Without the columns whose name begins with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])
