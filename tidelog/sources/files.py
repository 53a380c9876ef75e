"""Lines, whole files, keyed lines, generated records, typed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """value: a record for each line, or with ``raw`` one for each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("value")) if raw else spark.read.text(path).select(F.col("value").cast("binary"))


def split_key(line: Column, separator: str) -> tuple[Column, Column]:
    """Key and value of a line, split at the first separator; null without one."""
    if not separator:
        raise ValueError("the key separator is empty")
    at = F.instr(line, separator)
    n = len(separator)
    found = at > 0
    return F.when(found, F.substring(line, F.lit(1), at - 1)), F.when(found, F.substring(line, at + n, F.length(line)))


def keyed_lines(lines_df: DataFrame, separator: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records with key and value; lines that have no separator, which are left out)."""
    line = F.col(column).cast("string")
    key, value = split_key(line, separator)
    rest = [c for c in lines_df.columns if c not in ("key", "value", column)]
    split = lines_df.select(*rest, line.alias("_line"), key.alias("_key"), value.alias("_value"))
    good = split.where(F.col("_key").isNotNull()).select(*rest, F.col("_key").cast("binary").alias("key"), F.col("_value").cast("binary").alias("value"))
    return good, split.where(F.col("_key").isNull()).select(*rest, F.col("_line").alias("line"))


def generated(spark: SparkSession, template: str, per_second: int = 1) -> DataFrame:
    """An endless stream of the same value, at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.unix_millis("timestamp").alias("timestamp"), F.lit(None).cast("binary").alias("key"), F.lit(template).cast("binary").alias("value"))


def generated_batch(spark: SparkSession, template: str, interval_s: int, timeout_s: int, start_ms: int = 0) -> DataFrame:
    """What a generator with an interval yields until its timeout."""
    n = timeout_s // interval_s
    return spark.range(n).select((F.col("id") * interval_s * 1000 + start_ms).alias("timestamp"), F.lit(None).cast("binary").alias("key"), F.lit(template).cast("binary").alias("value"))


def typed(log: DataFrame, schema: T.StructType, required: list[str] | None = None, checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of a topic with columns: (rows with the schema's columns besides the log's; records that were rejected, with a reason).

    A required field that is missing, of another type, or fails its check rejects the record, and reading goes on. Unknown fields
    are ignored."""
    required = schema.names if required is None else required
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = log.withColumn("_row", F.from_json(F.col("value").cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    field = lambda n: F.col("_row")[n]
    reason = F.when(F.col("_row").isNull() | field("_corrupt").isNotNull(), F.lit("malformed record"))
    for n in required:
        reason = reason.when(field(n).isNull(), F.lit(f"missing field {n}"))
    for n, check in (checks or {}).items():
        reason = reason.when(~F.coalesce(check, F.lit(True)), F.lit(f"invalid field {n}"))
    rows = rows.select(*log.columns, *[field(n).alias(n) for n in schema.names], F.col("_row")["_corrupt"].alias("_corrupt"), F.col("_row")).withColumn("_reason", reason)
    return rows.where(F.col("_reason").isNull()).drop("_row", "_corrupt", "_reason"), rows.where(F.col("_reason").isNotNull()).select(*log.columns, F.col("_reason").alias("reason"))
