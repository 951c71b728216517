"""Backup as JSON and export as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import format_minute
from ..functions.text import csv_field


def write_backup(rows: DataFrame, path: str) -> None:
    """Every column, so that reading restores the table."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_backup(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def expense_lines(rows: DataFrame) -> DataFrame:
    """One CSV line per expense: time, shop, category, card, amount, memo."""
    return rows.select(F.concat_ws(",", format_minute(F.col("ts")), *(csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("storeName", "category", "cardName", "amount", "memo"))).alias("line"), "ts", "id")


def income_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", format_minute(F.col("ts")), *(csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("type", "source", "amount", "memo"))).alias("line"), "ts", "id")


def combined_lines(expenses: DataFrame, incomes: DataFrame) -> DataFrame:
    """Both kinds in one table, spending negative."""
    e = expenses.select("ts", "id", F.lit("지출").alias("kind"), F.col("storeName").alias("name"), (-F.col("amount")).alias("signed"))
    i = incomes.select("ts", "id", F.lit("수입").alias("kind"), F.coalesce(F.when(F.col("source") != "", F.col("source")), F.col("type")).alias("name"), F.col("amount").alias("signed"))
    both = e.unionByName(i)
    return both.select(F.concat_ws(",", format_minute(F.col("ts")), F.col("kind"), csv_field(F.col("name")), F.col("signed").cast("string")).alias("line"), "ts", "id")


def write_csv(lines: DataFrame, header: str, path: str) -> None:
    """Lines in order of time, one sorted range per file, replacing what is there. The header, with a byte order mark, is the file ``00000-header``: files joined in order of their names are the whole."""
    lines.orderBy(F.desc("ts"), "id").select("line").write.mode("overwrite").text(path)
    jvm = lines.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path, "00000-header")
    out = place.getFileSystem(lines.sparkSession._jsparkSession.sessionState().newHadoopConf()).create(place)
    try:
        out.write(bytearray(f"\ufeff{header}\n".encode()))
    finally:
        out.close()
