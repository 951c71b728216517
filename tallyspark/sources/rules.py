"""Rule files: JSON nested as sender, type, key; overlays of several sources; vector rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.extract import group_index

FIELDS = (
    "type string, priority int, bodyRegex string, amountGroup string, storeGroup string, cardGroup string, dateGroup string, status string, source string, version int"
)
SHAPE = f"struct<version:int, sms_rules:map<string, map<string, map<string, struct<{FIELDS.replace(' string', ':string').replace(' int', ':int')}>>>>>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file as rows."""
    return flatten(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def flatten(files: DataFrame) -> DataFrame:
    """Rows of (senderAddress, type, ruleKey, ...) of files' JSON."""
    rules = files.select(F.from_json("json", SHAPE)["sms_rules"].alias("r"))
    rows = rules.select(F.explode("r").alias("senderAddress", "t")).select("senderAddress", F.explode("t").alias("_type", "k")).select("senderAddress", "_type", F.explode("k").alias("ruleKey", "v"))
    text = lambda c, other="": F.coalesce(F.col(f"v.{c}"), F.lit(other))
    return rows.select(
        "senderAddress", F.coalesce(F.col("v.type"), F.col("_type")).alias("type"), "ruleKey", text("bodyRegex").alias("bodyRegex"),
        *(text(c).alias(c) for c in ("amountGroup", "storeGroup", "cardGroup", "dateGroup")), F.coalesce("v.priority", F.lit(600)).alias("priority"), text("status", "ACTIVE").alias("status"),
        text("source", "asset").alias("source"), F.coalesce("v.version", F.lit(1)).alias("version"), F.lit(0).alias("matchCount"), F.lit(0).alias("failCount"),
        F.lit(0).cast("long").alias("lastMatchedAt"), F.lit(0).cast("long").alias("updatedAt"),
    )


def repaired(pattern: Column) -> Column:
    """A pattern whose backslashes were escaped twice on the way."""
    return F.when(pattern.rlike(r"\\\\[dswbnDSWB\[\]().*+?{}|]"), F.regexp_replace(pattern, r"\\\\(?=[dswbnDSWB\[\]().*+?{}|])", r"\\")).otherwise(pattern)


def remote(files: DataFrame) -> DataFrame:
    """A remote file's rules: repaired, and only those with a pattern."""
    return flatten(files).withColumn("bodyRegex", repaired(F.col("bodyRegex"))).withColumn("source", F.lit("remote")).filter("bodyRegex <> ''")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Rules of two sources: of one key that of ``over``."""
    keys = ["senderAddress", "type", "ruleKey"]
    return base.join(over.select(*keys), keys, "left_anti").select(*base.columns).unionByName(over.select(*base.columns))


def indexed(rules: DataFrame) -> DataFrame:
    """Rules with group numbers for their group names. Rules are configuration, read once on the driver; patterns that don't compile go."""
    rows = [r.asDict() for r in rules.collect()]  # a rule file's rows: tens to hundreds
    out = []
    for r in rows:
        try:
            re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", r["bodyRegex"]))
        except re.error:
            continue
        for name in ("amount", "store", "card", "date"):
            r[f"{name}Index"] = group_index(r["bodyRegex"], r[f"{name}Group"])
        out.append(r)
    columns = [*rules.columns, "amountIndex", "storeIndex", "cardIndex", "dateIndex"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rules.schema) + ", amountIndex int, storeIndex int, cardIndex int, dateIndex int"
    return rules.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in out], kinds)


def vector_rules(rows: DataFrame) -> DataFrame:
    """Vector rules that can be used: vector, amount and shop pattern; not disabled; a least similarity."""
    return rows.filter((F.size("vector") > 0) & (F.col("amountRegex") != "") & (F.col("storeRegex") != "") & F.coalesce("enabled", F.lit(True))).withColumn(
        "minSimilarity", F.coalesce("minSimilarity", F.lit(lx.SIMILARITY["remote_rule"]))
    )


def category_words(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A dictionary of categories and their words, in declared order: a JSON object of lists, by whatever file system its path names."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {c: tuple(ws) for c, ws in json.loads(text).items()}
