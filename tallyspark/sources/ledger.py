"""The ledger: expenses and incomes as fixed-schema views over stored tables.

Times are local wall-clock (``ts``, no zone) with epoch milliseconds beside them (``dateTime``);
both are computed without the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; scans read the columns and row groups that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a wall-clock time taken as UTC."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return seconds * 1000


def wall_clock(ms: Column) -> Column:
    """The wall-clock time (no zone) of epoch milliseconds taken as UTC."""
    return F.timestamp_add("SECOND", F.floor(ms / 1000).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expenses; the customer gives shop and card."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), F.floor("o_totalprice").cast("long").alias("amount"), F.col("c_name").alias("storeName"), F.col("o_orderpriority").alias("category"),
        F.col("c_mktsegment").alias("cardName"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), millis(F.col("o_orderdate")).alias("dateTime"),
        F.when(key % 2 == 1, F.col("o_orderstatus")).alias("memo"), (key % 7 == 0).alias("is_fixed"),
        F.when(key % 10 == 0, "TRANSFER").otherwise("EXPENSE").alias("transaction_type"),
        F.when(key % 20 == 0, "DEPOSIT").when(key % 10 == 0, "WITHDRAWAL").otherwise("").alias("transfer_direction"),
        F.concat(F.lit("1588"), F.lpad((key % 97).cast("string"), 4, "0")).alias("senderAddress"),
        F.concat_ws("_", F.concat(F.lit("1588"), F.lpad((key % 97).cast("string"), 4, "0")), millis(F.col("o_orderdate")).cast("string"), key.cast("string")).alias("smsId"),
    )


EXPENSES_SQL = """
expenses AS (
  SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS amount, c_name AS storeName, o_orderpriority AS category, c_mktsegment AS cardName,
    o_orderdate::TIMESTAMP AS ts, epoch_ms(o_orderdate::TIMESTAMP)::BIGINT AS dateTime, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS memo,
    o_orderkey % 7 = 0 AS is_fixed, CASE WHEN o_orderkey % 10 = 0 THEN 'TRANSFER' ELSE 'EXPENSE' END AS transaction_type,
    CASE WHEN o_orderkey % 20 = 0 THEN 'DEPOSIT' WHEN o_orderkey % 10 = 0 THEN 'WITHDRAWAL' ELSE '' END AS transfer_direction,
    '1588' || lpad((o_orderkey % 97)::VARCHAR, 4, '0') AS senderAddress,
    '1588' || lpad((o_orderkey % 97)::VARCHAR, 4, '0') || '_' || epoch_ms(o_orderdate::TIMESTAMP)::VARCHAR || '_' || o_orderkey::VARCHAR AS smsId
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def planted(rows: DataFrame) -> DataFrame:
    """Expenses with what edits look for: copies of some rows under ids of their own, and unclassified rows."""
    open_ = rows.withColumn("category", F.when(F.col("id") % 31 == 0, "미분류").otherwise(F.col("category")))
    return open_.unionByName(rows.filter("id % 97 = 0").withColumn("id", F.col("id") + 1_000_000_000))


PLANTED_SQL = EXPENSES_SQL.replace("expenses AS", "stored AS", 1) + """,
expenses AS (
  SELECT * REPLACE (CASE WHEN id % 31 = 0 THEN '미분류' ELSE category END AS category) FROM stored
  UNION ALL SELECT * REPLACE (id + 1000000000 AS id) FROM stored WHERE id % 97 = 0
)"""


def incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases among events as incomes; these have a time of day."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    key = F.col("event_id")
    return e.select(
        key.alias("id"), F.floor(F.col("value") * 100).cast("long").alias("amount"), F.when(key % 3 == 0, "급여").when(key % 3 == 1, "정산").otherwise("이체").alias("type"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string"))).alias("source"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), millis(F.col("ts")).alias("dateTime"), F.when(key % 5 == 0, F.concat(F.lit("memo "), key.cast("string"))).alias("memo"),
        (key % 6 == 0).alias("isRecurring"),
    )


INCOMES_SQL = """
incomes AS (
  SELECT event_id AS id, floor(value * 100)::BIGINT AS amount, CASE event_id % 3 WHEN 0 THEN '급여' WHEN 1 THEN '정산' ELSE '이체' END AS type,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'user' || (user_id % 50)::VARCHAR END AS source,
    ts::TIMESTAMP AS ts, (epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000)::BIGINT AS dateTime, CASE WHEN event_id % 5 = 0 THEN 'memo ' || event_id::VARCHAR END AS memo,
    event_id % 6 = 0 AS isRecurring
  FROM events WHERE event_type = 'purchase'
)"""


def budgets(spark: SparkSession) -> DataFrame:
    """Monthly limits that hold for every month (``default``)."""
    rows = [("1-URGENT", 900_000_000, "default"), ("2-HIGH", 5_000_000, "default"), ("5-LOW", 12_000_000, "default"), ("전체", 40_000_000, "default")]
    return spark.createDataFrame(rows, "category string, monthlyLimit long, yearMonth string")


BUDGETS_SQL = """
budgets(category, monthlyLimit, yearMonth) AS (
  VALUES ('1-URGENT', 900000000::BIGINT, 'default'), ('2-HIGH', 5000000::BIGINT, 'default'), ('5-LOW', 12000000::BIGINT, 'default'), ('전체', 40000000::BIGINT, 'default')
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: id, body, address, date (epoch milliseconds)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.concat(F.lit("+82-2-"), F.lpad((F.col("conv_id") % 40).cast("string"), 4, "0")).alias("address"),
        (F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000 + F.lit(1_700_000_000_000)).alias("date"),
    )
