"""Operator 2: mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's documents are laid in a fixed order; each has an expected number of copies (its source's
rate). The running sum of expected copies, shifted by one random offset per source, crosses whole
numbers; a document is emitted once for each number crossed in its step. The order is by size class, so
each stretch of like-sized documents gives its share and taken words keep close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Expected copies and offsets are whole multiples of 1 / UNIT: running sums are exact in any order.
UNIT = 1 << 24
#: A size class of a source is dealt into one stretch for so many of its rows; so many stretches make a block.
STRETCH_ROWS, BLOCK_STRETCHES = 64, 4_096
#: Size classes of sources (one row of a few numbers each) up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(source: str) -> Column:
    """A source as a join key: a null is a key of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: rows, source_size, target (double).

    Sources in code point order, null last, take ``weights`` in turn. Targets divide ``share`` of all
    sizes by weight; none is above ``most`` times its source's size, and what is cut goes to the
    others by weight until none is above. That is min(most * size, level * weight) for one level,
    found in one running sum over sources by size / weight. Their order and that sum are of all sources,
    so one row per source (a name and a few numbers) goes to one task.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    done = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
        .withColumn("fits", F.col("cap") > F.col("level") * F.col("weight"))
    )
    # the first source that keeps below its cap sets the level for all that follow
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)
    per = per.withColumn("all_level", first["level"])
    target = F.when(F.col("all_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("all_level") * F.col("weight")))
    return per.select("source", "rows", "source_size", target.alias("target"))


def expected_units(target: Column, source_size: Column) -> Column:
    """A document's expected copies in 1 / UNIT: its source's rate, 0 for a source without words."""
    return F.when(source_size > 0, F.round(target / source_size * UNIT)).otherwise(F.lit(0.0)).cast("long")


def offset_units(source_key: Column, seed: int) -> Column:
    """A source's offset in [0, UNIT): 24 bits of md5 of the seed and the source."""
    salted = F.concat(F.lit(f"{seed}:"), source_key)
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 6), 16, 10).cast("long")


def spread(doc_id: Column, text: Column, seed: int) -> Column:
    """A whole number in [0, 2^32) by 32 bits of md5 of the id, or of the text where that is null: order within a size class."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def _counted(documents: DataFrame, own: dict[str, str], seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The columns of ``own`` (name to alias) with size, source_size, target and copies of each document.

    All rows stay; ``copies`` may be 0. Null texts have size 0, null sources form one source of their
    own, an empty table gives no rows. Repeated rows are documents of their own. The running sum has
    three levels, so that a source with a third of all rows is no task's: rows within a stretch of a
    size class (square root of the size), stretches within a block of ``BLOCK_STRETCHES``, and blocks of
    a source. Words are counted once and what is counted is kept without the texts; only rows that must
    come out whole are read once more.
    """
    base = documents.select(
        *(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in own.items()),
        F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        spread(F.col("doc_id").cast("long"), F.col("text"), seed).alias("_spread"),
    ).withColumn("_key", key("source")).withColumn("_class", F.floor(F.sqrt(F.col("size"))).cast("long"))
    narrow = set(own) == {"doc_id"}
    light = cut(base if narrow else base.drop(*own.values()))
    plan = source_targets(light.select("source", "size"), share, most, weights)  # one row per source
    plan = plan.select(
        key("source").alias("_key"), "source_size", "target", expected_units(F.col("target"), F.col("source_size")).alias("units"), offset_units(key("source"), seed).alias("offset")
    )
    classes = light.groupBy("_key", "_class").agg(F.ceil(F.count(F.lit(1)) / STRETCH_ROWS).alias("_stretches"))
    plan = cut(classes.join(plan, "_key"))  # one row per size class of a source
    small = plan.count() <= BROADCAST_CLASSES
    stretch, block = ("_key", "_class", "_stretch"), ("_key", "_class", "_block")

    def dealt(rows: DataFrame) -> DataFrame:
        got = rows.join(F.broadcast(plan) if small else plan, ["_key", "_class"])
        return got.withColumn("_stretch", F.shiftright(F.col("_spread") * F.col("_stretches"), 32))

    totals = dealt(light).groupBy(*stretch).agg(F.sum("units").alias("_sum")).withColumn("_block", F.floor(F.col("_stretch") / BLOCK_STRETCHES).cast("long"))
    blocks = totals.groupBy(*block).agg(F.sum("_sum").alias("_bsum"))
    blocks = blocks.select(*block, (F.sum("_bsum").over(Window.partitionBy("_key").orderBy("_class", "_block")) - F.col("_bsum")).alias("_bbefore"))
    totals = totals.withColumn("_in", F.sum("_sum").over(Window.partitionBy(*block).orderBy("_stretch")) - F.col("_sum"))
    before = totals.join(blocks, list(block)).select(*stretch, (F.col("_in") + F.col("_bbefore")).alias("_before"))
    # rows are dealt by stretch for the window, and the join below finds them so
    rows = dealt(light if narrow else base).repartition(*stretch)
    within = Window.partitionBy(*stretch).orderBy("_spread", "size", "_id")
    rows = rows.withColumn("_upto", F.sum("units").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.col("_before") + F.col("_upto") + F.col("offset")
    number = F.floor(end / UNIT) - F.floor((end - F.col("units")) / UNIT)
    return rows.join(before, list(stretch)).select(*own.values(), "size", "source_size", "target", number.cast("long").alias("copies"))


def copies(documents: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target and copies (0 or more)."""
    return _counted(documents, {"doc_id": "doc_id"}, **how)


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, in ``documents``' columns, whatever their names."""
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns)}
    got = _counted(documents, own, **how).filter(F.col("copies") > 0)
    got = got.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return got.select(*(F.col(n).alias(c) for c, n in own.items()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: what the mix takes of every document; nulls, repeats and empty tables as in ``_counted``, other columns take no part."""
    got = copies(read(spark, sf_dir, "documents"))
    return got.withColumn("taken", F.col("copies") * F.col("size"))


#: The same rows in DuckDB: one window per source instead of three levels.
OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM per
), steps AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS capped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE AS rest,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM ranked
), levels AS (
  SELECT *, (budget - capped) / rest AS level FROM steps
), chosen AS (
  SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, source IS NULL, source LIMIT 1
), plan AS (
  SELECT source, source_size,
    CASE WHEN (SELECT count(*) FROM chosen) = 0 THEN cap ELSE least(cap, (SELECT level FROM chosen) * weight) END AS target,
    ('0x' || substr(md5('0:' || coalesce('s' || source, 'null')), 1, 6))::BIGINT AS shift
  FROM levels
), spread AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.shift,
    CASE WHEN p.source_size > 0 THEN round(p.target / p.source_size * 16777216) ELSE 0 END::BIGINT AS units,
    ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 8))::BIGINT AS spread
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), ends AS (
  SELECT *, shift + sum(units) OVER (PARTITION BY source ORDER BY floor(sqrt(size)), spread, size, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM spread
), counted AS (
  SELECT *, (upto // 16777216 - (upto - units) // 16777216)::BIGINT AS copies FROM ends
)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM counted
"""
