"""The category dimension: aliases, expansion, custom names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx


def known(kind: str | None = None) -> tuple[str, ...]:
    """Display names of a kind; all without one."""
    return {"EXPENSE": lx.EXPENSE_CATEGORIES, "INCOME": lx.INCOME_CATEGORIES, "TRANSFER": lx.TRANSFER_CATEGORIES}.get(kind, (*lx.EXPENSE_CATEGORIES, *lx.INCOME_CATEGORIES, *lx.TRANSFER_CATEGORIES))


def resolve(name: str, strict: bool = False, custom: tuple[str, ...] = ()) -> str:
    """A name as a category: an old name is what it is now; strictly, an unknown one is other."""
    if name == lx.UNCLASSIFIED:
        return name
    name = lx.LEGACY_CATEGORIES.get(name, name)
    return name if not strict or name in known() or name in custom else lx.OTHER


def resolved(name: Column, strict: bool = True, custom: tuple[str, ...] = ()) -> Column:
    """The same for a column; custom names are kept."""
    now = F.coalesce(*(F.when(name == k, v) for k, v in lx.LEGACY_CATEGORIES.items()), name)
    return F.when(now.isin(*known(), lx.UNCLASSIFIED, *custom), now).otherwise(F.lit(lx.OTHER)) if strict else now


def expansion(name: str, parents: dict[str, str] | None = None, strict: bool = False) -> tuple[str, ...]:
    """A category and those below it; ``parents`` maps a category to the one above it."""
    name = resolve(name, strict)
    return (name, *(c for c, p in (parents or {}).items() if p == name))


def dimension(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """(name, type, custom) of built-in and custom categories."""
    rows = [(n, k, False) for k in ("EXPENSE", "INCOME", "TRANSFER") for n in known(k)]
    built_in = spark.createDataFrame(rows, "name string, type string, custom boolean")
    return built_in if custom is None else built_in.unionByName(custom.select("name", "type", F.lit(True).alias("custom")))
