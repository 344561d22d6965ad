"""Label rules and small lookups. Each rule returns the class as a Column; missing flags count as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def binary_name(value: Column) -> Column:
    return F.when(value == 1, "contraband").otherwise("no_contraband")


def rule_empty() -> Column:
    return F.when(flag("empty") == 1, 1).otherwise(0)


def rule_combo() -> Column:
    """Empty trays are 0, isolated items 1; NULL where the flags contradict each other."""
    clear = flag("no_contraband") == 1
    return F.when(clear & (flag("isolated_items") == 0) & (flag("empty") == 1), 0).when(clear & (flag("isolated_items") == 1) & (flag("empty") == 0), 1)


def rule_contraband() -> Column:
    return F.when(flag("no_contraband") == 1, 0).otherwise(1)


def consistent(rows: DataFrame, rule, on_bad: str = "raise") -> tuple[DataFrame, DataFrame | None]:
    """rows with class_id by rule, and the rows set aside.

    on_bad: what is done with rows that the rule gives no class: "raise" (when they are read), "quarantine" (they are set aside), or "keep".
    """
    classed = rows.withColumn("class_id", rule())
    if on_bad == "keep":
        return classed, None
    if on_bad == "quarantine":
        return classed.filter("class_id is not null"), classed.filter("class_id is null").drop("class_id")
    if on_bad != "raise":
        raise ValueError(f"on_bad must be raise, quarantine or keep, got {on_bad}")
    bad = F.raise_error(F.concat(F.lit("inconsistent labels: "), F.to_json(F.struct(*rows.columns))))
    return classed.withColumn("class_id", F.coalesce("class_id", bad)), None


def box_normalized(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, strict: bool = True) -> Column:
    """[x/W, y/H, w/W, h/H]; a size of 0 raises if strict, else gives NULLs."""
    divide = (lambda a, b: a / b) if strict else F.try_divide
    return F.array(divide(x, width), divide(y, height), divide(w, width), divide(h, height))


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)
