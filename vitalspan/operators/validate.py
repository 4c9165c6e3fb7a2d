"""Table constraints as one violation report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_rule(rule: dict) -> tuple[str, Column]:
    c = F.col(rule["column"])
    if rule["rule"] == "domain":
        return f"domain:{rule['column']}", ~c.isin(rule["values"])
    if rule["rule"] == "range":
        return f"range:{rule['column']}", ~c.between(rule["lo"], rule["hi"])
    if rule["rule"] == "not_null":
        return f"not_null:{rule['column']}", c.isNull()
    raise ValueError(rule["rule"])


def validate_table(df: DataFrame, rules: Sequence[dict], parents: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)`` for every rule. Unknown values pass domain and range rules, as SQL CHECK does.

    All row rules share one pass; each key rule is one aggregation or anti join.
    """
    parts: list[DataFrame] = []
    row_rules = [_row_rule(r) for r in rules if r["rule"] in ("domain", "range", "not_null")]
    if row_rules:
        counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(row_rules)])
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (n, _) in enumerate(row_rules)])
        parts.append(counts.select(F.inline(pairs)))
    for rule in rules:
        if rule["rule"] == "primary_key":
            cols = rule["columns"]
            bad = df.groupBy(*cols).agg(F.count("*").alias("n")).where((F.col("n") > 1) | reduce(
                lambda a, b: a | b, [F.col(c).isNull() for c in cols]))
            parts.append(bad.agg(F.lit("primary_key:" + ",".join(cols)).alias("rule"), F.count("*").alias("violations")))
        elif rule["rule"] == "foreign_key":
            cols = rule["columns"]
            known = parents[rule["parent"]].select(*cols)
            orphans = df.dropna(subset=cols).join(known, cols, "left_anti")
            parts.append(orphans.agg(F.lit("foreign_key:" + ",".join(cols)).alias("rule"), F.count("*").alias("violations")))
    return reduce(DataFrame.unionByName, parts)


def require_valid(df: DataFrame, rules: Sequence[dict], parents: dict[str, DataFrame]) -> None:
    """Raise when any rule is violated; only the per-rule counts reach the driver."""
    broken = validate_table(df, rules, parents).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
