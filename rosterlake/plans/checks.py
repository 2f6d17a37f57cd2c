"""Physical-plan inspection: what a query will do on a cluster, read from
``explain`` output, without running it at scale."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Operators that must never appear in a registered query: they pair every row
# of one side with every row of the other.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical_plan(df: DataFrame) -> str:
    """The executed physical plan as text (the final plan once AQE has run)."""
    return df._jdf.queryExecution().executedPlan().toString()


def forbidden_operators(df: DataFrame) -> list[str]:
    plan = physical_plan(df)
    return [op for op in FORBIDDEN if op in plan]


def has_group_limit(df: DataFrame) -> bool:
    """True when a ``row_number() <= n`` top-n runs as a WindowGroupLimit."""
    return "WindowGroupLimit" in physical_plan(df)


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters each parquet scan received."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def summary(df: DataFrame) -> dict[str, int]:
    """Counts of the operators that cost at scale."""
    plan = physical_plan(df)
    return {
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "python_stages": sum(plan.count(op) for op in ("MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInArrow")),
        "group_limits": plan.count("WindowGroupLimit"),
        "forbidden": sum(plan.count(op) for op in FORBIDDEN),
    }
