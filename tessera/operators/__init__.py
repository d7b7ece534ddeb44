"""Relational operators."""

from tessera.operators.relational import (
    fixed_aggregation,
    hash_group,
    hash_join,
    index_lookup,
    ordered_fold,
    partition_by_key,
    plan_text,
    product,
    project,
    result,
    scan,
    select,
    semi_join,
    tap,
)

__all__ = [
    "fixed_aggregation", "hash_group", "hash_join", "index_lookup", "ordered_fold", "partition_by_key",
    "plan_text", "product", "project", "result", "scan", "select", "semi_join", "tap",
]
