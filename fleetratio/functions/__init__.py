from .names import clean_names, column_list, domain_list, require_columns, snake_case
from .nulls import divide, is_true, measure, n_distinct, null_safe_join, strict_sum, sum_or_zero
from .stats import (
    LB_PER_MT,
    Z_95,
    clamp_lower,
    expand_component,
    percent,
    ratio_se,
    stable_round,
    standard_error,
    zero_filled_mean,
    zero_filled_se,
)

__all__ = [
    "LB_PER_MT",
    "Z_95",
    "clamp_lower",
    "clean_names",
    "column_list",
    "divide",
    "domain_list",
    "expand_component",
    "is_true",
    "measure",
    "n_distinct",
    "null_safe_join",
    "percent",
    "ratio_se",
    "require_columns",
    "snake_case",
    "stable_round",
    "standard_error",
    "strict_sum",
    "sum_or_zero",
    "zero_filled_mean",
    "zero_filled_se",
]
