"""Stratified ratio estimation of fleet bycatch on Spark DataFrames."""

from .functions import clean_names, clamp_lower, n_distinct, null_safe_join, percent, ratio_se, standard_error, strict_sum
from .operators import *  # noqa: F403
from .sources import read_fleet, read_observer, read_table, write_partitioned, write_result
