"""Operators: plain functions from DataFrames to DataFrames."""

from .grouping import count_by_key, count_distinct_per_key, group, group_by_key, reduce_by_key, top_k_per_group
from .joins import JoinInput, anti_join, intersection_bag, intersection_set, join, join_on_key, join_to, semi_join
from .pipes import map_reduce, pipe
from .reducers import Reducer, ReduceTo, ReduceToCount, ReduceToList, ReduceToSum
from .setops import distinct, subtract, union, union_all
from .sideviews import augment, augment_lookup, mapside_join, only_row
from .transforms import filter_rows, flatten, log_echo_first, log_progress, log_rows, number_rows, replace_each, replace_each_partition, running_sum, sample

__all__ = [
    "JoinInput", "ReduceTo", "ReduceToCount", "ReduceToList", "ReduceToSum", "Reducer", "anti_join", "augment", "augment_lookup", "count_by_key", "count_distinct_per_key",
    "distinct", "filter_rows", "flatten", "group", "group_by_key", "intersection_bag", "intersection_set", "join", "join_on_key", "join_to", "log_echo_first", "log_progress",
    "log_rows", "map_reduce", "mapside_join", "number_rows", "only_row", "pipe", "reduce_by_key", "replace_each", "replace_each_partition", "running_sum", "sample", "semi_join", "subtract", "top_k_per_group", "union", "union_all",
]
