"""Relational operators over DataFrames."""

from .aggregate import count_tuples, group_aggregate
from .bulk import forward_left, identity, splits
from .dml import delete_where, insert_rows, insert_select, update_where
from .joins import correlated_filter, cross_join, index_join, inner_join, merge_join, multiway_join, theta_join
from .predicates import between, compare, conjunction, disjunction, join_compare
from .scan import filter_rows, index_lookup, index_range, index_scan, project, table_scan
from .sort import sort

__all__ = [name for name in dir() if not name.startswith("_")]
