"""Relational operators as functions of DataFrames."""

from tallyfold.operators.aggregate import money_sum, summary
from tallyfold.operators.join import cross, equal_pairs, inner, theta
from tallyfold.operators.project import projection, reversed_columns
from tallyfold.operators.sort import ordered
from tallyfold.operators.subquery import beside, compared_with

__all__ = [
    "beside", "compared_with", "cross", "equal_pairs", "inner", "money_sum", "ordered", "projection", "reversed_columns",
    "summary", "theta",
]
