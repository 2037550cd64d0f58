"""Queries over the test tables; importing this package registers all of them."""

from sigscreen.workload import cleaning, features, graphs, profiles, screening  # noqa: F401
from sigscreen.workload.registry import QUERIES

__all__ = ["QUERIES"]
