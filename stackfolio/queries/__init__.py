"""Operators bound to the star-schema and text tables, each with an SQL twin where SQL can say it."""

from . import (  # noqa: F401
    aggregation, changing, cleaning, joining, marc, ordering, products, reading, searching, shaping, trees,
)
from .registry import QUERIES

__all__ = ["QUERIES"]
