"""Bibliographic and authority data work as Spark DataFrame jobs."""

from .naming import Namespaces
from .session import scratch_path, tune, written

__all__ = ["Namespaces", "scratch_path", "tune", "written"]
