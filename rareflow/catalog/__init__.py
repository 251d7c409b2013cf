"""Named queries over the test tables, each with the SQL that checks it where SQL can."""

# Order matters: later modules reuse SQL registered by earlier ones.
from . import features, splits, metrics, encoders, ensembles, learners, operations  # noqa: F401, I001
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
