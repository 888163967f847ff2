"""Operators for preparing training data, and the queries that apply them to whole tables."""

from lakeops.llm.registry import ORACLES, QUERIES  # noqa: F401
from lakeops.llm import queries  # noqa: F401  (importing registers the queries)
