"""All registered queries with their SQL, collected from the plan modules."""

from __future__ import annotations

from corvane.plans import evaluating, landed, lifecycles, matching, relational, states, streams, texts
from corvane.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "J8_hard_filter_match"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "evaluating", "landed", "lifecycles", "matching", "relational", "states", "streams", "texts"]
