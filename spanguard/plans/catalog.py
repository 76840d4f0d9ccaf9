"""All registered queries."""

from spanguard.plans import audits, detection, scoring, streams
from spanguard.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "detection", "scoring", "streams"]
