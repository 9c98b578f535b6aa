"""The queries of all operators, with SQL for those that SQL can express."""

from __future__ import annotations

from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
