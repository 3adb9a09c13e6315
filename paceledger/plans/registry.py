"""All registered queries of the health-record library and their SQL."""

from paceledger.plans import round_trips  # noqa: F401
from paceledger.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
