"""Named queries over the driver's tables and the SQL that answers them."""

from tidewatch.plans import correlation, detection, upkeep  # noqa: F401  (they register their queries)
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
