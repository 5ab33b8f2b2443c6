"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from recolith.plans import actions as _actions  # noqa: F401
from recolith.plans import captures as _captures  # noqa: F401
from recolith.plans import lookups as _lookups  # noqa: F401
from recolith.plans import more as _more  # noqa: F401  (registers its queries)
from recolith.plans import scalars as _scalars  # noqa: F401
from recolith.plans import tables as _tables  # noqa: F401
from recolith.plans import versions as _versions  # noqa: F401
from recolith.plans.catalog import QUERIES
from recolith.plans.catalog import SQL as ORACLE_SQL

FLAGSHIP = "dup_exact_two_phase"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
