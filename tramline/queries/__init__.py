"""Registry of the transit queries: each runs an operator over the driver's tables, beside the SQL that says the same."""

from __future__ import annotations

from tramline.queries import base
from tramline.queries import crowding as _crowding  # noqa: F401
from tramline.queries import evaluation as _evaluation  # noqa: F401
from tramline.queries import events as _events  # noqa: F401
from tramline.queries import feeds as _feeds  # noqa: F401
from tramline.queries import jobs as _jobs  # noqa: F401
from tramline.queries import panel as _panel  # noqa: F401
from tramline.queries import quality as _quality  # noqa: F401
from tramline.queries import scalars as _scalars  # noqa: F401
from tramline.queries import stock as _stock  # noqa: F401

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
