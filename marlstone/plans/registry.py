"""Named queries over the star-schema tables and the SQL that must agree with them."""

from __future__ import annotations

from . import exchange, kernels, models, screening, series, stream, vendor  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "daily_bar_features"
