"""What the subpackage adds to the driver's dictionaries."""

from __future__ import annotations

from .queries import QUERIES
from .sql import SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
