"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

from . import queries as q
from .sql import SQL


def queries() -> dict:
    return {k: v for k, v in vars(q).items() if k[0] == "p" and k[1].isdigit() and "_" in k and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
