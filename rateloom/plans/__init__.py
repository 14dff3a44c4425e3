"""Registered queries: name to DataFrame function, and the DuckDB SQL that gives the same rows."""

from . import boards, calibrated, dated, events, gated, history, matching, models, projection, ratings, registered, relational, replays, serving, specified  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
