"""All queries of the library, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with equivalent SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


from . import calibration, cohorts, features, ingest, learning, ranking, resampling, reports  # noqa: E402, F401
