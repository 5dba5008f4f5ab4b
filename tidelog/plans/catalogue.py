"""All queries of the core and their SQL."""

from __future__ import annotations

from tidelog.plans import kv, problems, sketches, storage, streams

_MODULES = (kv, storage, sketches, streams, problems)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
