"""End-to-end plans (train, update, classify) and the query registry."""

from __future__ import annotations

from foliomill.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from foliomill.plans import (  # noqa: F401
        queries_eval,
        queries_files,
        queries_model,
        queries_text,
        queries_vectors,
    )


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
