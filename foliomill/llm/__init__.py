"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

from __future__ import annotations

from foliomill.plans.registry import Query


def all_queries() -> dict[str, Query]:
    from foliomill.llm.queries import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from foliomill.llm.queries import ORACLES

    return dict(ORACLES)
