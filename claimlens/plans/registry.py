"""Registry of named queries: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from .views import Model

QUERIES: dict[str, Callable] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Model(spark, folder))
        return fn

    return register
