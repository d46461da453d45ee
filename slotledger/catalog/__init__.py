"""Registered queries over the given tables, each with its ANSI SQL counterpart where one exists."""

from __future__ import annotations

import importlib

from slotledger.catalog.base import QUERIES, SQL

MODULES = ("calendar", "ingest", "asof", "shaping", "models", "scores", "reports", "windows", "learned", "integrity")


def load() -> dict:
    for name in MODULES:
        importlib.import_module(f"slotledger.catalog.{name}")
    return QUERIES


__all__ = ["QUERIES", "SQL", "load"]
