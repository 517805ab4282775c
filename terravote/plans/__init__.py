"""Named queries over the standard tables, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["matching", "fusing", "evaluating", "cataloguing", "replaying", "reporting"]


def _all() -> dict[str, tuple[Callable, str | None]]:
    return {k: v for m in MODULES for k, v in import_module(f"terravote.plans.{m}").QUERIES.items()}


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
