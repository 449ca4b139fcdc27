"""All bound queries and their reference SQL."""
from __future__ import annotations

from importlib import import_module

MODULES = ["matching", "registry", "normalise", "classification", "duplicates", "landing", "streams"]


def collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"armarium.plans.{name}"), attr))
    return out
