"""Registered queries by area."""

from importlib import import_module

AREAS = ("bars", "features", "labels", "options", "metrics", "trades", "tables", "models", "streams")


def load() -> None:
    for area in AREAS:
        import_module(f"tapewright.plans.{area}")
