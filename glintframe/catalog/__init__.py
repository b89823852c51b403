"""Runnable queries over the driver tables, each with its DuckDB text where SQL can express it."""

from importlib import import_module

MODULES = ("scores", "trajectories", "cameras", "neighbourhoods", "areas", "quality", "blends", "audits")


def load():
    from glintframe.catalog import base

    for name in MODULES:
        import_module(f"glintframe.catalog.{name}")
    return base.QUERIES, base.ORACLE, base.COVERS
