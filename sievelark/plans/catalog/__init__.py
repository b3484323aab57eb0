"""Named queries over the given tables, each next to its SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("selection", "clusters", "joins", "aggregates", "scans", "texts", "graphs", "structures", "surfaces", "poses", "lattices", "metrics", "orientations")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
