"""Named queries over the tables, by topic."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every topic module and return the filled registry."""
    from .catalog import CATALOG

    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if m.endswith("_plans"):
            importlib.import_module(f"{__name__}.{m}")
    return CATALOG
