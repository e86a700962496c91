"""A Spark-first analytics engine for multi-source listing data."""

from __future__ import annotations

__version__ = "0.2.0"

#: Public names and where each is; they are imported on first use.
_EXPORTS = {
    "scan": "plans.scan",
    "LifecycleStore": "plans.store",
    "sync": "plans.sync",
    "list_sources": "sources.catalog",
    "register_source": "sources.catalog",
    "select_sources": "sources.catalog",
    "LISTING": "functions.schema",
    "FilterOptions": "operators.filtering",
    "RunOptions": "operators.lifecycle",
    "PageOptions": "operators.coverage",
}
__all__ = [*_EXPORTS, "__version__"]


def __getattr__(name: str):
    from importlib import import_module

    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_EXPORTS[name]}"), name)
