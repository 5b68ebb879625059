"""A Spark-native indexed text and code search engine."""

from __future__ import annotations

import importlib

#: What the package offers by name, loaded when it is asked for, so that Python
#: workers that need one module do not load all.
_OFFERED = {
    "Config": "engine",
    "Engine": "engine",
    "SearchOptions": "engine",
    "search_files": "engine",
    "extensions_for_type": "functions.filetypes",
    "list_all_types": "functions.filetypes",
    "detect_regex_hint": "functions.hints",
    "changed_files": "sources.git",
    "serve": "tools",
}

__all__ = sorted(_OFFERED)


def __getattr__(name: str):
    if name not in _OFFERED:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_OFFERED[name]}"), name)
