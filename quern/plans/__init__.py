"""Registered queries: each module binds operators to the given tables and states the SQL to compare with."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
