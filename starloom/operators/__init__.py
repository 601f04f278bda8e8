"""Relational building blocks of the star build."""

from starloom.operators.dedup import dedup_natural_key, duplicate_groups
from starloom.operators.frozen import freeze
from starloom.operators.keys import add_surrogate_key
from starloom.operators.lookup import lookup_key, orphans

__all__ = [
    "add_surrogate_key",
    "dedup_natural_key",
    "duplicate_groups",
    "freeze",
    "lookup_key",
    "orphans",
]
