"""Registered queries. Importing this package fills ``registry.QUERIES`` and
``registry.ORACLE``."""

from . import catalog_behaviour, catalog_examples, catalog_items, catalog_streaming  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
