"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

import importlib

#: Modules of this subpackage that register queries (QUERIES) and SQL twins (ORACLE).
PARTS = ("tokens", "split", "sentences", "markup", "neardup", "knn", "survivor", "packing", "scanned")

QUERIES: dict = {}
ORACLE: dict = {}
for _part in PARTS:
    _module = importlib.import_module(f".queries_{_part}", __package__)
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
