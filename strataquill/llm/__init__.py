"""Operators for training text; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("p1_pieces", "p2_markup", "p3_repeats", "p4_lookalikes", "p6_encoding", "p7_leaks", "p8_sentences")


def registries() -> list:
    """The registries of the query modules that exist."""
    names = [f"{__name__}.{m}" for m in MODULES]
    return [importlib.import_module(n).R for n in names if importlib.util.find_spec(n)]
