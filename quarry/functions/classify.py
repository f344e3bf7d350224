"""Rule-driven host classification (F8) and organisation extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Academic host suffixes and their class labels; first match wins,
# matching is case-sensitive.
ACADEMIC_SUFFIXES = [(".edu", "US"), (".ac.uk", "UK"), (".edu.au", "AUS")]


def suffix_class(host: Column, rules=ACADEMIC_SUFFIXES) -> Column:
    """F8: label of the first rule whose suffix ends ``host``; NULL when none does."""
    expr = None
    for suffix, label in rules:
        cond = host.endswith(suffix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def organisation_pattern(suffix: str) -> str:
    """``([^.]+)\\.edu`` for ``.edu``: the dot-free label right before the suffix."""
    return r"([^.]+)" + re.escape(suffix)


def organisation(host: Column, klass: Column, rules=ACADEMIC_SUFFIXES) -> Column:
    """the label before the class's suffix, leftmost unanchored match.

    ``a.edu.foo.edu`` gives ``a``; the bare host ``.edu`` gives ``''`` (an
    organisation with an empty name, counted like any other).
    """
    expr = None
    for suffix, label in rules:
        cond = klass == label
        val = F.regexp_extract(host, organisation_pattern(suffix), 1)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr
