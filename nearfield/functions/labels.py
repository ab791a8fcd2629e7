"""Label columns: parsing lines of labels, and which points a label lets through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_labels(line: Column) -> Column:
    """Labels of one line: what stands before a tab, without line ends, split at commas; empty parts go."""
    clean = F.regexp_replace(F.split_part(line, F.lit("\t"), F.lit(1)), "[\r\n]", "")
    return F.filter(F.transform(F.split(clean, ","), lambda x: F.trim(x)), lambda x: x != "")


def matches(labels: Column, label: Column | str, universal: str | None = None) -> Column:
    """A search: the point has the label, or carries the universal label if one is set. Null labels match nothing."""
    wanted = F.lit(label) if isinstance(label, str) else label
    hit = F.array_contains(labels, wanted)
    if universal is not None:
        hit = hit | F.array_contains(labels, universal)
    return F.coalesce(hit, F.lit(False))


def share_label(a: Column, b: Column, universal: str | None = None) -> Column:
    """While building: a common label, or the universal label on either side."""
    hit = F.arrays_overlap(a, b)
    if universal is not None:
        hit = hit | F.array_contains(a, universal) | F.array_contains(b, universal)
    return F.coalesce(hit, F.lit(False))


def covers(a: Column, b: Column) -> Column:
    """Whether a point with labels a may stand in for one with labels b: it has all of them."""
    return F.size(F.array_except(b, a)) == 0
