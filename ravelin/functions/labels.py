"""The label vocabulary and its two sets of positives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels, the sets, and how the driver's tables map to them.
LABELS = ("self", "gift_given", "household", "received", "unclear")
NARROW = ("gift_given",)
BROAD = ("gift_given", "household", "received")
EVENT_LABELS = {"purchase": "self", "click": "gift_given", "view": "household", "signup": "received", "error": "unclear"}
LINE_LABELS = {"NO": "self", "AF": "gift_given", "RF": "household", "NF": "received", "AO": "self", "RO": "unclear"}


def in_set(label: Column, axis: str = "narrow") -> Column:
    """Whether a label is positive on the narrow or the broad axis."""
    return label.isin(*{"narrow": NARROW, "broad": BROAD}[axis])


def from_flag(flag: Column) -> Column:
    """A lexical flag as a two-valued label."""
    return F.when(flag, F.lit("gift_given")).otherwise(F.lit("not_gift"))
