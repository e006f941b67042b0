from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(s: Column) -> Column:
    """Month D, YYYY; anything else is an error."""
    return F.to_date(s, "MMMM d, yyyy")


def tolerant_date(s: Column) -> Column:
    """D-mon-YYYY or Month D, YYYY; null for anything else."""
    fixed = F.initcap(F.lower(s))
    return F.coalesce(F.try_to_date(F.regexp_replace(fixed, "-([a-z])", "-$1"), "d-MMM-yyyy"), F.try_to_date(F.initcap(F.replace(fixed, F.lit("-"), F.lit(" "))), "d MMM yyyy"), F.try_to_date(fixed, "MMMM d, yyyy"))


def iso(d: Column) -> Column:
    return d.cast("date").cast("string")
