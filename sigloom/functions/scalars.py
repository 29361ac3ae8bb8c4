"""Scalar expressions for names and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(i: Column) -> Column:
    """A..Z, AA..ZZ for 0..701; null beyond."""
    two = F.concat(F.chr(F.floor((i - 26) / 26) + 65), F.chr(F.pmod(i - 26, F.lit(26)) + 65))
    return F.when(i < 26, F.chr(i + 65)).when(i < 702, two)


def signature_name(context: str, i: Column) -> Column:
    return F.concat(F.lit(context), letters(i))


def plot_text(kind: str, value: Column, all_: Column | None = None) -> Column:
    """``Stability: 0.97``, or ``Total Mutations: 1,234/12.3%`` as a share of ``all_``."""
    if kind == "Stability":
        return F.concat(F.lit("Stability: "), F.format_number(value, 2))
    return F.concat(F.lit("Total Mutations: "), F.format_number(value, 0), F.lit("/"), F.format_number(100 * value / all_, 1), F.lit("%"))


def strip_marks(s: Column) -> Column:
    return F.regexp_replace(s, r"[*%]+$", "")


def chunks_of(a: Column, n: int) -> Column:
    """An array cut into arrays of n."""
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda i: F.slice(a, i * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def positions_of(a: Column, wanted: Column) -> Column:
    """0-based places of the wanted items in ``a``."""
    return F.transform(wanted, lambda x: F.array_position(a, x) - 1)
