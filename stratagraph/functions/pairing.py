"""Pairings of two non-negative integers as column functions (64-bit)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cantor_pairing(s: Column, d: Column) -> Column:
    """(s + d)(s + d + 1) / 2 + d; distinct for distinct ordered pairs."""
    t = s + d
    return F.call_function("div", t * (t + 1), F.lit(2)) + d


def associative_pairing(s: Column, d: Column) -> Column:
    """max (max + 1) / 2 + min; equal for (s, d) and (d, s)."""
    a, b = F.greatest(s, d), F.least(s, d)
    return F.call_function("div", a * (a + 1), F.lit(2)) + b
