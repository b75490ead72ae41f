"""The link rule of the n-gram join, and the exact check of candidate pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; links at `percent` per cent of the union."""

    words: int = 3
    percent: int = 90
    light: int = 32  #: documents in a list that is paired; any value gives the same links

    def least_partner(self, a):
        return -(-self.percent * a // 100)

    def prefix(self, a):
        return a - self.least_partner(a) + 1

    def window(self, a):
        return min(a, self.prefix(a) + a // 10 + 8)

    def extra(self, a):
        return self.window(a) - self.prefix(a)

    def overlap(self, a: Column, b: Column) -> Column:
        return F.ceil(self.percent * (a + b) / F.lit(100 + self.percent) - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link, by their whole sets."""
    left, right = (sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= rule.percent * union).select("a", "b")
