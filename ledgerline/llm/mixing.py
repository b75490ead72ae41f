"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target, in words, and a weight schedule over training time, a broken line from
0 to 1. The schedule's integral, scaled to the target, is the source's cumulative demand. A source's
documents stand in a keyed pseudo-random order; the words before a document are its cumulative supply,
and inverting the demand at that supply gives the time at which the document is taken. A target above
the source's size starts a second round through the same order. Sorting by time, as a range sort, gives
the training sequence. A source's last document may be taken in part, so targets are met to the word.

All of it is DataFrame operations. A source of any size is summed in two steps: words per source and
bucket of the order (4,096 of them, by the first digits of a document's key), then inside a bucket, so
no task holds a source.

Defined results: a null text has 0 words and is never taken; a null source is a source of its own and
comes last; rows with equal id, source and size are interchangeable; a mix without words has targets
of 0; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The schedule of each weight: (time, weight) from 0 to 1; above 0 inside, so that demand rises.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.7, 1.0), (1.0, 2.0)),
)
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """A written copy of df with `place`, its rows' places from 0 in a total order, without a single task.

    The rows are range-sorted and written with their partition; the offsets of partitions, few, are
    summed and joined.
    """
    at = F.monotonically_increasing_id()
    kept = materialize(df.orderBy(*order).withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND((1 << 33) - 1)}), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return kept.join(offsets, "_part").withColumn("place", F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """sources (with source_size) with kind, weight and target.

    Targets are in proportion to the weights and sum to `share` of all sizes; one that would exceed
    `most` times its source's size stops there, and the excess is shared anew. Each turn of the loop
    is one sum over the sources and caps at least one more of them, mostly many: a few turns do.
    """
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % n + 1).cast("int"))
    weighed = ranked(sources, "no_source", "source").withColumns({"kind": (F.col("place") % n).cast("int"), "weight": w, "_cap": F.col("source_size") * F.lit(float(most))})
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("_cap")
        s = weighed.agg(F.sum(full.cast("int")), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if capped == s[0] or not s[2]:
            break
        level, capped = (total - (s[1] or 0.0)) / s[2], s[0] if level else -1
    return weighed.withColumn("target", F.least(F.col("_cap"), F.col("weight") * level)).drop("_cap", "place")


def time_of(fraction: Column, kind: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The training time at which a fraction of a source's demand is reached.

    On a piece of the line from weight a to b over d, demand after x is a*x + (b-a)*x*x/(2*d); its
    inverse is taken in the form that also holds for a = b.
    """
    found = F
    for k, line in enumerate(schedules):
        pieces, done = [], 0.0
        for (t0, w0), (t1, w1) in zip(line, line[1:]):
            pieces.append((done, t0, w0, (w1 - w0) / (t1 - t0)))
            done += (t1 - t0) * (w0 + w1) / 2
        at = F
        for start, t0, w0, slope in reversed(pieces):
            rest = fraction * done - start
            at = at.when(rest >= 0, t0 + 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest))))
        found = found.when(kind == k, at)
    return F.least(F.lit(1.0), found)


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """A row per document, range-sorted by position.

    doc_id, source, size, source_size, target (its source's), taken (words, repeats counted),
    position (time of the first use, null if it isn't used) and repeat_position (of the second).
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("-")), "size"))
    named = F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source")
    thin = materialize(sized.select("doc_id", *named, "size", key.alias("_h")).withColumn("_bucket", F.substring("_h", 1, 3)), "sizes")
    by = ["no_source", "source"]
    buckets = thin.groupBy(*by, "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    shares = targets(thin.groupBy(*by).agg(F.sum("size").alias("source_size")), share, most)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, [*by, "_bucket"]).join(shares, by)
    supply, goal = F.col("_offset") + F.col("_inside"), F.round("target").cast("bigint")

    def use(turn: int) -> tuple[Column, Column]:
        begin = supply + F.col("source_size") * turn
        took = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), goal - begin))
        return took, F.when(took > 0, time_of(begin / F.col("target"), F.col("kind")))

    (once, first), (twice, second) = use(0), use(1)
    rows = placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        (once + twice).alias("taken"), first.alias("position"), second.alias("repeat_position"),
    )
    return rows.orderBy(F.asc_nulls_last("position"), "doc_id", "size")


def sequence(planned: DataFrame) -> DataFrame:
    """The training sequence: a row per use of a document, range-sorted by position.

    doc_id, source, turn (0, 1), position and words, which are fewer than size at a source's cut.
    """
    first = F.least(F.col("size"), F.col("taken"))
    uses = F.array(
        F.struct(F.lit(0).alias("turn"), F.col("position").alias("position"), first.alias("words")),
        F.struct(F.lit(1).alias("turn"), F.col("repeat_position").alias("position"), (F.col("taken") - first).alias("words")),
    )
    rows = planned.select("doc_id", "source", F.explode(F.filter(uses, lambda u: u["words"] > 0)).alias("u")).select("doc_id", "source", "u.*")
    return rows.orderBy("position", "doc_id", "turn")
