"""Links among near copies that share heavy shingles only.

Sets of a large group of near copies differ in few shingles, so they are compared by what differs.

Homes. A heavy shingle's home is one set that holds it, the same for most shingles of a group. A set is
registered in the homes of its heavy shingles, the smallest left out as long as these hold, of a set of n,
less than percent * n / (100 + percent) shingles: of two linked sets that leaves a shared one with a home
where both are registered.

Differences. The pivot P of a home is what more than half of its sets hold. A set's difference from it are
v (heavy shingles that only one of the two has, rarest first) and its light shingles: d in all. Sets A and B
without a light shingle in common link exactly if their difference is at most k = (a + b) * (100 - percent) /
(100 + percent). With excess e = d - (own share of k): if e_A + e_B <= 0 they surely link; the set of least
excess links with every set that surely links with any, so one star for each home settles all those. Other
links share at least q = ceil((e_A + e_B) / 2) elements of their v.

Adaptive multi-match prefixes. Sets are put in buckets of size and excess. For each two buckets, q is known
to a bucket's width, and the first |v| - q + l elements of two linked sets share l elements, for every l up
to q. A longer prefix costs more keys and demands more shared elements: l is the number at which the
estimated keys and candidates are fewest. A key is a combination of l elements of a prefix.

Lists of a key are compared in TURNS turns with one member of the list's largest component; only sets that
are still outside are then compared with the rest of the list. Lists of one component are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .jaccard import Rule, verified

TURNS = 2  #: of stars inside lists; any number gives the same components
MATCHES = 4  #: the largest number of shared elements that is asked for; any gives the same components
STEPS = 8  #: buckets of excess within a set's own share; any number gives the same components
FACTS = ("node", "n", "light", "apart")
EMIT = 100_000


def links(sets: DataFrame, held: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b that join the components of `known` wherever sets link by heavy shingles alone.

    sets: node, n, shingles (all); held: node, n, shingle, a row for each heavy shingle of a set.
    """
    counts = held.groupBy("node").agg(F.count("*").alias("n_heavy"))
    able = counts.join(sets.select("node", "n"), "node").where(100 * F.col("n_heavy") >= rule.percent * F.col("n"))
    able = materialize(able.select("node", "n", (F.col("n") - F.col("n_heavy")).cast("int").alias("light")), "dense-able")
    if able.isEmpty():
        return known
    held = materialize(held.select("node", "shingle").join(able.select("node", "n"), "node"), "dense-held")
    facts = materialize(_differences(sets, held, able, rule), "dense-differences")
    least = facts.groupBy("home").agg(F.min(F.struct("excess", "node")).alias("least"))
    sure = facts.join(least, "home").where("excess + least.excess <= 0 and node != least.node")
    known = materialize(known.union(sure.select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))), "dense-links")
    labels = components(known)
    lists = materialize(_lists(facts, labels, rule), "dense-lists")
    for turn in range(TURNS + 1):
        split, top = _split(lists, labels, turn)
        if top.isEmpty():
            return known
        if turn == TURNS:
            break
        first = F.col("top.first")
        stars = split.join(top, "key").where("component != top.component").where(_reach(rule, F.struct(*FACTS), first))
        stars = stars.select(F.least("node", "top.first.node").alias("a"), F.greatest("node", "top.first.node").alias("b"))
        fresh = materialize(verified(stars.distinct(), sets, rule), "dense-links")
        if fresh.isEmpty():
            break
        known = known.union(fresh)
        labels = components(known)
    largest = top.select("key", F.col("top.component").alias("largest"))
    y = split.join(largest, "key")
    y = y.select("key", "largest", F.col("side").alias("side_b"), F.col("component").alias("component_b"), F.struct(*FACTS).alias("y"))
    x = y.where("component_b != largest")
    x = x.select("key", F.col("side_b").alias("side_a"), F.col("component_b").alias("component_a"), F.col("y").alias("x"))
    other = "component_a != component_b and (component_b = largest or x.node < y.node) and (side_a != side_b or side_a = 2)"
    rest = x.join(y, "key").where(other).where(_reach(rule, F.col("x"), F.col("y")))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return known.union(verified(rest, sets, rule))


def _differences(sets: DataFrame, held: DataFrame, able: DataFrame, rule: Rule) -> DataFrame:
    """home, node, n, light, v, apart (the length of v), excess times 100 + percent; size: elements at the home."""
    lead = held.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("home"))).alias("lead"))
    shares = held.join(lead, "shingle").groupBy("node", "n", F.col("lead.home").alias("home")).agg(F.count("*").alias("share"))
    upward = Window.partitionBy("node").orderBy("share", "home").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    homes = shares.withColumn("below", F.sum("share").over(upward))
    homes = materialize(homes.where((100 + rule.percent) * F.col("below") >= rule.percent * F.col("n")).select("home", "node"), "dense-homes")
    members = homes.groupBy("home").agg(F.count("*").alias("members")).where("members > 1")
    homes = homes.join(members, "home")
    marks = homes.join(held.select("node", "shingle"), "node")
    counted = marks.groupBy("home", "shingle").agg(F.count("*").alias("c"), F.first("members").alias("members"))
    counted = counted.select("home", "shingle", F.least("c", F.col("members") - F.col("c")).alias("rare"), (2 * F.col("c") > F.col("members")).alias("most"))
    counted = materialize(counted, "dense-pivots")
    pivots = counted.groupBy("home").agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("most"), F.col("shingle"))).alias("pivot"))
    placed = homes.join(pivots, "home").join(able, "node")
    own = marks.select("home", "node", "shingle").join(counted.where("not most").select("home", "shingle", "rare"), ["home", "shingle"])
    lacked = placed.join(sets.select("node", "shingles"), "node").select("home", "node", F.explode(F.array_except("pivot", "shingles")).alias("shingle"))
    lacked = lacked.join(counted.where("most").select("home", "shingle", "rare"), ["home", "shingle"])
    v = own.unionByName(lacked).groupBy("home", "node").agg(F.array_sort(F.collect_list(F.struct("rare", "shingle"))).alias("v"))
    v = v.select("home", "node", F.col("v.shingle").alias("v"))
    facts = placed.drop("pivot").join(v, ["home", "node"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<bigint>")))
    apart = F.size("v")
    excess = (apart + F.col("light")).cast("bigint") * (100 + rule.percent) - F.col("n").cast("bigint") * (100 - rule.percent)
    return facts.select("home", "node", "n", "light", "v", apart.alias("apart"), excess.alias("excess"), "size")


def _lists(facts: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """key, side, FACTS: a row for each combination of a set's prefixes, at homes of several components."""
    labelled = facts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "dense-labels")
    parts = labelled.groupBy("home", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("home").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"))
    unit = 100 + rule.percent
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / rule.percent) + 1e-9).cast("int")
    labelled = labelled.join(largest.where("parts > 1"), "home").withColumn("kind", kind).withColumn("width", _width(rule))
    labelled = labelled.withColumn("step", F.floor(F.col("excess") / F.col("width")).cast("bigint"))
    stats = labelled.groupBy("home", "kind", "step", "width").agg(
        F.count("*").alias("sets"), F.sum(F.when(F.col("component") != F.col("largest"), 1).otherwise(0)).alias("outside"),
        F.max("apart").alias("apart"), F.first("size").alias("size"),
    )
    stats = materialize(stats, "dense-buckets")
    one, two = (stats.select("home", *[F.col(c).alias(f"{c}_{s}") for c in stats.columns if c != "home"]) for s in "ab")
    pairs = one.join(two, "home").where("abs(kind_a - kind_b) <= 1 and (kind_a, step_a) <= (kind_b, step_b) and outside_a + outside_b > 0")
    low = F.col("step_a") * F.col("width_a") + F.col("step_b") * F.col("width_b")
    shared = F.greatest(F.lit(1), F.ceil(low / (2 * unit)))
    pairs = pairs.where(low + F.col("width_a") + F.col("width_b") > 0).withColumn("shared", shared)
    pairs = pairs.where("least(apart_a, apart_b) >= shared").withColumn("matches", _matches())
    ends = F.struct(F.col("kind_a").alias("kind"), F.col("step_a").alias("step")), F.struct(F.col("kind_b").alias("kind"), F.col("step_b").alias("step"))
    same = ends[0] == ends[1]
    spec = lambda own, other, side, s: F.struct(
        own.alias("own"), F.struct(F.xxhash64("home", *ends).alias("pair"), F.when(same, 2).otherwise(side).alias("side"),
                                   (F.col(f"step_{s}") * F.col(f"width_{s}")).alias("low"), "matches").alias("spec"))
    both = F.when(same, F.array(spec(*ends, 0, "b"))).otherwise(F.array(spec(*ends, 0, "b"), spec(ends[1], ends[0], 1, "a")))
    specs = pairs.select("home", F.explode(both).alias("e")).groupBy("home", F.col("e.own.kind").alias("kind"), F.col("e.own.step").alias("step"))
    specs = specs.agg(F.collect_list("e.spec").alias("specs"))
    sent = labelled.join(specs, ["home", "kind", "step"]).select(*FACTS, "v", "excess", "specs")
    return sent.mapInArrow(_keys(unit), "key bigint, side int, node bigint, n int, light int, apart int")


def _width(rule: Rule) -> Column:
    """Of buckets of excess: a part of the own share of sets of this kind, two elements at least."""
    share = (100 - rule.percent) * F.pow(F.lit(100 / rule.percent), F.col("kind").cast("double"))
    return F.greatest(F.lit(2 * (100 + rule.percent)), F.floor(share / STEPS)).cast("bigint")


def _matches() -> Column:
    """The number of shared elements, up to `shared`, at which keys and candidates are estimated to be fewest."""
    def choose(k: Column, m: int) -> Column:
        out = F.lit(1.0)
        for i in range(1, m + 1):
            out = out * (k + i) / i
        return out

    costs = []
    for m in range(1, MATCHES + 1):
        a, b = (F.col(f"sets_{s}") * choose((F.col(f"apart_{s}") - F.col("shared")).cast("double"), m) for s in "ab")
        all_keys = choose(F.greatest(F.col("size_a") - m, F.lit(0)).cast("double"), m)
        costs.append(F.struct(F.when(F.col("shared") >= m, a + b + a * b / all_keys).alias("cost"), F.lit(m).alias("m")))
    possible = F.filter(F.array(*costs), lambda x: x["cost"].isNotNull())
    return F.array_min(possible)["m"]


def _keys(unit: int):
    """Combinations of the first elements of v, for each bucket that a set may have partners in."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sides, rows = [], [], []
        for b in it:
            facts = np.stack([b.column(c).to_numpy() for c in FACTS], 1)
            for i, (v, excess, specs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("v", "excess", "specs")))):
                v = np.array(v, np.int64)
                for spec in specs:
                    spare = len(v) - max(1, -(-(excess + spec["low"]) // (2 * unit)))
                    if spare < 0:
                        continue
                    salt = spec["pair"] & (2**64 - 1)
                    for some in combinations(v[: spare + spec["matches"]], spec["matches"]):
                        keys.append(xxhash.xxh3_64_intdigest(np.array(some).tobytes(), salt))
                        sides.append(spec["side"])
                        rows.append(facts[i])
                        if len(keys) >= EMIT:
                            yield batch(keys, sides, rows)
                            keys, sides, rows = [], [], []
        if keys:
            yield batch(keys, sides, rows)

    def batch(keys, sides, rows):
        facts = np.array(rows)
        columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sides, pa.int32()), pa.array(facts[:, 0], pa.int64())]
        columns += [pa.array(facts[:, i], pa.int32()) for i in range(1, len(FACTS))]
        return pa.RecordBatch.from_arrays(columns, ["key", "side", *FACTS])

    return run


def _reach(rule: Rule, x: Column, y: Column) -> Column:
    """Whether two sets, of FACTS, can link: they differ in their light shingles and in the lengths of v."""
    apart = F.abs(x["apart"] - y["apart"]) + x["light"] + y["light"]
    return apart * (100 + rule.percent) <= (x["n"] + y["n"]) * (100 - rule.percent)


def _split(lists: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The rows, with component, of lists that hold several components; and of each such list
    top: the key, the component and a member of its largest one.

    In the first turn that is the member with the fewest light shingles, then another one each turn.
    """
    labelled = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "dense-labels")
    order = F.xxhash64("node", "key", F.lit(turn)) if turn else F.col("light").cast("bigint")
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("size"), F.min_by(F.struct(*FACTS), F.struct(order, "node")).alias("first"))
    most = F.max_by(F.struct("component", "first"), F.struct("size", "component")).alias("top")
    top = parts.groupBy("key").agg(most, F.count("*").alias("parts")).where("parts > 1").select("key", "top")
    top = materialize(top, "dense-tops")
    return labelled.join(top.select("key"), "key", "left_semi"), top
