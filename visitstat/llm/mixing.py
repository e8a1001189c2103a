"""Mixing sources to target weights by entropy balancing.

Each source s gets a token target T_s. Document rates w_i (expected copies) are
those closest to one copy each that meet the targets: they minimise

    sum_i q_i * (w_i log w_i - w_i + 1)   subject to   sum_{i in s} w_i x_i = T_s,  w_i <= CAP,

with x_i the document's tokens and base weights q_i = x_i^g. The dual has one
multiplier per source, is convex, and its solution is an exponential tilt,
w_i = min(CAP, exp(l_s * x_i^(1-g))) (x in units of the source's mean). Newton
steps on all multipliers at once are sums over (source, size) counts, kept
inside a bracket so that they always converge.

Rates are rounded into whole copies: floor(w) for certain, and one more where a
hash of the document, weighed by the rate's fraction, falls below a threshold
of its source. The threshold is moved until the source's tokens pass from below
to above the target within one document, and single documents then close what
is left of the gap. No document gets more than CAP copies.

Defined results: a null or empty text has size 0 and adds nothing; null
sources are one source, last in order; repeated rows are documents of their
own; an empty table gives an empty result. Extra columns are ignored. Reruns
over the same files agree: ties are settled by hashes of (source, id, size)
and, among rows equal in all three, by their place in the input.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitstat.llm.common import SPACE, fresh
from visitstat.operators.attach import attach
from visitstat.session import write_table

WEIGHTS = (5.0, 2.0, 1.0)     # repeated over the sources in order
CAP = 3                       # most copies of a document, and most times a source's size
SIZE_WEIGHT = 0.5             # g: how strongly a document's size weighs in the divergence
STEPS, TOLERANCE = 60, 1e-9   # Newton steps at most; relative miss that ends them
BINS, PASSES = 512, 8         # threshold search: each pass narrows a source's bracket BINS times
FLIPS = 3                     # single-document corrections per source


# Per-source tables are written before they are joined, so Spark itself checks their
# size and broadcasts them only below its threshold.
_join = partial(attach, checked=False)


def words(text: str = "text") -> Column:
    """Size of a text: its words, null counting as none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) plus ``target``.

    The weights repeat over the sources by code point, null last, and share the
    sum of all sizes. A target stops at ``cap`` times its source's size and the
    excess is shared by weight again until no target is above (the source table, a few
    numbers per source of the mix, is put in order by one task): that is one
    level c with target = min(cap * size, c * weight). With the sources in order
    of cap * size / weight, c is found from running sums over the source table.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = write_table(s, "sources")
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    above = level.rowsBetween(Window.unboundedPreceding, -1)
    total = s.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    rest = s.select("most", "weight", F.coalesce(F.sum("most").over(above), F.lit(0.0)).alias("used"),
                    F.coalesce(F.sum("weight").over(above), F.lit(0.0)).alias("gone"))
    c = rest.select("most", "weight", ((F.lit(float(total["n"] or 0)) - F.col("used"))
                                       / (F.lit(float(total["w"] or 0)) - F.col("gone"))).alias("c"))
    c = c.filter(F.col("most") >= F.col("c") * F.col("weight")).agg(F.max("c").alias("c")).first()["c"]
    share = F.col("most") if c is None else F.least(F.col("most"), F.lit(c) * F.col("weight"))
    return s.select("source", "source_size", share.alias("target"))


def tilts(counts: DataFrame, goals: DataFrame, cap: int = CAP, size_weight: float = SIZE_WEIGHT) -> DataFrame:
    """``goals`` (source, source_size, target) plus mean, tilt and full (the cap binds everywhere).

    ``counts`` has a row (source, size, m) for each size, m documents having it.
    """
    n = write_table(counts.filter("size > 0"), "sizes")
    means = n.groupBy("source").agg((F.sum(F.col("size") * F.col("m")) / F.sum("m")).alias("mean"))
    full = (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-9))) & (F.col("source_size") > 0)
    state = _join(goals, means, ["source"], "left").select(
        "source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.lit(0.0).alias("tilt"),
        full.alias("full"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state = write_table(state, "tilts")
    for _ in range(STEPS):
        state, miss = _newton(n, state, cap, size_weight)
        if miss <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"a source misses its target by {miss:.2g} of it after {STEPS} Newton steps")
    return state.select("source", "source_size", "target", "mean", "tilt", "full")


def rate(size: Column, cap: int, size_weight: float) -> Column:
    """Rate of a document of ``size`` under its source's columns mean, tilt and full."""
    x = F.pow(size / F.col("mean"), F.lit(1 - size_weight))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("tilt") * x, F.lit(math.log(cap)))))


def _newton(n: DataFrame, state: DataFrame, cap: int, size_weight: float) -> tuple[DataFrame, float]:
    """One step for every source; also the largest relative miss before it."""
    size = F.col("size").cast("double")
    w = rate(size, cap, size_weight)
    x = F.pow(size / F.col("mean"), F.lit(1 - size_weight))
    rows = _join(n, state.select("source", "mean", "tilt", "full"), ["source"])
    sums = rows.groupBy("source").agg(
        F.sum(F.col("m") * size * w).alias("got"),
        F.sum(F.when(w < cap, F.col("m") * size * x * w).otherwise(0.0)).alias("slope"))
    s = _join(state, sums, ["source"], "left")
    gap = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
    done = F.col("full") | F.col("got").isNull() | (F.abs(gap) <= F.col("target") * TOLERANCE)
    low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    s = s.withColumns({"gap": gap, "done": done, "low": low, "high": high})
    newton = F.col("tilt") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
    inside = ((F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
              & (F.abs(newton - F.col("tilt")) <= 4 * (1 + F.abs(F.col("tilt")))))
    wide = F.when(F.col("gap") < 0, F.col("tilt") + 1 + F.abs("tilt")).otherwise(F.col("tilt") - 1 - F.abs("tilt"))
    safe = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(wide)
    step = F.when(F.col("done"), F.col("tilt")).otherwise(F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(safe))
    out = s.select("source", "source_size", "target", "mean", step.alias("tilt"), "full", "low", "high",
                   F.when(F.col("done"), F.lit(0.0)).otherwise(F.abs("gap") / F.col("target")).alias("miss"))
    out, seen = write_table(out, "tilts", observe={"miss": F.max("miss")})
    return out.drop("miss"), seen["miss"] or 0.0


def _thresholds(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(source, low, left): for each source the threshold below which extra copies are
    given, and the tokens still missing then (less than the next document's size).

    ``rows``: (source, v, size) of documents with a fractional rate; ``need``:
    (source, need) tokens to be filled with extra copies.
    """
    state = write_table(need.select("source", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"),
                                    F.col("need").alias("left")), "brackets")
    for _ in range(PASSES):
        inside = _join(rows, state, ["source"]).filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high")))
        width = (F.col("high") - F.col("low")) / BINS
        slot = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy("source", slot.alias("slot")).agg(
            F.sum("size").alias("size"), F.countDistinct("v").alias("n"))
        # at most BINS rows per source
        upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        cum = _join(bins.withColumn("cum", F.sum("size").over(upto)), state, ["source"])
        over = cum.filter(F.col("cum") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("slot", (F.col("cum") - F.col("size")).alias("before"), "n")).alias("b"))
        whole = cum.groupBy("source").agg(F.max("cum").alias("all"))
        s = _join(_join(state, over, ["source"], "left"), whole, ["source"], "left")
        at = F.col("low") + (F.col("high") - F.col("low")) / BINS * F.col("b.slot")
        upper = F.col("low") + (F.col("high") - F.col("low")) / BINS * (F.col("b.slot") + 1)
        nxt = s.select("source", F.when(F.col("b").isNull(), F.col("high")).otherwise(at).alias("low"),
                       F.when(F.col("b").isNull(), F.col("high")).otherwise(upper).alias("high"),
                       (F.col("left") - F.coalesce(F.col("b.before"), F.col("all"), F.lit(0))).alias("left"),
                       F.coalesce("b.n", F.lit(0)).alias("n"))
        state, seen = write_table(nxt, "brackets", observe={"n": F.max("n")})
        state = state.drop("n")
        if (seen["n"] or 0) <= 1:
            break
    return state.select("source", "low", "left")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, size_weight: float = SIZE_WEIGHT,
        tag: Column | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies and taken of every document.

    ``tag``: a column that tells rows apart; by default their place in the input.
    """
    tag = F.monotonically_increasing_id() if tag is None else tag
    rows = write_table(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                                   words(text).alias("size"), tag.alias("tag")), "mix_sizes")
    counts = write_table(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("m")), "mix_counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    goals = write_table(tilts(counts, targets(sizes, weights, cap), cap, size_weight), "goals")

    # rates and a hash in [0, 1) per document; rows equal in all three also use their tag
    key = F.xxhash64("source", "doc_id", "size")
    rated = _join(rows, goals, ["source"]).withColumn("rate", F.when(F.col("size") > 0, rate(
        F.col("size").cast("double"), cap, size_weight)).otherwise(F.lit(1.0))).withColumn("key", key)
    rated = rated.withColumn("base", F.floor("rate").cast("bigint"))
    again = rows.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    rated = write_table(rated, "rated")
    twin = again.withColumn("twin", F.lit(True))
    u = F.pmod(F.when(F.col("twin"), F.xxhash64("key", "tag")).otherwise(F.xxhash64("key")), F.lit(1 << 52)) / float(1 << 52)
    frac = F.col("rate") - F.col("base")
    placed = rated.join(write_table(twin, "twins"), "key", "left").withColumn("u", u)
    placed = placed.withColumn("v", F.when(frac > 0, F.col("u") / (F.col("u") + frac)).otherwise(F.lit(2.0)))
    placed = write_table(placed.drop("twin", "mean", "tilt", "full"), "placed")

    sure = placed.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("sure"))
    need = _join(goals.select("source", "target"), sure, ["source"]).select(
        "source", (F.col("target") - F.col("sure")).alias("need"))
    edge = write_table(_thresholds(placed.filter("v < 1 AND size > 0").select("source", "v", "size"), need), "edges")
    out = _join(placed, edge, ["source"]).withColumn(
        "copies", F.col("base") + (F.col("v") < F.col("low")).cast("bigint")).drop("low", "left", "v")
    gaps = edge.select("source", F.col("left").alias("gap"))
    out = _close(write_table(out, "copies"), gaps, cap)
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "tag")


def _close(rows: DataFrame, gaps: DataFrame, cap: int) -> DataFrame:
    """Close each source's gap with at most FLIPS documents: the one whose single copy
    more (or less) leaves the smallest rest, ties by hash."""
    for _ in range(FLIPS):
        d = F.when(F.col("gap") > 0, 1).otherwise(-1)
        able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        left = F.col("gap") - d * F.col("size")
        better = able & (F.abs(left) < F.abs("gap")) & (F.col("size") > 0)
        best = _join(rows, gaps, ["source"]).filter(better).groupBy("source").agg(
            F.min(F.struct(F.abs(left).alias("miss"), F.col("u"), F.col("tag"), d.alias("d"), left.alias("left"))).alias("b"))
        best = write_table(best, "flips")
        change = best.select(F.col("b.tag").alias("tag"), F.col("b.d").alias("d"))
        rows = write_table(_join(rows, change, ["tag"], "left").withColumn(
            "copies", F.col("copies") + F.coalesce("d", F.lit(0))).drop("d"), "copies")
        gaps = write_table(_join(gaps, best.select("source", "b.left"), ["source"], "left").select(
            "source", F.coalesce("left", "gap").alias("gap")), "gaps")
    return rows


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` (all columns), each repeated as often as the mix takes it."""
    row, copies = fresh(docs.columns, "row", "copies")
    tagged = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    plan = mix(tagged, doc_id, text, source, tag=F.col(row), **how)
    plan = plan.filter("copies > 0").select(F.col("tag").alias(row), F.col("copies").cast("int").alias(copies))
    # the plan grows with the documents: a shuffle join at every size
    taken = tagged.join(plan.hint("merge"), row)
    return taken.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
