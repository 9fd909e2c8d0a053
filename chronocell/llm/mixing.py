"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the same number of certain whole copies; the fractional rest of the source's target is
filled by a Pareto order sample: documents are ranked by random odds over inclusion odds and taken in that order while
they fit into the source's words. A document that doesn't fit ends a round; the next of FILLS rounds goes over the
documents that are still out and no longer than what is left; in the end the first document still out that brings the
source nearer to its target is taken, even if it goes beyond it. The last document of a round is found on STEP bits of
the rank at a time from per-bin sums, so no source is ever sorted by one task, however large it is, and the result does
not depend on the size of bins.

Defined cases: a null text has size 0, a document of size 0 is never sampled (0 words taken), a null source is a source
of its own and comes last, ties of the rank go by doc_id and the text's hash, rows that repeat are documents of their
own, other columns stay, but size, copies and taken take the place of columns of these names, an empty table gives an
empty result, and a text's length is not limited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, fresh

BITS, STEP = 48, 12
#: A bin of at most so many rows is sorted by one task to find the last document of a round.
BIN_ROWS = 10_000
FILLS = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Adds sid: the place of each row in the order, from 0, without bringing the rows into one task."""
    placed = rows.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__nth"))
    placed = cut(placed, "numbered")
    parts = placed.groupBy("__part").agg(F.count("*").alias("__held"))  # one row a partition
    before = parts.select("__part", (F.sum("__held").over(Window.orderBy("__part")) - F.col("__held")).alias("__before"))
    return placed.join(before, "__part").withColumn("sid", F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def source_targets(sources: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """sources: (source, source_size, n_docs). Adds sid (rank by code point, null last), weight and target.

    Targets share `share` of all sizes by weight; none exceeds `limit` times its source, and what is cut off is shared
    anew by weight. The common level is found from sums alone.
    """
    ranked = cut(numbered(sources, F.col("source").isNull(), "source"), "sources")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) > limit * F.col("source_size")
        s = ranked.agg(F.sum(F.when(full, limit * F.col("source_size"))).alias("cut"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not s.open:
            break
        new = (total - (s.cut or 0.0)) / s.open
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(limit * F.col("source_size"), F.col("weight") * F.lit(max(level, 0.0))))


def last_taken(open_: DataFrame, rest: DataFrame, bin_rows: int) -> DataFrame:
    """open_: (sid, key, doc_id, tie, size), rest: (sid, rest) -> (sid, last, words): of each source the last document of
    the longest run in the order of (key, doc_id, tie) that fits into rest, and the run's words. Sources without one are left out.
    """
    state = rest.select("sid", F.lit(0).cast("long").alias("prefix"), "rest", F.lit(0).cast("long").alias("words"))
    shift, made = BITS, []
    while True:
        inside = open_.join(state, "sid").where(F.shiftright("key", shift) == F.col("prefix"))
        if not shift or (inside.groupBy("sid").count().agg(F.max("count")).first()[0] or 0) <= bin_rows:
            break
        shift -= STEP
        bins = inside.groupBy("sid", "rest", "words", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("held"))
        after = F.sum("held").over(Window.partitionBy("sid").orderBy("bin"))
        bins = bins.withColumn("after", after).withColumn("last_bin", F.max("bin").over(Window.partitionBy("sid")))
        # the bin in which the rest runs out, or the last one if it never does
        found = bins.where((F.col("after") > F.col("rest")) | (F.col("bin") == F.col("last_bin"))).groupBy("sid").agg(F.min(F.struct("bin", (F.col("after") - F.col("held")).alias("before"), "rest", "words")).alias("x"))
        state = cut(found.select("sid", F.col("x.bin").alias("prefix"), (F.col("x.rest") - F.col("x.before")).alias("rest"), (F.col("x.words") + F.col("x.before")).alias("words")), "state")
        made.append(state)
    place = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    so_far = Window.partitionBy("sid").orderBy("key", F.col("doc_id").isNull(), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("after", F.sum("size").over(so_far)).where("after <= rest")
    run = run.groupBy("sid").agg(F.max(place).alias("last"), F.max("after").alias("more"))
    # where nothing of the bin fits, all before the bin is the run
    floor = F.struct(F.shiftleft("prefix", shift).alias("key"), F.lit(False).alias("none"), F.lit(None).cast(open_.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("tie"))
    out = state.join(run, "sid", "left").select("sid", F.coalesce("last", floor).alias("last"), (F.col("words") + F.coalesce("more", F.lit(0))).alias("words"))
    out = cut(out.where("words > 0"), "last-taken")
    if made:
        drop(*made)
    return out


def pareto_mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, limit: float = 3.0, seed: int = 7, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(doc_id, tie, size, source_size, target, copies, taken) of every document; tie is the text's hash.

    Inclusion odds grow with the square root of a document's size over its source's mean, times the odds of the
    source's fractional rate. The random odds come from a hash of doc_id, the text's hash and the seed: reruns agree.
    """
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    base = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.log(u / (1 - u)).alias("logit"), F.xxhash64("text").alias("tie")), "sizes")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sources, weights, share, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    sources = cut(sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")
    joined = base.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    f = F.least(F.greatest(F.col("rest") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = 0.5 * F.log(F.greatest(F.col("size"), F.lit(1)) * F.col("n_docs") / F.greatest(F.col("source_size"), F.lit(1)))
    q = F.exp(F.least(F.greatest(F.col("logit") - odds - F.log(f / (1 - f)), F.lit(-600.0)), F.lit(600.0)))
    key = F.least(F.floor(q / (1 + q) * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    ranked = cut(joined.select("doc_id", "size", "source_size", "target", "sid", "whole", key.alias("key"), "tie"), "ranked")
    drop(base)

    place = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    place = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    rest = cut(sources.select("sid", "rest"), "rest")
    # what a round took is written, so that the next one starts from a table and not from the plans of all before it
    out = cut(ranked.withColumn("extra", F.lit(0).cast("long")), "taken")
    drop(ranked)

    def taken(asked: DataFrame, last: DataFrame, takes) -> DataFrame:
        more = asked.join(last, "sid", "left").withColumn("extra", F.col("extra") + F.coalesce(takes.cast("long"), F.lit(0))).drop("rest", "last")
        new = cut(more, "taken")
        drop(out)
        return new

    for i in range(FILLS):
        fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
        asked = out.join(rest, "sid")
        last = last_taken(asked.where(fits).select("sid", "key", "doc_id", "tie", "size"), rest, bin_rows)
        out = taken(asked, last.select("sid", "last"), fits & (place <= F.col("last")))
        less = cut(rest.join(last.select("sid", "words"), "sid", "left").select("sid", (F.col("rest") - F.coalesce("words", F.lit(0))).alias("rest")), "rest")
        drop(rest, last)
        rest = less
    nearer = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("rest"))
    asked = out.join(rest, "sid")
    end = cut(asked.where(nearer).groupBy("sid").agg(F.min(place).alias("last")), "ends")
    out = taken(asked, end, nearer & (place == F.col("last")))
    out = out.withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(int(limit))))
    return out.select("doc_id", "tie", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.col("whole")).alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with size, copies and taken; rows alike in doc_id and text get the same."""
    docs = docs.drop("size", "copies", "taken")
    key, tie = fresh(docs, "mixed_id", "mixed_tie")
    one = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(key), F.col("tie").alias(tie)).agg(*[F.max(c).alias(c) for c in ("size", "copies", "taken")])
    return docs.join(one, F.col("doc_id").eqNullSafe(F.col(key)) & F.xxhash64("text").eqNullSafe(F.col(tie))).drop(key, tie)
