"""Mixing sources to target weights: certain whole copies first, then a Pareto order sample for what is left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, running, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Single documents that a source may add or give back to come closer to its target.
CORRECTIONS = 3


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, nth: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id, the row's number and the seed only: 52 bits of an MD5."""
    row = F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), row)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def numbered(rows: DataFrame, doc_id: Column, order: Mapping[str, Column], column: str) -> DataFrame:
    """``rows`` with ``column``: the number of the row, from 1, among those of its doc_id by ``order``; null is one id.

    So (doc_id, number) is a key of the row. Rows that agree in ``order`` are numbered in any way. Only rows without doc_id
    or with a repeated one are dealt, by ranges, as one id may hold many of them.
    """
    mark, same, at, *names = free(rows, "_again", "_same", "_at", *order)
    several = rows.groupBy(doc_id.alias(mark)).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(mark).isNull())
    again = stored(several.select(mark), "repeated")
    if again.isEmpty():
        return rows.withColumn(column, F.lit(1).cast("long"))
    repeated = again.where(F.col(mark).isNotNull())
    once = rows.where(doc_id.isNotNull()).join(repeated, doc_id == F.col(mark), "left_anti").withColumn(column, F.lit(1).cast("long"))
    odd = rows.where(doc_id.isNull()).unionByName(rows.join(repeated, doc_id == F.col(mark), "left_semi"))
    keyed = odd.select("*", doc_id.alias(same), *(c.alias(k) for k, c in zip(names, order.values(), strict=True)), F.monotonically_increasing_id().alias(at))
    placed = running(keyed, [*names, at], {column: F.lit(1)}, within=[same], name="numbered")
    return once.unionByName(placed.select(*(F.col(f"`{c}`") for c in rows.columns), column))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Sources in code point order, null last, get the weights in turn. A target that would be above ``limit`` times its
    source stops there, and the excess is shared by weight among the others, until none is above. One row per source.
    """
    marked = running(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], {"_place": F.lit(1)}, name="sources")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    capped = F.col("source_size") * F.lit(float(limit))
    ranked = stored(
        marked.withColumn("weight", turn[((F.col("_place") - 1) % len(weights)).cast("int")]).withColumn("_cap", capped), "weights"
    )
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    rate = None
    while True:
        # Whoever is above its cap at one rate is so at every higher one, so the set of capped sources only grows.
        above = F.lit(False) if rate is None else F.col("weight") * rate > F.col("_cap")
        caps, free = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (whole - caps) / free if free else rate
        if new == rate or new is None:
            break
        rate = new
    rate = rate or 0.0
    return ranked.select("source", "source_size", F.least(F.col("weight") * rate, F.col("_cap")).alias("target"))


def pareto_mix(
    docs: DataFrame,
    seed: str = "mix",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    corrections: int = CORRECTIONS,
) -> DataFrame:
    """One row per document: doc_id, nth, source, size, source_size, target, copies, taken (copies times size).

    A source's target over its size gives each document its expected copies. Their whole part is certain. The rest is
    an inclusion probability, and documents are ranked by their random odds divided by the odds of inclusion (Pareto order
    sampling): in each source, those whose middle word lies within what the target has left, in this order, get one copy more.
    Then the single document that brings the source closest to its target is added or given back, at most
    ``corrections`` times; ties go to the least rank. Random numbers come from doc_id, nth and seed, so reruns agree.

    Null text has size 0; documents of size 0 are taken 0 words. Null sources are one source, the last. Rows without doc_id
    or repeating one are documents of their own: nth numbers the rows of an id by source, size and text (1 where the id is
    unique), and (doc_id, nth) is the key of a row. Other columns are not read; an empty table gives no rows.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("_text"),
        ),
        "sizes",
    )
    by_text = {"_source": F.col("source"), "_size": F.col("size"), "_hash": F.col("_text")}
    keyed = numbered(rows, F.col("doc_id"), by_text, "nth").drop("_text")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(sizes, weights, share, limit), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = aims.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.floor(ratio).cast("long").alias("_sure"), (ratio - F.floor(ratio)).alias("_chance"),
    )
    chance, u = F.greatest(F.col("_chance"), F.lit(1e-12)), uniform(F.col("doc_id"), F.col("nth"), seed)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    drawn = keyed.join(planned, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_rank", odds)
    ordered = running(drawn, ["_rank", "doc_id", "nth"], {"_upto": F.col("size")}, within=["source"], name="drawn")
    rest = F.col("target") - F.col("_sure") * F.col("source_size")
    taken = (F.col("_upto") - F.col("size") / 2 <= rest) & (F.col("size") > 0) & (F.col("_chance") > 0)
    current = stored(ordered.withColumn("_extra", taken.cast("long")).drop("_upto"), "drawn-0")
    for k in range(corrections):
        got = current.groupBy("source").agg(
            (F.max(rest) - F.sum(F.col("_extra") * F.col("size"))).alias("_gap"), F.max("_chance").alias("_c")
        )
        gaps = got.select(F.col("source").alias("_source"), F.when(F.col("_c") > 0, F.col("_gap")).alias("_gap"))
        here = current.join(gaps, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        step = F.when(F.col("_extra") == 0, F.col("size")).otherwise(-F.col("size"))
        better = (F.col("size") > 0) & (F.abs(F.col("_gap") - step) < F.abs(F.col("_gap")))
        least = F.struct(F.abs(F.col("_gap") - step).alias("off"), F.col("_rank").alias("rank"), F.col("doc_id").alias("doc"), F.col("nth").alias("nth"))
        best = here.where(better).groupBy("source").agg(F.min(least).alias("_best"))
        chosen = best.select(
            F.col("source").alias("_source"), F.col("_best.rank").alias("_r"), F.col("_best.doc").alias("_d"), F.col("_best.nth").alias("_k")
        )
        row = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("nth") == F.col("_k"))
        match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_rank") == F.col("_r")) & row
        flipped = current.join(chosen, match, "left")
        extra = F.when(F.col("_r").isNotNull(), 1 - F.col("_extra")).otherwise(F.col("_extra"))
        current = stored(flipped.withColumn("_extra", extra).select(*current.columns), f"drawn-{k + 1}")
    copies = F.col("_sure") + F.col("_extra")
    return current.select(
        "doc_id", "nth", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns as they are.

    Rows and mix meet by doc_id and the number of the row in it, so rows without doc_id or repeating one have copies of
    their own. Documents without words are not part of a mix by words and stay out.
    """
    doc_id = F.col("doc_id").cast("long")
    nth, doc, k, count, copy = free(docs, "_nth", "_doc", "_k", "_times", "_copy")
    times = mix.where("size > 0 and copies > 0").select(F.col("doc_id").alias(doc), F.col("nth").alias(k), F.col("copies").alias(count))
    by_text = {"_source": F.col("source").cast("string"), "_size": word_count(F.col("text")), "_hash": F.xxhash64("text")}
    rows = numbered(docs, doc_id, by_text, nth)
    joined = rows.join(times, doc_id.eqNullSafe(F.col(doc)) & (F.col(nth) == F.col(k)))
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
