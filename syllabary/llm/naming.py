"""Exact dedup by deterministic block naming: blocks become integers, then pairs of integers do, up to one per document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for "no right neighbour"; names of blocks are above it.
NONE = -(2**63)
#: Rows that one step of the expansion of equal rows gives.
EXPANDED = 65_536


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _named(values: DataFrame) -> DataFrame:
    """An integer ``name`` for each distinct row, rising in sorted order inside each part of the table."""
    distinct = values.distinct()
    return distinct.sortWithinPartitions(*values.columns).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = 1024, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, sha (of the lower-cased text), level, name, rows: two texts are equal exactly if level and name are.

    Distinct blocks are grouped by their whole bytes, sorted and numbered. Documents find the numbers by ``key``, a
    64-bit hash; where several blocks share a key, they get numbers of their own and are found by all their bytes.
    So no text passes through more than that one shuffle, and the names hold without trust in the hash.
    Each later level names pairs of neighbours; a document leaves with its level once it has one name.
    Null text counts as empty (one empty block). Rows that agree in doc_id and text are named once, and ``rows`` counts them.
    """
    body = ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    last = F.floor(F.greatest(F.octet_length("_body") - 1, F.lit(0)) / block_bytes).cast("int")
    # No document is without a block. The outer form only keeps Spark from testing that first, which it would do by
    # working out the text anew for each block.
    blocks = (
        docs.select(F.col("doc_id").alias("_doc"), body.alias("_body"))
        .select(
            "_doc",
            F.unhex(F.sha2("_body", 256)).alias("_sha"),
            last.alias("_last"),
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.substr(F.col("_body"), i * block_bytes + 1, F.lit(block_bytes)),
            ).alias("_blocks"),
        )
        .select("_doc", "_sha", "_last", F.posexplode_outer("_blocks").alias("_pos", "_block"))
        .withColumn("_key", key(F.col("_block")))
    )
    numbers = _named(blocks.select("_key", "_block"))
    by_key = stored(numbers.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_name")), "names")
    shared = by_key.where("_n > 1").select("_key")
    current = blocks.drop("_block").join(by_key, "_key").where("_n = 1").drop("_n", "_key")
    if not shared.isEmpty():
        apart = blocks.join(shared, "_key", "left_semi")
        own = stored(_named(apart.select("_key", "_block")), "names-shared-key")
        rest = apart.join(own, ["_key", "_block"]).select("_doc", "_sha", "_last", "_pos", (-1 - F.col("name")).alias("_name"))
        current = current.unionByName(rest)
    once = current.groupBy("_doc", "_sha", "_pos").agg(
        F.first("_last").alias("_last"), F.first("_name").alias("_name"), F.count(F.lit(1)).alias("_rows")
    )
    current = stored(once, "level-0")
    level, done = 0, []
    while True:
        done.append(
            current.where("_last = 0").select("_doc", "_sha", F.lit(level).alias("level"), F.col("_name").alias("name"), F.col("_rows").alias("rows"))
        )
        rows = current.where("_last > 0")
        if rows.isEmpty():
            break
        level += 1
        even = F.col("_pos") % 2 == 0
        pairs = (
            rows.withColumn("_pair", F.floor(F.col("_pos") / 2).cast("int"))
            .groupBy("_doc", "_sha", "_last", "_pair")
            .agg(
                F.max(F.when(even, F.col("_name"))).alias("_a"), F.max(F.when(~even, F.col("_name"))).alias("_b"), F.max("_rows").alias("_rows")
            )
            .withColumn("_b", F.coalesce("_b", F.lit(NONE)))
        )
        names = _named(pairs.select("_a", "_b"))
        current = stored(
            pairs.join(names, ["_a", "_b"]).select(
                "_doc", "_sha", F.floor(F.col("_last") / 2).cast("int").alias("_last"), F.col("_pair").alias("_pos"), F.col("name").alias("_name"), "_rows"
            ),
            f"level-{level}",
        )
    return reduce(DataFrame.unionByName, done).withColumnsRenamed({"_doc": "doc_id", "_sha": "sha"})


def exact_dedup(docs: DataFrame, block_bytes: int = 1024, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; the largest doc_id of equal texts stays.

    Null text is empty; equal means identical after lower-casing A-Z. Every row is a document: rows repeated with the same
    doc_id and text all return, count, and stay or go together. Null doc_ids lose to any number; where a group has no other, keep_id is null and its rows stay. Other columns are not read; an empty table
    gives an empty result.
    """
    named = identities(docs, block_bytes, key)
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    # In steps, so that no array is long where many rows share a text.
    step = F.lit(EXPANDED).cast("long")
    steps = named.join(groups, ["level", "name"]).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, step)))
    each = steps.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(step, F.col("rows") - F.col("_from")))))
    return each.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
