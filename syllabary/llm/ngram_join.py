"""Near-duplicate documents: n-gram Jaccard join by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored
from .linking import bitmap, components, marked, slices, star_edges, verified
from .shingles import band_hashes, choose_bands, signatures, word_shingles

#: Characters of text that are turned into shingles at once.
SLICE = 1_000_000


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_py() or "") for t in batch.column(1)], np.int64)
            for at, to in slices(sizes, SLICE):
                texts = batch.column(1).slice(at, to - at).to_pylist()
                hashes, counts = word_shingles(texts, width)
                found = band_hashes(signatures(hashes, counts, bands * rows), bands, rows).view(np.int64)
                full = counts > 0
                offsets = np.concatenate(([0], np.cumsum(full * bands)))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array([hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found[full].ravel())),
                    ],
                    names=["doc_id", "key", "shingles", "bands"],
                )

    return run


def _classified(docs: DataFrame, words: int, threshold: float, recall: float, hashes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each row, and of each distinct text its key, class_id, links, copies, and whether it stays."""
    bands, rows = choose_bands(threshold, recall, hashes)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = stored(
        source.mapInArrow(_signed(words, bands, rows), "doc_id long, key binary, shingles long, bands array<long>"), "signed"
    )
    # Each distinct text is a node of its own, whether or not its rows have a doc_id.
    distinct = slim.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("shingles").alias("weight"), F.first("bands").alias("bands")
    )
    texts = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "texts")
    clusters = components(star_edges(texts.select("id", "bands"), "near"), "candidates")
    chosen = texts.join(clusters, "id").select(F.col("root").alias("cluster"), "id", "weight", "key")
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    bodies = source.where("text is not null").select(key.alias("key"), "text")
    links = verified(chosen, bodies, word_shingles, words, threshold, "near")
    classes = components(links.select("id", "other"), "classes")
    per_id = links.groupBy("id").agg(F.sum("links").alias("links")).join(classes, "id", "left")
    named = stored(texts.drop("bands", "weight").join(per_id, "id", "left").withColumn("root", F.coalesce("root", "id")), "text-classes")
    place = F.struct(F.col("least").isNull().alias("nameless"), "least", "key")
    # Only classes of several texts can have a least id or a keeper that isn't the text's own.
    best = named.where("links is not null").groupBy("root").agg(F.min(place).alias("first")).select(F.col("root").alias("_root"), "first")
    joined = named.join(best, F.col("root") == F.col("_root"), "left")
    single = F.col("first").isNull()
    return slim.select("doc_id", "key"), joined.select(
        "key", F.when(single, F.col("least")).otherwise(F.col("first.least")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), "copies", "least", (single | (F.col("first.key") == F.col("key"))).alias("stays"),
    )


def ngram_join(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.99, hashes: int = 128) -> DataFrame:
    """One row per document: doc_id, class_id, links, copies.

    Distinct texts are nodes, and two of them are linked if the Jaccard index of their sets of ``words``-grams (lower
    case, split at white space; a shorter text is one gram) is at least ``threshold``. class_id is the least doc_id of the
    connected component, links the number of different texts that the text is linked with, copies the number of documents
    with exactly this text. Bands and rows are the pair with most rows, within ``hashes``, that finds a pair at the
    threshold with probability ``recall``; members of a bucket are joined through a leader into candidate clusters, and
    inside a cluster all pairs are compared exactly, block by block.

    A text without words (null, empty) is linked with nothing; equal ones are copies. Rows repeated with one doc_id and
    text are copies of each other in one class; different texts under one doc_id are nodes of their own. Rows without doc_id
    take part; their class is null only where no row of it has an id. Other columns are not read; an empty table gives no rows.
    """
    rows, texts = _classified(docs, words, threshold, recall, hashes)
    return rows.join(texts, "key").select("doc_id", "class_id", "links", "copies")


def one_per_class(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.99, hashes: int = 128) -> DataFrame:
    """One row of ``docs`` for each class of ``ngram_join``, the one with the least doc_id (those without come last); all
    columns as they are. Rows that surely stay are never sent: a bitmap tells them from those that may go or be repeated."""
    rows, texts = _classified(docs, words, threshold, recall, hashes)
    pair, maybe, other = free(docs, "_pair", "_maybe", "_other")

    def named(key: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(key))

    counted = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).join(texts.select("key", "stays", "least"), "key")
    stays = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least"))
    odd = counted.where(~stays | (F.col("n") > 1)).select(named(F.col("key")).alias(pair), (~stays).alias("gone"))
    odd = stored(odd, "copies")
    own = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    told = marked(docs.withColumn(pair, named(own)), bitmap(odd, pair), pair, maybe)
    gone = odd.where("gone").select(F.col(pair).alias(other))
    left = told.where(F.col(maybe)).join(gone, F.col(pair) == F.col(other), "left_anti").dropDuplicates([pair])
    return told.where(~F.col(maybe)).unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))
