"""Quality classifier by hierarchical empirical Bayes: document evidence, shrunk host and path rates, one posterior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .linking import slices
from .shingles import Segments, mixed, words

#: Labelled documents that the document classifier is fitted on: those whose doc_id has the least hash.
SAMPLE = 8_000
#: Word forms with evidence that one head keeps at most, the most telling first.
FORMS = 4_096
PREFIXES = (4, 5, 6, 7, 8)
SLICE = 1_000_000
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:?'\"-()"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in STOPS)
HEADS = ("toxic", "poor")


def _forms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, form) of all word forms, each once per text, and shape figures per text.

    Forms are the whole word and its first bytes; a stop after the word is not part of it.
    """
    n = len(texts)
    joined, start, end, counts = words(texts)
    stops = np.zeros(256, bool)
    stops[list(STOPS + b"!")] = True
    end = end - (stops[joined[end - 1]] & (end - start > 1))
    segments = Segments(joined)
    text = np.repeat(np.arange(n), counts)
    whole = segments.hashes(start, end)
    found = [(text, mixed(whole + np.uint64(1)))]
    for k in PREFIXES:
        long = end - start > k
        found.append((text[long], segments.hashes(start[long], start[long] + k)))
    texts_of, forms = (np.concatenate(x) for x in zip(*found, strict=True))

    order = np.argsort((text.astype(np.uint64) << np.uint64(40)) | (whole >> np.uint64(24)), kind="stable")
    same = (text[order][1:] == text[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    run = np.cumsum(np.concatenate(([True], ~same))) - 1 if len(order) else order
    of_run = text[order][np.concatenate(([True], ~same))] if len(order) else order
    sizes = np.bincount(run) if len(run) else run
    distinct = np.bincount(of_run, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of_run, sizes)

    per = np.maximum(counts, 1)
    shape = np.zeros((n, 8))
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        size = max(1, len(raw))
        for column, kind in enumerate((UPPER, DIGITS, SYMBOLS, STOPS)):
            shape[k, column] = (len(raw) - len(raw.translate(None, kind))) / size
        shape[k, 4] = len(raw) / per[k]
    shape[:, 4] = np.log1p(shape[:, 4])
    shape[:, 5] = np.log(per / np.maximum(distinct, 1))
    shape[:, 6] = most / per
    shape[:, 7] = np.log1p(counts)
    return texts_of, forms, shape


def _once(text: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((form, text))
    text, form = text[order], form[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (form[1:] != form[:-1])
    return text[first], form[first]


@dataclass
class Model:
    """Evidence of word forms per head, scales of the features, and logistic weights per head."""

    forms: list[np.ndarray]
    evidence: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        text, form, shape = _forms(texts)
        columns = []
        for known, evidence in zip(self.forms, self.evidence, strict=True):
            total, most = np.zeros(len(texts)), np.zeros(len(texts))
            if len(known):
                seen = np.zeros(1 << 16, bool)
                seen[known & np.uint64(0xFFFF)] = True
                maybe = seen[form & np.uint64(0xFFFF)]
                some_text, some = text[maybe], form[maybe]
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                hit = known[at] == some
                own, forms = _once(some_text[hit], some[hit])
                value = evidence[np.searchsorted(known, forms)]
                total = np.bincount(own, value, minlength=len(texts))
                np.maximum.at(most, own, value)
            columns += [np.log1p(total), most]
        return np.column_stack([*columns, shape])

    def probability(self, features: np.ndarray) -> np.ndarray:
        """That a document is toxic or poor; the heads are taken as independent."""
        x = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])
        good = np.prod(1 / (1 + np.exp(np.clip(x @ self.weights.T, -30, 30))), axis=1)
        return np.clip(1 - good, 1e-6, 1 - 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty, by Newton's method; the first column is constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(counts: DataFrame, columns: dict[str, Column], totals: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Forms and their evidence for one head: ``columns`` and ``totals`` have n (documents) and bad."""
    bad, good = totals["bad"], totals["n"] - totals["bad"]
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    share = (columns["n"] - columns["bad"] + 0.5) / (good + 1)
    lift = F.log(((columns["bad"] + 0.5) / (bad + 1)) / share)
    beyond = (columns["bad"] - bad * share) / F.sqrt(bad * share)
    telling = counts.select("form", lift.alias("lift"), beyond.alias("beyond")).where("lift > 0.7 and beyond > 6")
    found = telling.orderBy(F.desc("beyond"), "form").limit(FORMS).collect()
    keys = np.array([r["form"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["lift"] for r in found])[order]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The document classifier, fitted on a bounded sample of labelled documents.

    ``labels`` has doc_id, quality (0: poor), toxic (1: toxic). Evidence is the log ratio of a form's document
    shares in bad and good documents, kept where it is at least two and far beyond chance. The logistic weights are
    fitted on features whose evidence comes from the other half of the sample; the model then has the evidence of
    all of it. Without labels, or with one class only, a head always gives the share it saw.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
        F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("poor"),
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    # At most ``sample`` rows: the broadcast is bounded by the parameter.
    small = F.broadcast(chosen.select(F.col("doc_id").alias("_doc"), *HEADS, half))
    rows = stored(
        docs.join(small, docs["doc_id"] == small["_doc"]).select("text", *(small[c] for c in (*HEADS, "half"))), "labelled"
    )
    names = ["form", "half", "n", *HEADS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(np.array([len(t.as_py() or "") for t in batch.column(0)]), SLICE):
                part = batch.slice(at, to - at)
                text, form, _ = _forms(part.column(0).to_pylist())
                text, form = _once(text, form)
                toxic, poor, halves = (part.column(c).to_numpy()[text] for c in (1, 2, 3))
                for h in (0, 1):
                    forms, place = np.unique(form[halves == h], return_inverse=True)
                    sums = [np.bincount(place, w[halves == h], minlength=len(forms)).astype(np.int64) for w in (np.ones(len(form)), toxic, poor)]
                    yield pa.record_batch([forms.view(np.int64), np.full(len(forms), h), *sums], names=names)

    totals = {r["half"]: r for r in rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(h) for h in HEADS)).collect()}
    counted = rows.mapInArrow(count, "form long, half long, n long, toxic long, poor long")
    of = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}_{h}")
    counts = stored(counted.groupBy("form").agg(*(of(c, h) for c in ("n", *HEADS) for h in (0, 1))).where("n_0 + n_1 >= 4"), "forms")

    def evidence(halves: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        seen = [h for h in halves if h in totals]
        found = []
        for head in HEADS:
            columns = {"n": sum((F.col(f"n_{h}") for h in halves), F.lit(0)), "bad": sum((F.col(f"{head}_{h}") for h in halves), F.lit(0))}
            found.append(_telling(counts, columns, {"n": sum(totals[h]["n"] for h in seen), "bad": sum(totals[h][head] for h in seen)}))
        return [f for f, _ in found], [e for _, e in found]

    blank = (np.zeros(12), np.ones(12), np.zeros((2, 13)), 0.0)
    other = [Model(*evidence((1,)), *blank), Model(*evidence((0,)), *blank)]
    model = Model(*evidence((0, 1)), *blank)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(np.array([len(t.as_py() or "") for t in batch.column(0)]), SLICE):
                part = batch.slice(at, to - at)
                texts, halves = part.column(0).to_pylist(), part.column(3).to_numpy()
                x = np.where(halves[:, None] == 0, other[0].features(texts), other[1].features(texts))
                yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", *HEADS])

    seen = rows.mapInArrow(describe, "x array<double>, toxic int, poor int").collect()
    model.weights[:, 0] = -30.0
    if seen:
        x = np.array([r["x"] for r in seen])
        order = np.lexsort(x.T)
        x, y = x[order], np.array([[r["toxic"], r["poor"]] for r in seen], float)[order]
        model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        full = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
        for k in range(2):
            model.weights[k] = _logistic(full, y[:, k])
        model.prior = float(y.max(axis=1).mean())
    model.prior = float(np.clip(model.prior, 1e-3, 1 - 1e-3))
    return model


def _strength(groups: DataFrame, centre: Column) -> float:
    """Weight of a prior, in documents, by the method of moments: how far group means lie apart beyond their own noise.

    ``groups`` has n, total, squares (sums of the evidence and of its squares) per group.
    """
    n = F.col("n")
    row = groups.select(
        n, (n * (F.col("total") / n - centre) ** 2).alias("between"), (F.col("squares") - F.col("total") ** 2 / n).alias("inside"),
        F.col("total").alias("total"), (n * n).alias("n2"),
    ).agg(F.sum("n"), F.sum("between"), F.sum("inside"), F.sum("total"), F.sum("n2"), F.count(F.lit(1))).first()
    size, between, inside, total, n2, k = (float(x or 0) for x in row)
    if k < 2 or size <= k or not total:
        return 1e6
    noise = inside / (size - k)
    spread = (between - (k - 1) * noise) / max(size - n2 / size, 1e-9)
    mean = total / size
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e6)) if spread > 0 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, limit: float = 0.5
) -> DataFrame:
    """One row per document: doc_id, text_hash, host, path, evidence, host_rate, path_rate, posterior, kept.

    ``evidence`` is the classifier's probability that the text is toxic or poor. Rates of a host, and of a path inside
    its host, are posterior means under beta priors: the host shrinks to the global rate and the path to its host, by
    weights from the method of moments over all groups, so that a sparse site has next to no say. The posterior of a document is its
    evidence with the training share of bad documents replaced by its path's rate; at ``limit`` or more it isn't kept.

    Null host or path is a group of its own; a null text counts as empty. Repeated rows give a row each. ``text_hash``
    tells apart different texts with one doc_id. Other columns are not read; an empty table gives no rows.
    """
    model = fit(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(np.array([len(t.as_py() or "") for t in batch.column(4)]), SLICE):
                part = batch.slice(at, to - at)
                p = model.probability(model.features(part.column(4).to_pylist()))
                yield pa.record_batch([*(part.column(c) for c in range(4)), pa.array(p)], names=["doc_id", "text_hash", "host", "path", "evidence"])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text",
    )
    scored = stored(
        source.mapInArrow(score, "doc_id long, text_hash long, host string, path string, evidence double"), "evidence"
    )
    sums = (F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares"))
    paths = stored(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    size, total = hosts.agg(F.sum("n"), F.sum("total")).first()
    mean = float(np.clip((total or 0) / (size or 1), 1e-6, 1 - 1e-6))
    weight = _strength(hosts, F.lit(mean))
    rated = hosts.select("host", ((weight * mean + F.col("total")) / (weight + F.col("n"))).alias("host_rate"))
    inside = paths.join(rated.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    weight = _strength(inside, F.col("host_rate"))
    sites = stored(
        inside.select(
            F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate",
            ((weight * F.col("host_rate") + F.col("total")) / (weight + F.col("n"))).alias("path_rate"),
        ),
        "sites",
    )
    here = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    odds = _logit(F.col("evidence")) - float(np.log(model.prior / (1 - model.prior))) + _logit(F.col("path_rate"))
    return scored.join(sites, here).drop("_host", "_path").withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("posterior") < limit)


def keep_good(docs: DataFrame, classified: DataFrame) -> DataFrame:
    """The rows of ``docs`` that weren't rejected, all columns as they are; rows without doc_id are judged by their text."""
    bad = classified.where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")
