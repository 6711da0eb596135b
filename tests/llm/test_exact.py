"""Exact dedup, sharding, packing and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabary.llm import packing, stages
from syllabary.llm.mixing import mixed_rows, pareto_mix
from syllabary.llm.naming import exact_dedup
from syllabary.llm.sharding import minimax_cuts, shard

from .helpers import SCHEMA, corpus, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c) % 2])
def test_exact_dedup(spark, key):
    rows = corpus() + [(900, "ÄB c", "en", "a", 4), (901, "Äb C", "en", "a", 4), (902, "äb c", "en", "a", 4)]
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    got = exact_dedup(frame(spark, rows), block_bytes=16, key=key).collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").translate(LOWER) for r in rows}
    for r in got:
        ids = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), r["doc_id"] == max(ids))
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_of_odd_rows(spark):
    rows = [(1, "a", None, None, 1), (1, "a", None, None, 1), (1, "b", None, None, 1), (None, "a", None, None, 1), (None, "c", None, None, 1)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {(1, 1, 3, True), (None, 1, 3, False), (1, 1, 1, True), (None, None, 1, True)}
    assert exact_dedup(frame(spark, rows)).count() == len(rows)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_of_equal_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr("syllabary.llm.naming.EXPANDED", 3)
    rows = [(None, "a" * 40, None, None, 1)] * 7 + [(None, "B", None, None, 1)] * 2 + [(5, "b", None, None, 1)]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(frame(spark, rows), block_bytes=16).collect())
    assert got == {(None, None, 7, True): 7, (None, 5, 3, False): 2, (5, 5, 3, True): 1}


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    places = defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        places[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values()) and max(places) < shards
    of_text = defaultdict(set)
    for r in got:
        of_text[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    return Counter({s: sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)})


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_sharding(spark, shards):
    rows = corpus(120, seed=2) + [(1000 + i, "copied text", "en", "a", 11) for i in range(150)]
    sizes = check_shards(rows, shard(frame(spark, rows), shards).collect(), shards)
    groups = Counter()
    for r in rows:
        groups[hashlib.sha256((r[1] or "").encode()).digest()] += len((r[1] or "").encode()) + 16
    assert max(sizes.values()) <= least_capacity([groups[k] for k in sorted(groups)], shards)


def test_sharding_of_odd_tables(spark):
    assert shard(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None)] * 3 + [(None, "x", None, None, 1)]
    got = shard(frame(spark, rows)).collect()
    assert sorted((r["size"], r["slot"]) for r in got) == [(16, 0), (16, 1), (16, 2), (17, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_minimax_refines_bins(spark, seed, monkeypatch):
    from syllabary.llm import sharding

    monkeypatch.setattr(sharding, "FIRST_BINS", 4)
    monkeypatch.setattr(sharding, "REFINED", 2)
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 60, 90)]
    ends = spark.createDataFrame([(int(e), s) for e, s in zip(np.cumsum(sizes), sizes, strict=True)], "end long, bytes long")
    capacity, cuts = minimax_cuts(ends, sum(sizes), max(sizes), 7)
    assert capacity == least_capacity(sizes, 7)
    widths = np.diff([0, *cuts])
    assert cuts[-1] == sum(sizes) and max(widths) <= capacity and set(cuts) <= set(np.cumsum(sizes))


def encode_whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(stages.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_encoder_gives_the_ids_of_whole_texts():
    texts = [r[1] or "" for r in corpus(60, seed=5)] + [
        "a  b", " a b ", "\n\na \n b\t c", "x <|endoftext|> y", "don't stop\x1c now", "漢 字\r\n", "\n", "  ", "1 2 3!\n\n", "é\n!", "a\n b", "😀  x",
    ]
    encoder = packing.Encoder(stages.tokenizer_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == encode_whole(texts)
    encoder.merger = None
    encoder.known.clear(), encoder.odd.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == got


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    rows = corpus(60, seed=3) + [(7, "again", None, None, 5)] * 2
    got = packing.pack(frame(spark, rows), stages.tokenizer_path(), capacity).collect()
    unique = {r[0]: r[1] or "" for r in rows if r[0] != 7}
    ids = dict(zip(unique, [[*x, 2] for x in encode_whole(list(unique.values()))], strict=True))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc, full in ids.items():
        own, at = sorted(pieces[doc], key=lambda r: r["piece"]), 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(full)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == len(best_fit([r["length"] for r in got], capacity))
    assert packing.pack(frame(spark, []), stages.tokenizer_path()).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        room = [(b, i) for i, b in enumerate(bins) if b >= length]
        if room:
            bins[min(room)[1]] -= length
        else:
            bins.append(capacity - length)
    return bins


def water(sizes, weights, share, limit):
    whole, caps = share * sum(sizes.values()), {k: limit * v for k, v in sizes.items()}
    full = set()
    while True:
        free = [k for k in sizes if k not in full]
        rate = (whole - sum(caps[k] for k in full)) / sum(weights[k] for k in free) if free else 0
        over = {k for k in free if weights[k] * rate > caps[k]}
        if not over:
            return {k: caps[k] if k in full else weights[k] * rate for k in sizes}
        full |= over


def test_mixing(spark):
    rows = [(i, ("w " * (1 + (i * 7919) % 60)).strip(), "en", "abcde"[min(4, i % 7)] if i % 11 else None, 1) for i in range(600)]
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", None, 0), (1002, "  x", "en", "e", 3)]
    docs = frame(spark, rows)
    got = pareto_mix(docs).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    order = sorted(s for s in sizes if s is not None) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in want)
    again = pareto_mix(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}
    other = pareto_mix(docs, seed="else").collect()
    assert {(r["doc_id"], r["taken"]) for r in other} != {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixed_rows(docs, pareto_mix(docs))
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"] and r["size"]})


def test_mixing_of_odd_tables(spark):
    assert pareto_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["taken"] for r in pareto_mix(frame(spark, [(1, None, None, None, 0), (None, "", None, "a", 0)])).collect()} == {0}
    rows = [(1, "a b c", None, "s", 5)] * 2
    assert sum(r["taken"] for r in pareto_mix(frame(spark, rows)).collect()) in (6, 9, 12)


def test_mixing_of_rows_without_own_id(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, source in enumerate(["a"] * 600 + ["b"] * 600 + ["c"] * 9000):
        doc = None if i % 3 == 0 else 7 if i % 3 == 1 and source == "c" and i % 2 else i
        rows.append((doc, " ".join(f"w{x}" for x in rng.integers(0, 1000, int(rng.integers(1, 40)))), "en", source, 1))
    docs = frame(spark, rows)
    got = pareto_mix(docs).collect()
    assert len(got) == len(rows) == len({(r["doc_id"], r["nth"]) for r in got})
    taken, named, target, chance = Counter(), Counter(), {}, {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]], chance[r["source"]] = r["target"], r["target"] / r["source_size"] % 1
        named[(r["source"], r["doc_id"] is None)] += r["copies"] - int(r["target"] / r["source_size"])
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert 0.2 < chance["c"] < 0.45
    for without in (True, False):
        n = sum(r["source"] == "c" and (r["doc_id"] is None) == without for r in got)
        assert abs(named[("c", without)] - chance["c"] * n) <= 0.1 * chance["c"] * n
    size = Counter()
    for r in got:
        size[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    mixed = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixed_rows(docs, pareto_mix(docs.repartition(5))).collect())
    assert mixed == +size
