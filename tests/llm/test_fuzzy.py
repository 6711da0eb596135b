"""Near-duplicate, suffix, neighbour, list and quality operators against plain Python."""

import datetime as dt
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from syllabary.llm import ann, linking, suffix_dedup
from syllabary.llm.fuzzy_lines import fuzzy_lines, without_repeats
from syllabary.llm.mixing import mixed_rows, pareto_mix
from syllabary.llm.ngram_join import ngram_join, one_per_class
from syllabary.llm.quality import classify, keep_good
from syllabary.llm.shingles import choose_bands, signatures, word_shingles
from syllabary.llm.suffix_dedup import remove_repeats
from syllabary.llm.url_lists import host_of, intervals, judge

from .helpers import SCHEMA, corpus, frame


def word_grams(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def char_grams(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def classes(items, grams):
    """Links and components by comparing everything with everything."""
    sets = {k: grams(k) for k in items}
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for a, b in itertools.combinations(items, 2):
        union = len(sets[a] | sets[b])
        if union and len(sets[a] & sets[b]) / union >= 0.8:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    return links, {k: find(k) for k in items}


def near(n, seed):
    """Groups of near copies of one long text each."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = [f"w{rng.randrange(9999)}" for _ in range(100)]
        for c in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(100)] = "x"
            rows.append((1000 * (k + 1) + c, " ".join(own[:50]) + "\n" + " ".join(own[50:]), "en", "a", 1))
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "BLOCK_MEMBERS", block)
    rows = corpus() + near(8, 1)
    text = {r[0]: r[1] or "" for r in rows}
    links, root = classes(sorted(set(text.values())), word_grams)
    least = {}
    for doc in sorted(text):
        least.setdefault(root[text[doc]], doc)
    copies = Counter(text.values())
    docs = frame(spark, rows)
    joined = ngram_join(docs)
    got = {r["doc_id"]: (r["class_id"], r["links"], r["copies"]) for r in joined.collect()}
    assert got == {d: (least[root[t]], links[t], copies[t]) for d, t in text.items()}
    left = one_per_class(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(least.values())


def test_ngram_join_of_odd_rows(spark):
    rows = [(1, "a b c d e f", None, None, 1)] * 2 + [(None, "a b c d e f", None, None, 1), (2, None, None, None, 1), (3, "A b  c d\ne f", None, None, 1), (3, "z", None, None, 1)]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["links"], r["copies"]) for r in ngram_join(frame(spark, rows)).collect())
    assert got == [(0, 1, 1, 3), (1, 1, 1, 3), (1, 1, 1, 3), (2, 2, 0, 1), (3, 1, 1, 1), (3, 3, 0, 1)]
    assert ngram_join(frame(spark, [])).count() == 0
    clash = frame(spark, rows).selectExpr("*", "7 as _key", "8 as _row", "9 as _other", "10 as __key", "11 as stays")
    left = one_per_class(clash)
    assert left.columns == clash.columns and sorted((r["doc_id"], r["text"], r["_row"]) for r in left.collect() if r["text"]) == [
        (1, "a b c d e f", 8), (3, "z", 8)]
    assert left.count() == 3
    nameless = [(None, r[1] + f" {k % 3}", None, None, 1) for k in range(6) for r in [(0, " ".join(f"w{i}" for i in range(60)))]]
    assert {(r["class_id"], r["links"], r["copies"]) for r in ngram_join(frame(spark, nameless)).collect()} == {(None, 2, 2)}
    assert one_per_class(frame(spark, nameless)).count() == 1


def test_bands_and_signatures():
    bands, rows = choose_bands(0.8, 0.99, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.99
    base = [f"w{i}" for i in range(400)]
    hashes, counts = word_shingles([" ".join(base), " ".join(base[:360]), "", None], 5)
    assert counts.tolist() == [396, 356, 0, 0]
    a, b, none, _ = signatures(hashes, counts, 2000)
    assert abs((a == b).mean() - 356 / 396) < 0.03 and (none == 0xFFFFFFFF).all()


def test_hashes_of_items_are_held_once_each():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(58)
    counts = np.array([0, 100, 1, 0, 150, 49])
    held, item = linking._held(hashes, counts)
    wanted = sorted({(h, i) for h, i in zip(hashes.tolist(), np.repeat(np.arange(6), counts).tolist(), strict=True)})
    number = {h: k for k, h in enumerate(sorted(set(hashes.tolist())))}
    assert list(zip(held.tolist(), item.tolist(), strict=True)) == [(number[h], i) for h, i in wanted]
    assert [len(x) for x in linking._held(hashes[:0], counts[:0])] == [0, 0]


def test_small_clusters_link_inside_only():
    sets = [{1, 2, 3, 4, 5}, {1, 2, 3, 4, 5}, {1, 2, 3, 4, 5}, {1, 2, 3, 4}, {9}]
    hashes = np.concatenate([np.repeat(np.array(sorted(x), np.uint64), 2) for x in sets])
    a, b = linking._few_links(hashes, np.array([2 * len(x) for x in sets]), np.array([0, 7, 0, 7, 7]), 0.8)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (1, 3)]


def test_what_stays_of_a_text_is_asked_once(spark):
    docs = frame(spark, [(1, "a line that is here twice\na line that is here twice", None, None, 1)])
    left = without_repeats(docs, fuzzy_lines(docs))
    assert left._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["text"] for r in left.collect()] == ["a line that is here twice"]


def expected_lines(rows):
    lines = [(r[0], i, x) for r in rows for i, x in enumerate((r[1] or "").split("\n")) if x.strip()]
    _, root = classes(sorted({x for *_, x in lines}), char_grams)
    first = {}
    for doc, i, x in sorted(lines):
        first.setdefault(root[x], (doc, i))
    return {(doc, i): first[root[x]] for doc, i, x in lines}


@pytest.mark.parametrize("block", [3, 256])
def test_fuzzy_lines(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "BLOCK_MEMBERS", block)
    rows = corpus(30, seed=4) + near(6, 2)
    docs = frame(spark, rows)
    lines = fuzzy_lines(docs)
    got = {(r["doc_id"], r["line"]): (r["keep_doc"], r["keep_line"]) for r in lines.collect()}
    want = expected_lines(rows)
    assert got == want
    left = {r["doc_id"]: r for r in without_repeats(docs, lines).collect()}
    for r in rows:
        own = (r[1] or "").split("\n")
        keeps = [x for i, x in enumerate(own) if want.get((r[0], i), (r[0], i)) == (r[0], i)]
        if any(x.strip() for x in own) and not any(x.strip() for x in keeps):
            assert r[0] not in left
        else:
            assert left[r[0]]["text"] == (None if r[1] is None else "\n".join(keeps))
            assert left[r[0]]["n_chars"] == (r[4] if len(keeps) == len(own) else len("\n".join(keeps)))
    assert without_repeats(docs, lines).columns == docs.columns


def test_fuzzy_lines_of_odd_rows(spark):
    rows = [(1, "same line here\n\nsame line here", None, None, 1)] * 2 + [(None, "same line here\nother", None, None, 1), (2, None, None, None, None)]
    got = {(r["doc_id"], r["line"], r["keep_doc"], r["keep_line"], r["kept"]) for r in fuzzy_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0, 1, 0, True), (1, 2, 1, 0, False), (None, 0, 1, 0, False), (None, 1, None, 1, True)}
    assert fuzzy_lines(frame(spark, [])).count() == 0
    assert without_repeats(frame(spark, rows), fuzzy_lines(frame(spark, rows))).count() == 4


@pytest.mark.parametrize("named", [True, False])
def test_fuzzy_lines_where_rows_share_an_id(spark, named):
    rng = random.Random(8)
    rows, texts = [], []
    for g in range(8):
        base = "".join(rng.choice("abcdefghijklmnop") for _ in range(120))
        x, y, z = base[:100], base[8:], base[10:]
        texts += [x, y, z]
        shared = 100 + g if named else None
        rows += [(shared, y, None, None, 1), (shared, x, None, None, 1), (1 + g, z, None, None, 1)]
    _, root = classes(sorted(texts), char_grams)
    got = fuzzy_lines(frame(spark, rows))
    assert got.count() == 24
    least = {}
    for doc, text, *_ in rows:
        place = (doc is None, doc or 0)
        least[root[text]] = min(least.get(root[text], place), place)
    want = Counter((doc, (doc is None, doc or 0) == least[root[text]]) for doc, text, *_ in rows)
    assert Counter((r["doc_id"], r["kept"]) for r in got.collect()) == want
    stay = [(doc, text) for doc, text, *_ in rows if doc is None or (doc is None, doc or 0) == least[root[text]]]
    assert sorted((r["text"], r["doc_id"]) for r in without_repeats(frame(spark, rows), got).collect() if r["doc_id"]) == sorted((t, d) for d, t in stay if d)


def test_clashing_names_survive(spark):
    rows = [(1, "one line of some length\ntwo", "en", "a", 27), (2, "one line of some length\nthree words here", "en", "a", 40), (2, "x y", "en", "b", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"{k} as `{n}`" for k, n in enumerate(("_drops", "_doc", "_some", "_nth", "_times", "_k", "_copy", "_hash", "_gone"))))
    left = without_repeats(docs, fuzzy_lines(docs))
    assert left.columns == docs.columns and {r["_drops"] for r in left.collect()} == {0} and left.where("doc_id = 2 and text = 'three words here'").count() == 1
    mixed = mixed_rows(docs, pareto_mix(docs))
    assert mixed.columns == docs.columns and {(r["_nth"], r["_times"], r["_k"], r["_copy"]) for r in mixed.collect()} == {(3, 4, 5, 6)}


def test_fuzzy_lines_of_one_character(spark):
    rows = [(1, "-" * 12, None, None, 1), (2, "-" * 8 + "\n" + "-" * 7, None, None, 1), (3, "=" * 8, None, None, 1), (4, "-" * 8, None, None, 1)]
    got = {(r["doc_id"], r["line"]): (r["keep_doc"], r["kept"]) for r in fuzzy_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0): (1, True), (2, 0): (1, False), (2, 1): (2, True), (3, 0): (3, True), (4, 0): (1, False)}


def test_components_are_least_ids(spark):
    rng = random.Random(3)
    edges = [(a, rng.randrange(max(0, a - 40), a)) for a in range(1, 400) if a % 50] + [(5, 5), (7, 6), (7, 6)]
    root = list(range(400))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["root"] for r in linking.components(spark.createDataFrame(edges, "x long, y long"), "test").collect()}
    assert got == {k: find(k) for k in {v for e in edges for v in e if e[0] != e[1]}}
    assert linking.components(spark.createDataFrame([], "x long, y long"), "test").count() == 0


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("places", [3, 4096])
def test_suffix_dedup(spark, places):
    rng = random.Random(places)
    shared = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(300)
            parts.append(shared[at : at + rng.randint(1, 100)] if rng.random() < 0.5 else "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 60))))
        rows.append((k, "".join(parts) + ("ab" * rng.randint(0, 60) if k % 9 == 0 else ""), None, None, 1))
    rows += [(100, None, None, None, None), (101, rows[3][1], None, None, 1), (102, "ü" * 150, None, None, 1), (103, shared, None, None, 1)]
    want = brute_repeats([(r[1] or "").encode() for r in rows], 30)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame(spark, rows), 30, 8, places).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}


def test_suffix_dedup_of_odd_rows(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(60))
    rows = [(1, text, None, None, 1), (1, text, None, None, 1), (1, "other" * 3, None, None, 1), (None, "x" + text[:40], None, None, 1)]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(frame(spark, rows), 30, 8).collect())
    assert got == [(15, 0, 0), (41, 40, 1), (60, 60, 1), (60, 60, 1)]
    assert remove_repeats(frame(spark, [])).count() == 0


def test_blind_trie_sorts():
    rng = random.Random(2)
    for _ in range(200):
        values = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        trie = suffix_dedup.BlindTrie()
        for i, v in enumerate(values):
            trie.insert(v, i)
        assert [values[i] for i in trie.members()] == sorted(values)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as score", "2 as rank")


def test_search_is_exact_where_all_is_probed_and_near_it_elsewhere(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 3
    data = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    data[2000:2040] = data[0]
    rows = [(i, data[i].tolist(), 0) for i in range(3000)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (5400, [1.0], 0), (5500, [float("inf")] * 16, 0)]
    double = data.astype(float)
    found = total = 0
    got = {}
    for r in ann.search(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == set(range(0, 3000, 100))
    for q, hits in got.items():
        exact = np.sqrt(((double - double[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), exact)) if i != q][:10]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11)) and [(h[1], h[2]) for h in hits] == sorted((h[1], h[2]) for h in hits)
        assert all(h[1] == pytest.approx(exact[h[2]], abs=1e-12) for h in hits)
        found += len({h[2] for h in hits} & set(order))
        total += 10
    assert found / total >= 0.9
    small = [(i, [float(i), 1.0], 0) for i in range(0, 500, 100)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(vectors(spark, small)).collect())
    assert len(got) == 20 and got[0] == (0, 1, 100)
    assert ann.search(vectors(spark, [])).count() == 0 and ann.search(vectors(spark, [(0, [1.0], 0)])).count() == 0


@pytest.mark.parametrize("sample,parts", [(8192, 128), (20480, 512)])
def test_parts_grow_with_the_table_and_few_are_probed(sample, parts):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 16)) * 2
    x = centres[rng.integers(0, 300, 40_000)] + rng.standard_normal((40_000, 16)) * 0.4
    router = ann.fit(x[:sample], x[sample : sample + 1024], parts * ann.PART_SIZE)
    assert len(router.layers[3]) == parts
    put = router.scores(x).argmax(axis=1)
    queries = np.arange(30_000, 30_300)
    probed = np.argsort(-router.scores(x[queries]), axis=1, kind="stable")[:, : router.probes]
    assert np.bincount(put, minlength=parts)[probed].sum(axis=1).mean() < len(x) / 2
    near = ann.nearest(x[queries], x, 11)
    seen = (put[near][:, :, None] == probed[:, None, :]).any(axis=2) & (near != queries[:, None])
    assert seen.sum() / (10 * len(queries)) >= 0.9


def test_balanced_parts_cut_few_edges():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((4, 8)) * 9, 100, axis=0) + rng.standard_normal((400, 8))
    graph = ann.nearest(x, x, 5, skip_self=True)
    label = ann.balanced_parts(graph, 4)
    assert (np.bincount(label) == 100).all() and (label[graph] == label[:, None]).mean() > 0.95


def test_lists_as_of_the_fetch(spark):
    day = dt.date
    entries = [
        ("b.com", "block", day(2024, 1, 10)), ("b.com", "block", day(2024, 1, 20)), ("b.com", "lift", day(2024, 3, 1)), ("b.com", "block", day(2024, 5, 5)),
        ("a.b.com", "allow", day(2024, 2, 1)), ("a.b.com/x/", "block", day(2024, 2, 10)), ("a.b.com/x/", "lift", day(2024, 2, 10)), (None, "block", day(2024, 1, 1)), ("b.com", "block", None),
    ]
    urls = ["http://A.B.com:80/x/y?q#f", "https://u@b.com", "ftp://c.b.com./z", "http://other.org/b.com", "no url", None, "http:///x"]
    days = [day(2024, 1, 9), day(2024, 1, 10), day(2024, 2, 10), day(2024, 2, 29), day(2024, 3, 1), day(2024, 5, 5), day(2025, 1, 1), None]
    rows = [(i, u, d) for i, (u, d) in enumerate(itertools.product(urls, days))]
    rows.append(rows[0])
    captures = spark.createDataFrame(rows, "capture_id int, url string, fetched_on date").selectExpr("*", "'x' as pattern", "'y' as action")
    listed = spark.createDataFrame(entries, "pattern string, action string, day date").selectExpr("*", "1 as n")
    patterns = {0: ["a.b.com/x/", "a.b.com", "b.com"], 1: ["b.com"], 2: ["b.com"]}

    def said(pattern, on):
        days = sorted({d for p, _, d in entries if p == pattern and d and d <= on})
        action = max((a for p, a, d in entries if p == pattern and d == days[-1]), default=None) if days else None
        return None if action in (None, "lift") else action

    def verdict(i, on):
        known = patterns.get(i // len(days), []) if on else []
        return next((x for x in (said(p, on) for p in known) if x), "none"), sum(said(p, on) is not None for p in known)

    got = Counter((r["capture_id"], r["verdict"], r["n_holding"]) for r in judge(captures, listed).collect())
    assert got == Counter((i, *verdict(i, d)) for i, _, d in rows)
    assert {(r["held_from"], str(r["held_until"])) for r in intervals(listed).where("pattern = 'b.com' and action = 'block'").collect()} == {(day(2024, 1, 10), "2024-03-01"), (day(2024, 5, 5), "9999-12-31")}
    assert {r["verdict"] for r in judge(captures, listed.limit(0)).collect()} == {"none"} and judge(captures.limit(0), listed).count() == 0
    assert captures.select(host_of(captures["url"]).alias("h")).where("capture_id = 16").first()["h"] == "c.b.com"


def test_lists_reach_pages_at_any_depth(spark):
    day = dt.date(2024, 1, 1)
    deep = "/".join(str(k) for k in range(1, 31))
    entries = [("b.com", "allow", day), ("b.com/1/2/3/4/5/6/7/8/9/", "block", day), (f"b.com/{deep}/page.html/", "allow", day), (".".join("x" * 130), "block", day)]
    urls = [f"http://b.com/{deep}/page.html?q", f"http://b.com/{deep}/", "http://b.com/1/2/3/4/5/6/7/8/9", "http://b.com/1/2/3/4/5/6/7/8", f"http://{'.'.join('x' * 131)}/1"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "capture_id int, url string, fetched_on date")
    got = judge(captures, spark.createDataFrame(entries, "pattern string, action string, day date")).collect()
    assert {r["capture_id"]: (r["verdict"], r["n_holding"]) for r in got} == {0: ("allow", 3), 1: ("block", 2), 2: ("block", 2), 3: ("allow", 1), 4: ("block", 1)}


def labelled(spark, n=600):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic, poor = k % 7 == 0, k % 11 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vilest", "nastier", "meanest"])
        body = " ".join(w + "&&&" for w in text) if poor else " ".join(text)
        rows.append((k, body, rng.choice(["en", "de"]), f"s{k % 5}", len(body)))
        if k % 2:
            labels.append((k, int(not poor), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: k % 7 == 0 or k % 11 == 0 for k in range(n)}


def test_quality_on_documents_it_was_not_fitted_on(spark):
    docs, labels, bad = labelled(spark)
    got = classify(spark, docs, labels).collect()
    unseen = [r for r in got if r["doc_id"] % 2 == 0]
    assert len(got) == 600
    assert sum(not r["kept"] for r in unseen if bad[r["doc_id"]]) >= 0.9 * sum(bad[r["doc_id"]] for r in unseen)
    assert sum(r["kept"] for r in unseen if not bad[r["doc_id"]]) >= 0.98 * sum(not bad[r["doc_id"]] for r in unseen)
    # Rates are posterior means: between the group's own mean and the one above it.
    total = sum(r["evidence"] for r in got) / len(got)
    for host in {r["host"] for r in got}:
        own = [r for r in got if r["host"] == host]
        mean = sum(r["evidence"] for r in own) / len(own)
        assert min(mean, total) - 1e-9 <= own[0]["host_rate"] <= max(mean, total) + 1e-9
        for path in {r["path"] for r in own}:
            part = [r for r in own if r["path"] == path]
            inner = sum(r["evidence"] for r in part) / len(part)
            assert min(inner, own[0]["host_rate"]) - 1e-9 <= part[0]["path_rate"] <= max(inner, own[0]["host_rate"]) + 1e-9
    kept = keep_good(docs, classify(spark, docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_rates_are_those_of_plain_python(spark):
    """Host and path posteriors and the method-of-moments strengths, recomputed from the evidence of each document."""
    docs, labels, _ = labelled(spark)
    got = classify(spark, docs, labels).collect()

    def strength(groups, centres):
        n = np.array([len(g) for g in groups], float)
        total = np.array([sum(g) for g in groups])
        inside = sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups)
        between = (n * (total / n - np.array(centres)) ** 2).sum()
        size, k = n.sum(), len(groups)
        if k < 2 or size <= k or not total.sum():
            return 1e6
        spread = (between - (k - 1) * inside / (size - k)) / max(size - (n * n).sum() / size, 1e-9)
        mean = total.sum() / size
        return float(np.clip(mean * (1 - mean) / spread - 1, 1, 1e6)) if spread > 0 else 1e6

    hosts, paths = {}, {}
    for r in got:
        hosts.setdefault(r["host"], []).append(r["evidence"])
        paths.setdefault((r["host"], r["path"]), []).append(r["evidence"])
    mean = sum(r["evidence"] for r in got) / len(got)
    w = strength(list(hosts.values()), [mean] * len(hosts))
    host_rate = {h: (w * mean + sum(g)) / (w + len(g)) for h, g in hosts.items()}
    w = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    path_rate = {k: (w * host_rate[k[0]] + sum(g)) / (w + len(g)) for k, g in paths.items()}
    shifts = []
    for r in got:
        assert r["host_rate"] == pytest.approx(host_rate[r["host"]], rel=1e-6)
        assert r["path_rate"] == pytest.approx(path_rate[r["host"], r["path"]], rel=1e-6)
        assert r["kept"] == (r["posterior"] < 0.5)
        logit = lambda p: np.log(p / (1 - p))
        if 1e-9 < r["evidence"] < 1 - 1e-9 and 1e-9 < r["posterior"] < 1 - 1e-9:
            shifts.append(logit(r["posterior"]) - logit(r["evidence"]) - logit(r["path_rate"]))
    assert max(shifts) - min(shifts) < 1e-3  # the share of bad documents in training, the same for all


def test_quality_of_odd_tables(spark):
    docs, labels, _ = labelled(spark, 80)
    none = labels.limit(0)
    assert all(r["kept"] for r in classify(spark, docs, none).collect())
    rows = frame(spark, [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", None, 3), (2, "", "", "", 0)])
    assert classify(spark, rows, labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema))).count() == 4
    assert keep_good(rows, classify(spark, rows, none)).count() == 4
    assert classify(spark, spark.createDataFrame([], SCHEMA), labels).count() == 0
