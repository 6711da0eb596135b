"""Archives, prefix tries and structure repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from syllabary.llm import prefix_trie as trie
from syllabary.llm import ranges, structure_repair, warc

TALK = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, captured_at timestamp, html string"


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# ---------------------------------------------------------------- archives


def pages():
    rng = random.Random(5)
    same = "<p>" + "ä" * 200
    rows = [(k, f"http://{'b' if k % 3 else 'a.c'}.org:{rng.choice([80, 8080])}/{k % 4}?q={k % 2}#f", None, rng.choice([same, f"<p>{k}" * 40, "short"])) for k in range(60)]
    rows += [(100, None, None, None), (101, "not a url", None, ""), (102, "http://x.org/\r\nWARC/1.1\r\n", None, "x" * 300)]
    rows += [(103, "http://x.org/", None, "<WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20 + "WARC"), (104, "http://x.org", None, "WARC/1.1\r\n" * 20)]
    rows += [(None, "http://n.org/", None, same), (None, "http://n.org/", None, "only nameless" * 20), (None, "http://n.org/", None, "only nameless" * 20)]
    rows += [(7, "http://again.org/", None, "<p>7" * 40), (105, "http://long.org", None, "é\r\n\r\n" * 40_000), (106, "http://e.org", None, "z" * 99), (107, "http://e.org", None, "z" * 99)]
    rows += [(200 + k, "http://hot.org/", None, same) for k in range(40)]
    import datetime

    return [(a, b, None if a == 101 else datetime.datetime(2024, 1, 1 + (zlib.crc32(str(b).encode()) + (a or 0)) % 28), d) for a, b, _, d in rows]


def test_archives(spark, tmp_path, monkeypatch):
    rows = pages()
    groups = defaultdict(list)
    for i, _, _, html in rows:
        if len((html or "").encode()) >= 100:
            groups[html].append(i)
    captures = clashing(spark.createDataFrame(rows, PAGES).repartition(5), "digest", "size", "row", "first", "_row", "record_id")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = warc.archive(captures, str(tmp_path / "warc"), per_range=20).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    text = {}
    for i, _, _, html in rows:
        text.setdefault(hashlib.sha256((html or "").encode()).hexdigest(), html or "")
    revisits = defaultdict(int)
    for r in got:
        html = text[r.payload_digest]
        assert r.payload_bytes == len(html.encode())
        if r.record_type == "revisit":
            ids = [i for i in groups[html] if i is not None]
            assert r.refers_to == (min(ids) if ids else None)
            revisits[html] += 1
        else:
            assert r.refers_to is None
            if html in groups:
                ids = [i for i in groups[html] if i is not None]
                assert r.page_id == (min(ids) if ids else None)
    assert revisits == {h: len(ids) - 1 for h, ids in groups.items() if len(ids) > 1}
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, len(rows) + 1))
    keys = [(r.url_key, r.captured_at.isoformat() if r.captured_at else "", 2**63 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    for _, history in itertools.groupby(got, key=lambda r: r.url_key):
        assert [r.nth for r in history][0] == 1
    assert {r.url_key for r in got if r.page_id == 103} == {"org,x)/"}
    count = defaultdict(int)
    for r in got:
        count[r.url_key] += 1
        assert r.nth == count[r.url_key]
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = f.read(r.length)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r.record_id.encode() in record


def test_archives_of_nothing_and_damaged_ones(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0
    warc.write_archives(spark.createDataFrame(pages()[:3], PAGES), str(tmp_path / "one"))
    for file in (tmp_path / "one").glob("part-*"):
        whole = file.read_bytes()
        if whole:
            (tmp_path / "bad").mkdir(exist_ok=True)
            (tmp_path / "bad" / file.name).write_bytes(whole.replace(b"<p>", b"<b>").replace(b"short", b"SHORT"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, str(tmp_path / "bad")).count()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    sources = [sorted((rng.randrange(20), s) for _ in range(rng.randrange(30))) for s in range(k)]
    assert [sources[s][at] for s, at in warc.LoserTree(sources)] == sorted(x for s in sources for x in s)


# ---------------------------------------------------------------- hashes of joined pieces


def test_joined_hashes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(b"hot" if rng.random() < 0.5 else b"%d" % rng.randrange(30), k, b"x" * rng.randrange(9)) for k in range(2000)]
    want = defaultdict(list)
    for g, _, piece in rows:
        want[g].append(piece)
    for chunk in (16, 1 << 20):
        monkeypatch.setattr(ranges, "CHUNK", chunk)
        df = spark.createDataFrame(rows, "g binary, o long, p binary").repartition(7)
        got = {bytes(r.group): r.sha for r in ranges.joined_sha256(df, "g", ["o"], "p", "\n", "t").collect()}
        assert got == {g: hashlib.sha256(b"\n".join(p)).hexdigest() for g, p in want.items()}


# ---------------------------------------------------------------- trie


def talks(n=40, seed=3):
    rng = random.Random(seed)
    lines = ["", "a", "bb", "ccc", "dddd é"]
    rows = []
    for c in range(n):
        if c % 11 == 10:
            continue
        length = rng.choice([0, 1, 2, 3, 12, 30]) if c != 17 else 90
        for t in range(length):
            rows.append((c, t * 2 if c % 2 else t, rng.choice(["user", "assistant", None]), rng.choice(lines) if rng.random() < 0.8 else None))
    for c in range(100, 130):  # copies of one long conversation
        rows += [(c, t, "user", "same") for t in range(20)]
    rows += [(200, None, "system", "first"), (200, 0, "user", "then"), (None, 1, "user", "no one's"), (205, 1, "user", "x"), (205, 1, "user", "x")]
    return rows


def trie_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        saved = (len(members[node]) - 1) * size + sum(sums[b][1] for b in below[node])
        sums[node] = (sum(sums[b][0] for b in below[node]) or 1, saved)
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.add((convs[0], len(node), parent, len(convs), len(below[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize("limit,heads", [(1 << 16, 1 << 18), (40, 1 << 18), (7, 64), (1, 4)])
def test_prefix_trie(spark, monkeypatch, limit, heads):
    if heads < 1 << 18:
        original = trie.burst
        monkeypatch.setattr(trie, "burst", lambda a, b, c: original(a, b, c, heads=heads * 300))
    rows = talks()
    df = clashing(spark.createDataFrame(rows, TALK).repartition(3), "id", "pos", "node", "bytes", "length", "least")
    got = [tuple(r) for r in trie.prefix_trie(df, limit=limit).collect()]
    want, n = trie_of(rows)
    assert len(got) == n and set(got) == want


def test_prefix_trie_of_little(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TALK)).count() == 0
    empty = hashlib.sha256(b"1").hexdigest()
    one = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(1, 0, "user", "x")], TALK)).collect()]
    assert (one == [(1, 0, None, 1, 0, 1, 0, empty)]) == (zlib.crc32(b"1") % 9 > 0)


# ---------------------------------------------------------------- repair


def cheapest(rows):
    """(cost, audit) of rows as (initial, must go, truncated), least over all edits by plain search with whole strings."""

    def due(q):
        return ("a", 3) if q == 2 else ("u", 2)

    def then(q, i):
        return {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((i, q))

    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for initial, gone, cut in reversed(rows):
        base = {}
        for q in range(4):
            choices = [(4 + best[q][0], "D" + best[q][1])]
            if not gone:
                if then(q, initial) is not None:
                    choices.append((3 * cut + best[then(q, initial)][0], "K" + best[then(q, initial)][1]))
                choices.append((3 + 3 * cut + best[due(q)[1]][0], "R" + best[due(q)[1]][1]))
            base[q] = min(choices)
        for _ in range(4):
            base = {q: min(base[q], (3 + base[due(q)[1]][0], "I" + base[due(q)[1]][1])) for q in base}
        best = base
    return best[0]


def repaired(rows):
    """What repair_damaged should give for rows (conv_id, turn, role, text)."""
    out, convs = {}, defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs[c]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        said = hashlib.sha256(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).digest()[:16]
        convs[c] += [((t is not None, t or 0), said, t, role, text)] * (2 if fault == 3 else 1)
    for c, found in convs.items():
        found.sort(key=lambda r: r[:2])
        seen, kinds, counts = set(), [], defaultdict(int)
        for *_, role, text in found:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[2] for r in found} - {None}
        cost, audit = cheapest(kinds)
        q, k, lines = 0, 0, []
        for op in audit:
            due = "assistant" if q == 2 else "user"
            if op == "I":
                lines.append(due + ":")
            else:
                role, text = found[k][3:]
                k += 1
                if op == "D":
                    continue
                due = due if op == "R" else role
                lines.append(f"{due}:{text}")
            q = {"s": 1, "u": 2, "a": 3}[due[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def broken_talks(n=120, seed=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "So!\n", " ", "", "Ä", None, "One. Two", "Well.", "Hm.", "Ok."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]
    rows = []
    for c in [None, *range(n)]:
        length = 400 if c == 3 else rng.choice([0, 1, 2, 3, 5, 8, 13])
        for t in range(length):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((c, None if rng.random() < 0.03 else t + rng.choice([0, 0, 0, 5]), role, f"{t} {rng.choice(texts)}" if rng.random() < 0.5 else rng.choice(texts)))
    rows += [(500, 0, "user", "Again.")] * 30 + [(500, 1, "assistant", "x" * 20_000 + ".")] + [(501, 1, "user", "Hi.")]
    return rows


@pytest.mark.parametrize("chunk", [4096, 5, 1])
def test_repair(spark, chunk):
    rows = broken_talks()
    df = clashing(spark.createDataFrame(rows, TALK).repartition(3), "conv", "row", "said", "at", "times", "items", "last", "fault")
    got = structure_repair.repair_damaged(spark, df, chunk=chunk).collect()
    want = repaired(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_block_tables():
    tables, rng = structure_repair.BlockTables(), random.Random(1)
    assert len(tables.vectors) < 200
    for _ in range(400):
        symbols = "".join(rng.choice(structure_repair.SYMBOLS) for _ in range(rng.randrange(30)))
        edits, state = tables.trace(tables.codes(symbols), tables.end, 0)
        audit = "".join(edits) + tables.finish(state)
        assert audit == cheapest([("?" if s in "xoO" else s.lower(), s == "x", s.isupper()) for s in symbols])[1]


def test_repair_of_nothing(spark):
    assert structure_repair.repair_damaged(spark, spark.createDataFrame([], TALK)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (row,) = structure_repair.repair_damaged(spark, spark.createDataFrame([(9, gone, "user", "x")], TALK)).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
