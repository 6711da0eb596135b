"""Removal of repeated byte strings by suffix sorting: multikey quicksort to a shallow depth, then blind tries.

Every string of ``length`` bytes is looked after by the least of the hashes of its ``gram``-byte substrings, its anchor:
equal strings have equal anchors at equal places, and neighbouring strings mostly share one, so there are few. Anchors that
occur once can't lie in a repeated string. Around each of the others the bytes of its strings are cut out, and the
suffixes from the anchor on, and the reversed prefixes before it, are sorted among all places with this anchor. Two strings
are equal if the common prefixes on both sides, taken from the two sorted orders, reach their ends. No byte is compared by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .linking import slices
from .shingles import Segments, mixed

LENGTH, GRAM = 200, 48
#: Depth in bytes at which the multikey quicksort hands over to blind tries.
SHALLOW = 64
#: Places of one anchor that are sorted in one piece; more are dealt to several, and their strings then met by digest.
PLACES = 4_096
SLICE = 1_000_000
#: Anchors per byte above which a text is taken to repeat itself, and is searched for strings that recur inside it.
DENSE = 1 / 16


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _inside(text: np.ndarray, segments: Segments, begin: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of one text: which are the first of their kind, and which recur."""
    n = len(text) - length + 1
    start = np.arange(begin, begin + n)
    _, first, kind = np.unique(segments.hashes(start, start + length), return_index=True, return_inverse=True)
    leader = first[kind]
    rows = np.lib.stride_tricks.sliding_window_view(text, length)
    later = np.flatnonzero(leader != np.arange(n))
    same = np.concatenate([(rows[later[i : i + 4096]] == rows[leader[later[i : i + 4096]]]).all(axis=1) for i in range(0, len(later), 4096)] or [np.zeros(0, bool)])
    later = later[same]
    recurs = np.zeros(n, bool)
    recurs[later] = recurs[leader[later]] = True
    fresh = np.ones(n, bool)
    fresh[later] = False
    return fresh, recurs


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[dict[str, np.ndarray], list[tuple[int, int, int]]]:
    """Anchors of each text: text number, place of the anchor, first and last start of its strings, hash of its gram; and
    (text, from, to) of bytes that recur inside a text, of whose strings only the first of each kind has an anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    out = {k: np.zeros(0, np.int64) for k in ("text", "at", "low", "high")} | {"hash": np.zeros(0, np.uint64)}
    span = length - gram + 1
    if len(joined) < length:
        return out, []
    segments = Segments(joined)
    start = np.arange(len(joined) - gram + 1)
    hashes = segments.hashes(start, start + gram)
    bits = np.uint64(32)  # half a hash and the place: of grams that agree in it, the first
    packed = ((hashes >> bits) << bits) | start.astype(np.uint64)
    rows = -(-len(packed) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    blocks = padded.reshape(rows, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    least = (np.minimum(after[start], before[start + span - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    local = []
    keep = np.ones(len(start), bool)
    per_text = np.bincount(text[fresh], minlength=len(texts))
    for k in np.flatnonzero(per_text > sizes * DENSE + 8):
        at = int((np.cumsum(counts) - counts)[k])
        first, recurs = _inside(joined[begins[k] : begins[k] + sizes[k]], segments, int(begins[k]), length)
        keep[at : at + counts[k]] = first
        local += [(int(k), int(a), int(b) + length) for a, b in zip(*_spans(recurs), strict=True)]
    fresh[1:] |= keep[1:] != keep[:-1]
    head = np.flatnonzero(fresh & keep)
    heads = np.flatnonzero(fresh)
    tail = np.concatenate((heads[1:], [len(start)]))[np.searchsorted(heads, head)] - 1
    own = text[head]
    out = {"text": own, "at": least[head] - begins[own], "low": start[head] - begins[own], "high": start[tail] - begins[own], "hash": hashes[least[head]]}
    return out, local


def multikey_order(rows: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows inside their groups by multikey quicksort, eight bytes a key, down to ``depth``; and for
    each place of the order the number of its group of rows that agree so far. Only groups still tied are looked at again."""
    order = np.argsort(group, kind="stable")
    tie = np.cumsum(np.concatenate(([0], group[order][1:] != group[order][:-1])))
    for at in range(0, min(depth, rows.shape[1]), 8):
        sizes = np.bincount(tie)
        open_ = np.flatnonzero(sizes[tie] > 1)
        if not len(open_):
            break
        keys = np.ascontiguousarray(rows[order[open_], at : at + 8]).view(">u8").ravel().astype(np.uint64)
        inner = np.lexsort((keys, tie[open_]))
        order[open_] = order[open_[inner]]
        keys, ties = keys[inner], tie[open_]
        split = np.zeros(len(tie), bool)
        split[open_[1:]] = (keys[1:] != keys[:-1]) & (ties[1:] == ties[:-1])
        first = np.concatenate(([True], tie[1:] != tie[:-1]))
        tie = np.cumsum(first | split) - 1
    return order, tie


class BlindTrie:
    """Sorted order of byte strings that share a long prefix: inserted by branching bytes alone, checked by one comparison."""

    def __init__(self) -> None:
        self.root: list | None = None  # a node is [depth, {byte: node}], a leaf [string, members]

    def insert(self, value: bytes, member: int) -> None:
        if self.root is None:
            self.root = [value, [member]]
            return
        node, path = self.root, []
        while isinstance(node[0], int):
            path.append(node)
            byte = value[node[0]] if node[0] < len(value) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = node[0]
        if other == value:
            node[1].append(member)
            return
        short = min(len(value), len(other))
        differ = int.from_bytes(value[:short], "big") ^ int.from_bytes(other[:short], "big")
        same = (8 * short - differ.bit_length()) // 8
        byte = value[same] if same < len(value) else -1
        leaf = [value, [member]]
        while path and path[-1][0] > same:
            path.pop()
        if path and path[-1][0] == same:
            path[-1][1][byte] = leaf
            return
        if path:
            up = path[-1]
            key = value[up[0]] if up[0] < len(value) else -1
            below = up[1][key]
        else:
            below = self.root
        fork = [same, {other[same] if same < len(other) else -1: below, byte: leaf}]
        if path:
            up[1][key] = fork
        else:
            self.root = fork

    def members(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[0], int):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def suffix_order(values: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order of ``values`` inside their groups, and the common prefix of each place with the one before it
    (-1 where a group begins)."""
    rows = np.zeros((len(values), -(-width // 8) * 8), np.uint8)
    sizes = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(values), np.uint8)
    rows[np.repeat(np.arange(len(values)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    order, tie = multikey_order(rows, group, SHALLOW)
    heads = np.flatnonzero(np.concatenate(([True], tie[1:] != tie[:-1])))
    ends = np.concatenate((heads[1:], [len(order)]))
    for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
        trie = BlindTrie()
        for member in order[a:b].tolist():
            trie.insert(values[member], member)
        order[a:b] = trie.members()
    common = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 65_536):
        b = min(a + 65_536, len(order))
        x, y = order[a:b], order[a - 1 : b - 1]
        differ = rows[x] != rows[y]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common[a:b] = np.where(group[x] == group[y], np.minimum(found, np.minimum(sizes[x], sizes[y])), -1)
    return order, common


def repeated_strings(
    group: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, pieces: list[bytes], length: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, leads) by place and distance of the string's start before the anchor: which strings occur at another
    place of their group, and one of each kind. ``pieces`` are the bytes from the first start to the last string's end."""
    n, span = len(pieces), length - gram + 1
    ahead = at - low
    right = [p[k:] for p, k in zip(pieces, ahead.tolist(), strict=True)]
    left = [p[:k][::-1] for p, k in zip(pieces, ahead.tolist(), strict=True)]
    orders = []
    for values, width in ((right, length), (left, span)):
        order, common = suffix_order(values, group, width)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        orders.append((rank, common))
    (rank_r, common_r), (rank_l, common_l) = orders
    repeats, leads = np.zeros((n, span), bool), np.zeros((n, span), bool)
    for back in range(span):
        here = np.flatnonzero((ahead >= back) & (at - high <= back))
        if not len(here):
            continue
        kind_r = np.cumsum(common_r < length - back)[rank_r[here]]
        kind_l = np.cumsum(common_l < back)[rank_l[here]]
        kinds, first, inverse, count = np.unique(kind_r * (n + 1) + kind_l, return_index=True, return_inverse=True, return_counts=True)
        repeats[here, back] = count[inverse] > 1
        leads[here[first], back] = True
    return repeats, leads


def _places(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(1).to_pylist()]
        for a, b in slices(np.array([len(t) for t in texts], np.int64), SLICE):
            found, local = anchors(texts[a:b], length, gram)
            # A text that recurs in itself has its first anchor twice, so that it is looked at in any case.
            first = np.searchsorted(found["text"], sorted({k for k, _, _ in local}))
            pick = np.concatenate((np.arange(len(found["text"])), first))
            yield pa.record_batch(
                [pa.array(found["hash"].view(np.int64)[pick]), pa.array(ids[a:b][found["text"][pick]]), pa.array(found["at"][pick])],
                names=["hash", "id", "at"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those whose hash has a neighbour, and the first and last hash of the partition, which may
    go on in another one."""
    held: pa.RecordBatch | None = None
    started = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        hashes = batch.column(0).to_numpy()
        cut = int(np.searchsorted(hashes, hashes[-1]))
        if cut == 0 and len(hashes) > 4:
            cut = len(hashes) - 2  # one long run: two rows are enough to go on with
        head = hashes[: cut + 1]
        keep = np.zeros(cut, bool)
        if cut:
            equal = head[1:] == head[:-1]
            keep = equal[:cut].copy()
            keep[1:] |= equal[: cut - 1]
            if not started or held is not None:
                keep |= hashes[:cut] == hashes[0]
            yield batch.slice(0, cut).filter(pa.array(keep))
            started = True
        held = batch.slice(cut)
    if held is not None:
        yield held


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Pieces around the wanted anchors of each text, or (hash null) bytes that recur inside it."""
    names = ["hash", "part", "parts", "id", "at", "low", "high", "piece"]
    for batch in batches:
        ids, wanted = batch.column(0).to_numpy(), batch.column(2)
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for a, b in slices(np.array([len(t) for t in texts], np.int64), SLICE):
            found, local = anchors(texts[a:b], length, gram)
            lists = wanted.slice(a, b - a)
            flat = lists.flatten()
            asked = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy()) << 40 | flat.field("at").to_numpy()
            order = np.argsort(asked)
            asked, parts = asked[order], flat.field("parts").to_numpy()[order]
            have = found["text"] << 40 | found["at"]
            place = np.minimum(np.searchsorted(asked, have), len(asked) - 1)
            pick = np.flatnonzero(asked[place] == have)
            text, at, low, high, hashes = (found[k][pick] for k in ("text", "at", "low", "high", "hash"))
            parts = parts[place[pick]].astype(np.int64)
            own = ids[a:b][text]
            part = (mixed(own.view(np.uint64) * np.uint64(31) + at.view(np.uint64)) % parts.view(np.uint64)).astype(np.int64)
            pieces = [texts[a + t][x : y + length] for t, x, y in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)]
            yield pa.record_batch([*map(pa.array, (hashes.view(np.int64), part, parts, own, at, low, high)), pa.array(pieces, pa.binary())], names=names)
            if local:
                k, x, y = (np.array(v, np.int64) for v in zip(*local, strict=True))
                none, zero = pa.nulls(len(k), pa.int64()), pa.array(np.zeros(len(k), np.int64))
                own = ids[a:b][k]
                spread = pa.array((mixed(own.view(np.uint64)) % np.uint64(1024)).astype(np.int64))
                yield pa.record_batch([none, spread, zero, pa.array(own), zero, pa.array(x), pa.array(y), pa.nulls(len(k), pa.binary())], names=names)


def _sorted_places(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, low, high, digest, single): bytes of a text that recur; for places dealt to several parts, digests of strings."""
    schema = pa.schema([("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("digest", pa.binary()), ("single", pa.bool_())])

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        hashes, part, parts, ids, at, low, high = (table.column(k).to_numpy() for k in range(7))
        pieces = table.column(7).to_pylist()
        group = np.cumsum(np.concatenate(([0], (hashes[1:] != hashes[:-1]) | (part[1:] != part[:-1]))))
        repeats, leads = repeated_strings(group, at, low, high, pieces, length, gram)
        # By start of the string, rising: the flag of a place is a row of its own, apart from the next by a false.
        flat = np.zeros((len(pieces), repeats.shape[1] + 1), bool)
        flat[:, :-1] = repeats[:, ::-1]
        first, last = _spans(flat.ravel())
        row, width = first // flat.shape[1], flat.shape[1]
        start = at[row] - (repeats.shape[1] - 1) + first % width
        n = len(first)
        if n:
            yield pa.record_batch([pa.array(ids[row]), pa.array(start), pa.array(start + (last - first) + length), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], schema=schema)
        dealt = np.flatnonzero(parts > 1)
        if len(dealt):
            row, back = np.nonzero(leads[dealt])
            row = dealt[row]
            begin = at[row] - back
            strings = [pieces[r][s : s + length] for r, s in zip(row.tolist(), (begin - low[row]).tolist(), strict=True)]
            digests = [hashlib.sha256(s).digest() for s in strings]
            yield pa.record_batch([pa.array(ids[row]), pa.array(begin), pa.array(begin + length), pa.array(digests, pa.binary()), pa.array(~repeats[row, back])], schema=schema)

    held: pa.Table | None = None
    for batch in batches:
        local = batch.filter(batch.column(0).is_null())
        if local.num_rows:
            yield pa.record_batch([local.column(3), local.column(5), local.column(6), pa.nulls(local.num_rows, pa.binary()), pa.nulls(local.num_rows, pa.bool_())], schema=schema)
            batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < 4 * PLACES:
            continue
        hashes, part = (held.column(k).to_numpy() for k in (0, 1))
        cut = int(np.flatnonzero((hashes == hashes[-1]) & (part == part[-1]))[0])
        if cut:
            yield from solve(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from solve(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, removed, runs, at = hashlib.sha256(), 0, 0, 0
            end = -1
            for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
                if low > end:
                    runs += 1
                    kept.update(raw[at:low])
                    removed += high - low
                    end = at = high
                elif high > end:
                    removed += high - end
                    end = at = high
            kept.update(raw[at:])
            rows.append((removed, runs, kept.hexdigest()))
        yield pa.record_batch([ids, *(pa.array([r[k] for r in rows]) for k in range(3))], names=["id", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, places: int = PLACES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document or another, is
    removed; strings are judged on the input. n_spans is the number of maximal removed runs, and kept_sha256 is of the
    bytes that remain, joined. Equal texts are collapsed first: one that occurs twice is removed whole (if it has
    ``length`` bytes) and stands once in the search, so copies don't make an anchor hot. Places of one anchor beyond ``places``
    are dealt to several parts, and strings that are alone in theirs are met across parts by digest.

    A null text is empty. Repeated rows, also of one doc_id, are documents of their own and so copies of each other; a
    null doc_id is carried along. Other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim_columns = (F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("key"))
    ids = source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        source = source.withColumn("id", F.col("doc_id"))
    else:  # doc_id doesn't tell rows apart
        source = stored(source.withColumn("id", F.monotonically_increasing_id()), "numbered")
    slim = stored(source.select("id", "doc_id", *slim_columns), "digests")
    texts = stored(slim.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "texts")
    found = source.select("id", "text").mapInArrow(lambda b: _places(b, length, gram), "hash long, id long, at long")
    shared = found.repartitionByRange("hash", "id", "at").sortWithinPartitions("hash", "id", "at").mapInArrow(_shared, "hash long, id long, at long")
    shared = stored(shared, "shared-anchors").join(texts.select("id"), "id", "left_semi")
    counts = shared.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stored(shared.join(counts, "hash").select("hash", "id", "at", F.ceil(F.col("n") / places).cast("int").alias("parts")), "anchors")
    wanted = held.groupBy("id").agg(F.collect_set(F.struct("at", "parts")).alias("wanted"))
    touched = stored(source.select("id", "text").join(wanted, "id"), "touched")
    pieces = touched.mapInArrow(
        lambda b: _cut(b, length, gram), "hash long, part long, parts long, id long, at long, low long, high long, piece binary"
    )
    dealt = pieces.repartition("hash", "part").sortWithinPartitions("hash", "part")
    solved = stored(
        dealt.mapInArrow(lambda b: _sorted_places(b, length, gram), "id long, low long, high long, digest binary, single boolean"), "runs"
    )
    across = solved.where("digest is not null")
    twice = across.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = across.where("single").join(twice, "digest").select("id", "low", "high")
    runs = solved.where("digest is null").select("id", "low", "high").unionByName(met)
    spans = runs.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kept = touched.select("id", "text").join(spans, "id").mapInArrow(_kept, "id long, n_removed long, n_spans long, kept_sha256 string")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole = slim.join(texts.select("key", "copies"), "key").join(kept, "id", "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
