"""Best-fit packing planned on the histogram of lengths; pieces take planned slots by their rank within their length."""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, stored
from .linking import slices

#: Encoded words in each of the two generations that a Python worker remembers (about 300 bytes a word).
REMEMBERED = 200_000
#: Characters of text that are Python strings at once.
SLICE = 1_000_000
#: Words that are encoded in one call.
TOGETHER = 2_000


def _merger(spec: dict) -> tuple[object | None, list[str]]:
    """The merges of a tokenizer file for a faster merging library, and the strings that only the tokenizer itself reads.
    Without that library the tokenizer reads everything.

    A plain byte-level BPE, whose ids are in the order of its merges, has the same ids there; any other file has none.
    """
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, [x["content"] for x in spec["added_tokens"]]
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
    if find_spec("tiktoken") is None or find_spec("tiktoken_ext") is None:
        return None, added
    import tiktoken
    from tiktoken_ext.openai_public import r50k_pat_str

    if not plain or spec["normalizer"] or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return None, added
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if len(ranks) != 256 + len(merges) or any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
        return None, added
    return tiktoken.Encoding("merges", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={}), added


class Encoder:
    """Token ids as little-endian 32-bit bytes, encoding each distinct word once.

    The pre-tokenizer of the vocabulary never crosses a single blank between two characters that aren't white space (the
    blank goes with what follows it), so a text cut there gives the ids of the whole text. Nor does it cross a line feed
    between two such words, so many words are encoded in one call, and the line feed's id tells them apart.
    In the keys, a word without a mark follows a blank, one marked by a line feed follows a line feed, and one marked by
    two is the first of its text.
    Words are kept in two generations: a full one becomes the older, and words of the older that come again move on, so
    frequent words stay whatever the number of rare ones.
    """

    LINES = re.compile(r"(?<=\S)\n(?=\S)")
    APART = re.compile(r"(?<=\S) (?=\S)")
    PLAIN = re.compile(r"\S+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merger, self.added = _merger(json.loads(self.tokenizer.to_str()))
        self.line_feed = self.ids("\n")
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.odd: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.merger and not any(x in text for x in self.added):
            return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def read(key: str) -> tuple[int, str]:
        """The length of a key's mark, and the text that it stands for (without a line feed before it)."""
        mark = 2 if key[:2] == "\n\n" else 1 if key[:1] == "\n" else 0
        return mark, key[mark:] if mark else " " + key

    def learn(self, parts: set[str]) -> None:
        """Encodes words; a part that holds white space isn't one, and stays without ids."""
        words = []
        for part in parts:
            if part in self.older:
                self.known[part] = self.older[part]
                continue
            mark, word = self.read(part)
            if self.PLAIN.fullmatch(part, mark):
                words.append((part, word, self.line_feed if mark == 1 else b""))
            else:
                self.known[part] = None
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            found = self.ids("\n".join(w for _, w, _ in some))
            cuts = 4 * np.flatnonzero(np.frombuffer(found, "<u4") == np.frombuffer(self.line_feed, "<u4")[0])
            if len(self.line_feed) != 4 or len(cuts) != len(some) - 1:  # another kind of vocabulary
                self.known.update((part, ahead + self.ids(word)) for part, word, ahead in some)
                continue
            for (part, _, ahead), a, b in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(found)], strict=True):
                self.known[part] = ahead + found[a:b]

    def part(self, part: str) -> bytes:
        found = self.known.get(part) or self.odd.get(part)
        if found is None:
            mark, word = self.read(part)
            found = self.odd[part] = (self.line_feed if mark == 1 else b"") + self.ids(word)
        return found

    def spaced(self, text: str) -> bytes:
        """A text with more white space than single blanks and line feeds between words."""
        parts = []
        for i, line in enumerate(self.LINES.split(text)):
            first, *rest = self.APART.split(line)
            parts += [("\n" if i else "\n\n") + first, *rest]
        return b"".join(map(self.part, parts))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [("\n\n" + t.replace("\n", " \n")).split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        if len(self.odd) > REMEMBERED // 10:
            self.odd.clear()
        self.learn(set().union(*split).difference(self.known))
        for text, parts in zip(texts, split, strict=True):
            try:
                yield b"".join(map(self.known.__getitem__, parts))
            except TypeError:
                yield self.spaced(text)


def _encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which outlives a task. This module comes with each task anew, so it is kept aside."""
    kept = sys.modules.setdefault("_syllabary_worker", types.ModuleType("_syllabary_worker")).__dict__
    if ("encoder", path) not in kept:
        kept["encoder", path] = Encoder(path)
    return kept["encoder", path]


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids = batch.column(0)
            for at, to in slices(np.array([len(t.as_py() or "") for t in batch.column(1)], np.int64), SLICE):
                rows: list[tuple[int, int, int, int, int]] = []
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                for k, tokens in enumerate(encoder.encode(texts), at):
                    data = memoryview(tokens + end)
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    starts = [0, *range(first, n, capacity)]
                    for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((k, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                row, piece, start, length, crc = np.array(rows, np.int64).T
                yield pa.record_batch(
                    [ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, offset) for runs of equal slots.

    Pieces of one length with ranks from first to end go to consecutive sequences from the first one, at one offset.
    Open sequences are kept as runs of numbers by the space they have left, and the longest lengths come first, each to
    the least space that takes it; the work depends on the capacity and not on the number of pieces.
    """
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, opened = [], 0

    def place(length: int, rank: int, begin: int, n: int, left: int) -> None:
        slots.append((length, rank, rank + n, begin, capacity - left))
        if left > length:
            space[left - length].append((begin, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            fit = min((s for s, runs in space.items() if s >= length and runs), default=None)
            if fit is None:
                # New sequences take as many of this length as go in, like one piece after the other would.
                layers = capacity // length
                full, rest = divmod(end - rank, layers)
                for n, depth in ((full, layers), (1, rest)):
                    if n and depth:
                        for layer in range(depth):
                            slots.append((length, rank, rank + n, opened, layer * length))
                            rank += n
                        if capacity > depth * length:
                            space[capacity - depth * length].append((opened, n))
                        opened += n
                continue
            begin, n = space[fit].pop()
            take = min(n, end - rank)
            if take < n:
                space[fit].append((begin + take, n - take))
            place(length, rank, begin, take, fit)
            rank += take
    return slots


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text by the tokenizer file ``path`` (null text: empty) and ``end_id``. Longer ones
    are cut into pieces of ``capacity`` ids, the first piece taking what is left over. The plan needs the number of
    pieces per length only (at most ``capacity`` rows on the driver); pieces get ranks within their length by (doc_id,
    piece, start, crc), and a rank names a slot. Rows that repeat are packed as often as they are there; a null doc_id
    is carried along; other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = stored(
        source.mapInArrow(_cut(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"),
        "pieces",
    )
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = stored(running(pieces, order, {"rank": F.lit(1)}, within=["length"], name="ranges"), "ranked")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most one run per pair of length and space that was left, so the table is bounded by the capacity alone.
    slots = docs.sparkSession.createDataFrame(
        plan(counts, capacity), "slot_length long, first long, end long, sequence long, offset long"
    )
    rank = F.col("rank") - 1
    fits = (F.col("length") == F.col("slot_length")) & (rank >= F.col("first")) & (rank < F.col("end"))
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + rank - F.col("first")).alias("sequence_id"), "offset"
    )
