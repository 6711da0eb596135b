"""Conversation structure repair by block tables: cost vectors pass whole blocks of turns by lookup, then blocks are traced."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, stored
from .ranges import joined_sha256

#: What a row can be for the repair: it has to go, or it begins with s, u, a or something else; in capitals if truncated.
SYMBOLS = "xsuaoSUAO"
#: States of the target language (s?(ua)+)?: nothing yet, behind s, behind u, behind a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns in a block, and rows that are repaired in one piece.
BLOCK, CHUNK = 4, 4096
BLANKS = " \t\n\x0b\x0c\r"
INFINITE = 1 << 20


def _then(state: int, initial: str) -> int | None:
    """The state behind a turn of this initial; None where the language has none."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _due(state: int) -> tuple[str, int]:
    """The only turn of user or assistant that may come next, and the state behind it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def _inserting(costs: list[int]) -> tuple[int, ...]:
    """Costs to finish where turns may be inserted first."""
    for _ in range(4):
        costs = [min(c, INSERT + costs[_due(q)[1]]) for q, c in enumerate(costs)]
    return tuple(costs)


class BlockTables:
    """Costs to finish a conversation from each state, less the least of them, are one of a few vectors. For each vector
    behind a turn, or behind a block of ``block`` turns, a table gives the vector before it and what the least cost rises by."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _inserting([0, INFINITE, INFINITE, 0])
        self.end = 0
        self.vectors, known, todo = [end], {end: 0}, [0]
        steps: dict[int, list[tuple[int, int]]] = {}
        while todo:
            v = todo.pop()
            steps[v] = []
            for symbol in SYMBOLS:
                before = self._before(self.vectors[v], symbol)
                low = min(before)
                vector = tuple(c - low for c in before)
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                    todo.append(known[vector])
                steps[v].append((known[vector], low))
        table = np.array([steps[v] for v in range(len(self.vectors))], np.int64)
        self.step, self.rise = table[:, :, 0], table[:, :, 1]
        self.blocks, self.rises = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(block):  # one more turn in front: its symbol is the highest digit of the block's number
            longer, more = self.step[self.blocks], self.rise[self.blocks] + self.rises[:, :, None]
            self.blocks = longer.transpose(0, 2, 1).reshape(len(self.vectors), -1)
            self.rises = more.transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self._moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self._traces: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    @staticmethod
    def _edits(after: tuple[int, ...], symbol: str, state: int) -> list[tuple[str, int, int]]:
        """(initial, cost to finish, state behind it) of each edit of a row but insertion before it."""
        edits = [("D", DELETE + after[state], state)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept, (_, due) = _then(state, symbol.lower()), _due(state)
            if kept is not None:
                edits.append(("K", KEEP + extra + after[kept], kept))
            edits.append(("R", REROLE + extra + after[due], due))
        return edits

    @classmethod
    def _before(cls, after: tuple[int, ...], symbol: str) -> tuple[int, ...]:
        return _inserting([min(cost for _, cost, _ in cls._edits(after, symbol, q)) for q in range(4)])

    def codes(self, symbols: str) -> np.ndarray:
        return np.array([SYMBOLS.index(c) for c in symbols], np.int64)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the whole blocks; the turns that are left over stand before the first one."""
        grouped = codes[len(codes) % self.block :].reshape(-1, self.block)
        return grouped @ (len(SYMBOLS) ** np.arange(self.block - 1, -1, -1))

    def back(self, codes: np.ndarray, right: np.ndarray | int) -> tuple[list, np.ndarray | int]:
        """Vectors at the block bounds from left to right, the last being ``right``, and the vector before the first turn.
        Given several vectors, all of them pass at once."""
        bounds, vector = [right], right
        for number in self.numbers(codes)[::-1]:
            vector = self.blocks[vector, number]
            bounds.append(vector)
        for code in codes[: len(codes) % self.block][::-1]:
            vector = self.step[vector, code]
        return bounds[::-1], vector

    def move(self, after: int, code: int, state: int) -> tuple[str, int]:
        """Initials of the edits up to this row, and the state behind it: of the cheapest the ASCII-least.

        What an edit can be decides the state behind it, so the least initial that keeps the cost is always right."""
        key = (after, code, state)
        if key not in self._moves:
            costs, symbol = self._before(self.vectors[after], SYMBOLS[code]), SYMBOLS[code]
            edits, q = "", state
            while True:
                choices = self._edits(self.vectors[after], symbol, q)
                choices.append(("I", INSERT + costs[_due(q)[1]], _due(q)[1]))
                initial, _, behind = min(c for c in choices if c[1] == costs[q])
                edits, q = edits + initial, behind
                if initial != "I":
                    break
            self._moves[key] = edits, q
        return self._moves[key]

    def expand(self, codes: np.ndarray, right: int, state: int) -> tuple[list[str], int]:
        """Edits of each of a few rows and the state behind them: vectors are worked out backward from ``right``."""
        vectors = [right]
        for code in codes[::-1]:
            vectors.append(self.step[vectors[-1], code])
        edits = []
        for code, after in zip(codes, vectors[-2::-1], strict=True):
            done, state = self.move(int(after), int(code), state)
            edits.append(done)
        return edits, state

    def trace(self, codes: np.ndarray, right: int, state: int) -> tuple[list[str], int]:
        """Edits of each row of a chunk that ``state`` comes before and the vector ``right`` behind, and the state behind it."""
        bounds, _ = self.back(codes, right)
        loose = len(codes) % self.block
        edits, state = self.expand(codes[:loose], int(bounds[0]), state)
        for k, number in enumerate(self.numbers(codes).tolist()):
            key = (int(bounds[k + 1]), number, state)
            if key not in self._traces:
                at = loose + k * self.block
                some, behind = self.expand(codes[at : at + self.block], key[0], state)
                self._traces[key] = tuple(some), behind
            some, state = self._traces[key]
            edits.extend(some)
        return edits, state

    def finish(self, state: int) -> str:
        """Insertions behind the last row."""
        return "I" * (self.vectors[self.end][state] // INSERT)


ITEM = "at long, symbol string, initial string, times long, row binary"


def _symbols(items: list[dict]) -> str:
    return "".join(i["symbol"] + "x" * (i["times"] - 1) for i in items)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the vector before it by the vector behind it."""
    tables = BlockTables()
    every = np.arange(len(tables.vectors))
    for batch in batches:
        found = [tables.back(tables.codes(_symbols(i)), every)[1].tolist() for i in batch.column("items").to_pylist()]
        yield pa.record_batch([batch.column("conv"), batch.column("chunk"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "chunk", "becomes"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the state behind it by the state before it."""
    tables = BlockTables()
    for batch in batches:
        found = []
        for items, right in zip(batch.column("items").to_pylist(), batch.column("state").to_pylist(), strict=True):
            codes = tables.codes(_symbols(items))
            found.append([tables.trace(codes, right, q)[1] for q in range(4)])
        yield pa.record_batch([batch.column("conv"), batch.column("chunk"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "chunk", "becomes"])


def _scan(start: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over (conv, chunk, becomes) sorted by conv and the order of the scan: the state that each chunk is met with, and
    whether it is the first one of its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, start
        for batch in batches:
            states, firsts = [], []
            for own, becomes in zip(batch.column("conv").to_pylist(), batch.column("becomes").to_pylist(), strict=True):
                firsts.append(own != conv)
                if own != conv:
                    conv, state = own, start
                states.append(state)
                state = becomes[state]
            yield pa.record_batch([batch.column("conv"), batch.column("chunk"), pa.array(states, pa.int64()), pa.array(firsts)], names=["conv", "chunk", "state", "edge"])

    return run


TRACE = "conv binary, chunk long, audit string, cost long, illegal long, first string, last string, edits array<struct<at: long, row: binary, before: string, role: string>>"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits, cost and illegal neighbours of each chunk; ``edits`` names the rows that stay or have turns inserted before
    them, with these turns and a new role, a missing row standing for the end of the conversation."""
    tables = BlockTables()
    names = ["conv", "chunk", "audit", "cost", "illegal", "first", "last", "edits"]
    cost_of = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    kind = pa.list_(pa.struct([("at", pa.int64()), ("row", pa.binary()), ("before", pa.string()), ("role", pa.string())]))
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv", "chunk", "items", "right", "entry", "last")]
        for conv, chunk, items, right, state, ends in zip(*columns, strict=True):
            symbols = _symbols(items)
            done, behind = tables.trace(tables.codes(symbols), right, state)
            cost = sum(cost_of[c] for edits in done for c in edits)
            cost += sum(TRUNCATED for c, edits in zip(symbols, done, strict=True) if c.isupper() and edits[-1] != "D")
            edits, k, q = [], 0, state
            for item in items:
                before = ""
                for part in range(item["times"]):
                    made = done[k + part]
                    for _ in made[:-1]:
                        role, q = _due(q)
                        before += f"{role}:\n"
                    if part == 0 and made[-1] != "D":
                        if made[-1] == "R":
                            role, q = _due(q)
                        else:
                            role, q = None, _then(q, item["initial"])
                        edits.append({"at": item["at"], "row": item["row"], "before": before, "role": role or ""})
                        before = ""
                k += item["times"]
                if before:  # inserted before a row that goes
                    edits.append({"at": item["at"] + 1, "row": None, "before": before, "role": None})
            audit = "".join(done)
            if ends:
                more, before = tables.finish(behind), ""
                for _ in more:
                    role, behind = _due(behind)
                    before += f"{role}:\n"
                audit, cost = audit + more, cost + INSERT * len(more)
                if before:
                    edits.append({"at": items[-1]["at"] + 2, "row": None, "before": before, "role": None})
            initials = "".join(i["initial"] * i["times"] for i in items)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            out.append((conv, chunk, audit, cost, illegal, initials[0], initials[-1], edits))
        if out:
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def damage(conversations: DataFrame, faults: int = 20) -> DataFrame:
    """Rows of ``conversations`` with conv (binary), turn, role, text, times; damaged by the CRC-32 of 'conv_id:turn' modulo
    ``faults``: 0 drops a row, 1 empties its text, 2 takes the ends of sentences from it, 3 repeats it, 4 makes it the user's.
    Nulls are one space, but a null turn stays null for the order. Rows without conv_id are one conversation."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    number = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name, F.lit(":"), number).cast("binary")) % faults
    text = F.coalesce("text", F.lit(" "))
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("_fault", fault)
        .where("_fault <> 0")
        .select(
            name.cast("binary").alias("conv"),
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.when(F.col("_fault") == 3, 2).otherwise(1).cast("long").alias("times"),
        )
    )


def _digest(*parts: Column) -> Column:
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(p.cast("string"), F.lit("-")) for p in parts)]
    return F.substring(F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256)), 1, 16)


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv (binary), turn, role, text (not null) and times, how often the row stands there. Rows are taken by turn,
    null first, then by the digest of role and text. A row is blank, else a duplicate of an earlier one of its conversation, else
    truncated. The cheapest edits that make the initials of the roles fit (s?(ua)+)? are found from the end of each conversation
    by ``BlockTables``, and traced from its beginning; of equally cheap ones the ASCII-least.

    A conversation of more than ``chunk`` rows is repaired in pieces side by side: a piece says which vector it makes of any
    vector, one scan of these tells each piece the vector behind it, and another one the state before it. Scans hold one piece's
    table. The audit of a conversation is one string and its digest one hash, so these two are put together by one task each.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    base = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    told = rows.select(
        "conv", "turn", "times", "role", "text", _digest(F.col("role"), F.col("text")).alias("said"),
        _digest(F.hex("conv"), F.col("turn"), F.col("role"), F.col("text")).alias("row"),
    )
    slim = told.select(
        "conv", "turn", "times", "said", "row", base.alias("initial"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    distinct = stored(
        slim.groupBy("conv", "row").agg(
            F.first("turn").alias("turn"), F.first("said").alias("said"), F.sum("times").alias("times"),
            F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut").alias("cut"),
        ),
        "distinct-rows",
    )
    firsts = distinct.groupBy("conv", "said").agg(F.min(F.struct("turn", "row")).alias("f")).select(F.col("f.row").alias("_first"))
    marked = distinct.join(firsts, F.col("row") == F.col("_first"), "left").withColumn("fresh", ~F.col("blank") & F.col("_first").isNotNull())
    counted = running(marked.drop("_first"), ["turn", "said"], {"upto": F.col("times")}, ["conv"], "places")
    counted = stored(counted, "rows-in-order")
    counts = counted.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("times") - F.col("fresh").cast("long"))).alias("duplicate"),
        F.sum((F.col("fresh") & F.col("cut")).cast("long")).alias("truncated"),
    )
    symbol = F.when(~F.col("fresh"), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    # A row that stands there very often is taken in parts, of which only the first can stay.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(chunk).cast("long"))).alias("part")
    parts = counted.select("conv", "row", "initial", "times", "upto", symbol.alias("symbol"), part).select(
        "conv",
        F.floor((F.col("upto") - F.col("times") + F.col("part")) / chunk).alias("chunk"),
        F.struct(
            (3 * (F.col("upto") - F.col("times") + F.col("part"))).alias("at"),
            F.when(F.col("part") == 0, F.col("symbol")).otherwise("x").alias("symbol"),
            "initial",
            F.least(F.lit(chunk).cast("long"), F.col("times") - F.col("part")).alias("times"),
            "row",
        ).alias("item"),
    )
    chunks = stored(parts.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items")), "chunks")
    several = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv")
    end = BlockTables().end
    alone = chunks.join(several, "conv", "left_anti").select(
        "*", F.lit(end).cast("long").alias("right"), F.lit(NOTHING).cast("long").alias("entry"), F.lit(True).alias("last"), F.lit(True).alias("starts")
    )
    many = stored(chunks.join(several, "conv"), "long-conversations")
    schema, met = "conv binary, chunk long, becomes array<long>", "conv binary, chunk long, state long, edge boolean"
    passed = many.select("conv", "chunk", "items").mapInArrow(_passed, schema).repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    rights = many.join(passed.mapInArrow(_scan(end), met), ["conv", "chunk"])
    rights = stored(rights, "vectors")
    left = rights.select("conv", "chunk", "items", "state").mapInArrow(_left, schema).repartition("conv").sortWithinPartitions("conv", "chunk")
    entries = left.mapInArrow(_scan(NOTHING), met).select("conv", "chunk", F.col("state").alias("entry"), F.col("edge").alias("starts"))
    pieces = rights.select("conv", "chunk", "items", F.col("state").alias("right"), F.col("edge").alias("last")).join(entries, ["conv", "chunk"])
    ready = alone.select("conv", "chunk", "items", "right", "entry", "last").unionByName(
        pieces.select("conv", "chunk", "items", "right", "entry", "last")
    )
    traces = stored(ready.mapInArrow(_traced, TRACE), "traces")

    def strung(column: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("chunk", column))), lambda x: x[column])

    # Neighbours across pieces: the last initial of each and the first one of the next.
    pairs = F.transform(F.slice("_firsts", 2, F.size("_firsts")), lambda f, i: F.concat(F.col("_lasts")[i], f))
    seam = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    whole = traces.groupBy("conv").agg(
        F.array_join(strung("audit"), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("_illegal"),
        strung("first").alias("_firsts"), strung("last").alias("_lasts"),
    )
    whole = whole.select("conv", "audit", "cost", (F.col("_illegal") + seam).alias("illegal"))
    edits = traces.select("conv", F.explode("edits").alias("e")).select("conv", "e.*")
    texts = told.groupBy("row").agg(F.first("role").alias("_role"), F.first("text").alias("_text"))
    turn = F.concat("before", F.when(F.col("role") != "", F.col("role")).otherwise(F.col("_role")), F.lit(":"), "_text")
    kept = edits.where("row is not null").join(texts, "row").select("conv", "at", turn.cast("binary").alias("piece"))
    # An inserted turn before a row that goes has the line feed of the next turn behind it, which joining adds.
    made = edits.where("row is null").select("conv", "at", F.expr("substring(before, 1, length(before) - 1)").cast("binary").alias("piece"))
    sha = joined_sha256(kept.unionByName(made), "conv", ["at"], "piece", "\n", "repaired").withColumnsRenamed({"group": "conv", "sha": "_sha"})
    return counts.join(whole, "conv").join(sha, "conv", "left").select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("_sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repair_damaged(spark: SparkSession, conversations: DataFrame, faults: int = 20, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id of ``conversations``, damaged by ``damage`` and mended by ``repair``; zeros, an empty audit and the
    hash of nothing where no row is left. Other columns are not read; an empty table gives no rows."""
    found = repair(damage(conversations, faults), chunk)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    named = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).cast("binary"))
    zeros = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return named.join(found, "conv", "left").select(
        "conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
