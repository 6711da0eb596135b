"""WARC archives of captures, and their index: sorted runs merged by loser trees into histories in one global order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .linking import bitmap, marked
from .ranges import carried, first_of_group, same
from .url_lists import host_of, path_of

#: Begins each record. Archives are read in splits that start there, so no block holds it (see ``_message``).
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size are stored once.
LEAST = 100
#: Captures that one merge task orders, and the most ranges there are.
PER_RANGE, RANGES = 100_000, 65_536
ORDER = ["url_key", "stamp", "place", "record_id"]


def url_key(url: Column) -> Column:
    """The key that captures are ordered by: labels of the host from the last to the first, port if it is named and not the
    usual one, ')', path and query, all in lower case; the lower-case URL where there is no host, '' for null."""
    labels = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.concat(labels, F.when(port.isin(":80", ":443"), "").otherwise(port), F.lit(")"), F.lower(path_of(url)), F.lower(query))
    return F.coalesce(whole, F.lower(url), F.lit(""))


def _message(html: Column, size: Column, body: bool) -> Column:
    """The HTTP response with (or without) its body. A body that holds the words that begin a record is sent chunked,
    cut inside of these words, as transfer codings aren't part of the payload."""
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    plain = F.concat(head, F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    if not body:
        return plain
    pieces = F.filter(F.split(html, "(?<=WARC)(?=/1\\.1\r\n)"), lambda p: p != "")
    chunks = F.transform(pieces, lambda p: F.concat(F.hex(F.octet_length(p)), F.lit("\r\n"), p, F.lit("\r\n")))
    chunked = F.concat(head, F.lit("Transfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    return F.when(html.contains(VERSION), chunked).otherwise(F.concat(plain, html))


def write_archives(captures: DataFrame, path: str, least: int = LEAST) -> None:
    """Write a WARC record per row of ``captures`` (page_id, url, captured_at, html) to archives in the folder ``path``.

    The payload is ``html`` in UTF-8, null being empty. Of the captures whose payloads are equal and have ``least`` bytes or
    more, the one with the smallest page_id becomes a response, the others revisits of it without payload; shorter ones are
    all responses. Rows without page_id come last in that order, and of rows repeated with one page_id one is the response.
    Each row has a record ID of its own. A null URL or day leaves its field out; line breaks in a URL are percent-encoded.
    Archives are plain files, one per task, and any of them can be cut into splits for reading. Equal payloads are combined
    before they are sent, so a payload that a third of all captures share is sent once a task, and others not at all.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = captures.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # Who is a response is settled without payloads. A payload that may be repeated is then sent once, to the response of its
    # digest; any other one is written where it is read, as a response whose name needs no number.
    large = F.col("size") >= least
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))

    def urn(number: Column) -> Column:
        hexed = F.md5(F.concat_ws("\n", number.cast("string"), F.col("page_id").cast("string"), "digest", "url"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(hexed, at, n) for at, n in cuts)), F.lit(">"))

    slim = rows.withColumn("html", F.when(~large, F.col("html"))).withColumn("row", F.monotonically_increasing_id())
    slim = stored(slim.withColumn("record_id", urn(F.col("row"))), "captures")
    value = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "row", "record_id", "url", "date")
    found = stored(first_of_group(slim.where(large).drop("html"), ["digest"], ["page_id", "row"], value, "payloads"), "firsts")
    repeated = bitmap(found.where("row <> first.row"), "digest")
    told = marked(rows.where(large), repeated, "digest", "_again")
    own = told.where("not _again").withColumn("record_id", urn(F.lit(None)))
    found = marked(found, repeated, "digest", "_again").where("_again")
    bodies = told.where("_again").groupBy(F.col("digest").alias("_digest")).agg(F.first("html").alias("html"))
    first = F.struct(F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("date"))
    columns = ["page_id", "url", "date", "digest", "size", "record_id"]
    again = found.where("row <> first.row").select(
        *columns, F.lit(None).cast("string").alias("html"), F.struct("first.record_id", "first.url", "first.date").alias("first")
    )
    news = found.where("row = first.row").join(bodies.hint("merge"), F.col("digest") == F.col("_digest")).select(*columns, "html", first.alias("first"))
    joined = slim.where(~large).select(*columns, "html", first.alias("first")).unionByName(news).unionByName(again)
    joined = joined.unionByName(own.select(*columns, "html", first.alias("first")))
    revisit = F.col("first.record_id").isNotNull()

    def field(name: str, text: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), text)

    block = F.when(revisit, _message(F.col("html"), F.col("size"), False)).otherwise(_message(F.col("html"), F.col("size"), True))
    head = F.concat_ws(
        "\r\n",
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", F.col("date")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        field("WARC-Refers-To", F.col("first.record_id")),
        field("WARC-Refers-To-Target-URI", F.col("first.url")),
        field("WARC-Refers-To-Date", F.col("first.date")),
        field("Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length("block").cast("string")),
    )
    # The line feed after the last carriage return of a record is the one that ends a line of the text sink.
    record = F.concat(F.lit(VERSION), head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r"))
    joined.withColumn("block", block).select(record.alias("value")).write.option("lineSep", "\n").text(path)


def _body(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


RECORD = (
    "file string, split long, row long, length long, record_id string, record_type string, url string, date string, digest string, "
    "page_id long, target string, payload_bytes long"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *([pa.string()] * 5), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in RECORD.split(", ")]
    for batch in batches:
        rows = []
        for file, split, row, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not value:
                continue  # what is before the first record of a file
            head, _, rest = value.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            size = int(fields["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError(f"{fields['WARC-Record-ID']} in {file} does not have the length that it names")
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            payload = _body(rest[:size]) if kind == "response" else None
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} in {file} does not have the digest that it names")
            page = fields.get("Page-Id")
            rows.append((
                file, split, row, len(value) + len(VERSION), fields["WARC-Record-ID"], kind, fields.get("WARC-Target-URI"),
                fields.get("WARC-Date"), digest, None if page is None else int(page), fields.get("WARC-Refers-To"),
                None if payload is None else len(payload),
            ))
        if rows:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that ``write_archives`` put in ``path``, one row each: file, offset and length there,
    record_id, record_type, url, captured_at, page_id, payload_digest, payload_bytes, refers_to, refers_to_record.

    Files are read in splits, so their size does not matter. A response whose length or digest is not the one that it
    names ends the read with an error; a revisit has the size and page of the response that it names.
    """
    text = spark.read.option("lineSep", VERSION).text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"),
    )
    records = stored(lines.mapInArrow(_parsed, RECORD), "records")
    target = records.withColumn("_target", F.coalesce("target", "record_id"))
    value = F.struct((F.col("record_type") == "revisit").alias("again"), "page_id", "payload_bytes")
    found = first_of_group(target, ["_target"], ["record_type", "record_id"], value, "targets")
    before = Window.partitionBy("file").orderBy("split", "row").rowsBetween(Window.unboundedPreceding, -1)
    revisit = F.col("record_type") == "revisit"
    return found.select(
        "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "record_id", "record_type", "url",
        F.from_utc_timestamp(F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.current_timezone()).cast("timestamp").alias("captured_at"),
        "page_id", F.col("digest").alias("payload_digest"), F.col("first.payload_bytes").alias("payload_bytes"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.col("target").alias("refers_to_record"),
    )


class LoserTree:
    """Merges sorted sources: inner nodes hold the losers of their matches, so the next item costs one match a level."""

    def __init__(self, sources: Sequence[Sequence[tuple]]):
        self.sources = sources
        self.at = [0] * len(sources)
        self.heads = [self._head(k) for k in range(len(sources))]
        self.losers = [0] * len(sources)
        self.winner = self._play(1) if sources else -1

    def _head(self, k: int) -> tuple:
        """The next key of a source, behind all keys where it has ended."""
        return (False, self.sources[k][self.at[k]]) if self.at[k] < len(self.sources[k]) else (True,)

    def _play(self, node: int) -> int:
        k = len(self.sources)
        if node >= k:
            return node - k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        winner, loser = (right, left) if self.heads[right] < self.heads[left] else (left, right)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(source, position) of all items in order."""
        k = len(self.sources)
        while k and not self.heads[self.winner][0]:
            winner = self.winner
            yield winner, self.at[winner]
            self.at[winner] += 1
            self.heads[winner] = self._head(winner)
            node = (winner + k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[winner]:
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.winner = winner


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, which come as pieces of sorted runs, in order, with the range and their place in it."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = list(zip(*(table.column(c).to_pylist() for c in ORDER), strict=True))
    runs: dict[int, list[list[int]]] = {}
    for k, run in enumerate(table.column("run").to_pylist()):
        parts = runs.setdefault(run, [])
        # A run is in order where it was written; should its pieces come in another order, each is a run of its own.
        if not parts or keys[parts[-1][-1]] > keys[k]:
            parts.append([])
        parts[-1].append(k)
    sources = [part for parts in runs.values() for part in parts]
    order = np.array([sources[s][at] for s, at in LoserTree([[keys[k] for k in part] for part in sources])], np.int64)
    out = table.take(pa.array(order)).drop_columns(["run"])
    urls = [keys[k][0] for k in order]
    nth, before = np.zeros(len(urls), np.int64), 0
    for k, url in enumerate(urls):
        before = before + 1 if k and url == urls[k - 1] else 1
        nth[k] = before
    out = out.append_column("_range", pa.array(np.full(len(urls), TaskContext.get().partitionId(), np.int32)))
    out = out.append_column("_seq", pa.array(np.arange(1, len(urls) + 1))).append_column("_nth", pa.array(nth))
    yield from out.to_batches()


def merge_index(records: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The records as one index in order of URL key, time and page, with position (from 1) in all of it and nth, the number
    of the capture in the history of its URL key.

    Each task sorts its records into a run. Runs are then cut at common bounds of (key, time, page, record), so that also
    the history of one URL can be shared by many tasks, and the pieces of each range, about ``per_range`` records, are merged by a
    loser tree. Records without URL or time come first, those without page last among equals.
    """
    keyed = records.select(
        "*",
        url_key(F.col("url")).alias("url_key"),
        F.coalesce(F.date_format(F.to_utc_timestamp("captured_at", F.current_timezone()), "yyyyMMddHHmmss"), F.lit("")).alias("stamp"),
        F.coalesce("page_id", F.lit(2**63 - 1)).alias("place"),
    )
    runs = stored(keyed.sortWithinPartitions(*ORDER).withColumn("run", F.spark_partition_id()), "index-runs")
    n = runs.count()
    ranged = runs.repartitionByRange(min(max(1, -(-n // per_range)), RANGES), *ORDER)
    kept = [f for f in ranged.schema.fields if f.name != "run"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _range int, _seq long, _nth long"
    merged = stored(ranged.mapInArrow(_merged, schema), "index")
    # One row a range, and at most two more for the URL keys that go on from one range to the next.
    up_to = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = merged.groupBy(F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.select("_at", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_start"))
    wide = carried(merged, ["url_key"], {"_earlier": F.count(F.lit(1))})
    placed = merged.join(F.broadcast(starts), merged["_range"] == starts["_at"]).drop("_at")
    counted = placed.join(F.broadcast(wide), same(placed, wide, ["url_key"]) & (placed["_range"] == wide["_at"]), "left")
    return counted.select(
        *records.columns, "url_key", (F.col("_start") + F.col("_seq")).alias("position"), (F.coalesce("_earlier", F.lit(0)) + F.col("_nth")).alias("nth")
    )


def archive(captures: DataFrame, path: str | None = None, least: int = LEAST, per_range: int = PER_RANGE) -> DataFrame:
    """Write ``captures`` (page_id, url, captured_at, html; others aren't read) as archives, read these back, and return
    their merged index: the columns of ``read_archives`` with url_key, position and nth. An empty table gives no rows."""
    spark = captures.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, least)
    return merge_index(read_archives(spark, path), per_range)
