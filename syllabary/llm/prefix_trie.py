"""The prefix trie of conversations: containers of suffixes under trie heads, burst by next turn, sorted and swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, stored
from .ranges import joined_sha256

#: A container with more turns left is burst (or with more than a 65,536th of all turns, see ``prefix_trie``).
LIMIT = 65_536
#: The most heads that one round of bursting may find, and sends to all tasks.
HEADS = 262_144
#: Parts of a prefix's name: sums of 32-bit hashes, one per turn and place.
LANES = 5

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, own_bytes long"
)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, bytes): 128 bits of the SHA-256 of role and text stand for a turn; null role or text is empty.
    Rows without conv_id belong to no conversation and are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, bytes) and (conv_id, length): each conversation c begins with the first h turns of conversation
    c - c % ``family`` and goes on with its own behind its first h, h being the CRC-32 of c's decimals modulo ``heads``.

    ``turns`` are in order of turn, null first, then of id. At most 2 x ``family`` conversations begin with the same one.
    """
    numbered = stored(running(turns, ["turn", "id"], {"pos": F.lit(1)}, ["conv_id"], "numbered"), "turns")
    convs = numbered.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < heads, F.struct("pos", "id", "bytes")))).alias("first"),
    )
    convs = stored(convs, "conversations")
    own = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = convs.select(F.col("conv_id").alias("_base"), F.col("first").alias("_first"))
    asked = convs.select("conv_id", "n", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("_from"))
    begun = asked.join(base, F.col("_from") == F.col("_base"), "left").select(
        "conv_id", "n", "h", F.when(F.col("h") > 0, F.slice("_first", 1, F.greatest("h", F.lit(1)))).alias("_taken")
    )
    begun = stored(begun.withColumn("_k", F.coalesce(F.size("_taken"), F.lit(0))), "begun")
    lengths = begun.select("conv_id", (F.col("_k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    taken = begun.select("conv_id", F.explode("_taken").alias("t")).select("conv_id", F.col("t.pos").alias("pos"), "t.id", "t.bytes")
    rest = numbered.join(begun.select("conv_id", "h", "_k"), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("_k")).alias("pos"), "id", "bytes")
    return taken.unionByName(rest), lengths


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``node``, the name of the prefix up to the turn, and ``upto``, its bytes. A name is made of sums of hashes of
    (place, id), which ranges of a long conversation can work out side by side; 160 bits tell all prefixes apart."""
    digest = F.sha1(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("id")))
    sums = {f"_lane{k}": F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(LANES)}
    summed = running(rows, ["pos"], sums | {"upto": F.col("bytes")}, ["conv_id"], "prefixes")
    name = F.concat(*(F.substring(F.unhex(F.lpad(F.hex(f"_lane{k}"), 16, "0")), 5, 4) for k in range(LANES)))
    return summed.select("conv_id", "pos", "id", "bytes", "upto", name.alias("node"))


def burst(rows: DataFrame, lengths: DataFrame, limit: int, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, node, bytes, upto, least) of the turns whose prefix is a trie head, and (conv_id, top): where the
    container of a conversation begins; null if it ends at a head.

    All begin in one container under the root. A container with more than ``limit`` turns left is burst by next turn, which
    becomes a head of its own if its container is above the limit again. A round takes as many turns as keep the heads that it
    can find under ``heads``: no more than the turns left can fill, level by level.
    """
    at, done, tops = 0, [], []
    active = lengths.where("length > 0")
    while True:
        left = active.agg(F.sum(F.col("length") - at)).first()[0]
        if not left:
            break
        step = max(1, heads * limit // left)
        near = rows.join(active, "conv_id").where((F.col("pos") > at) & (F.col("pos") <= at + step))
        sizes = near.groupBy("node").agg(
            F.sum(F.col("length") - F.col("pos")).alias("_left"), F.min("conv_id").alias("least")
        )
        big = stored(sizes.where(F.col("_left") > limit).select("node", "least"), "heads")
        # Each head of a level holds more than ``limit`` of the turns left, and there are ``step`` levels.
        met = stored(near.join(F.broadcast(big), "node", "left"), "burst")
        done.append(met.where("least is not null").select("conv_id", "pos", "node", "bytes", "upto", "least"))
        ends = met.groupBy("conv_id").agg(F.max("length").alias("length"), F.min(F.when(F.col("least").isNull(), F.col("pos"))).alias("top"))
        ends = stored(ends, "containers")
        tops.append(ends.where(F.col("top").isNotNull() | (F.col("length") <= at + step)).select("conv_id", "top"))
        at += step
        active = ends.where(F.col("top").isNull() & (F.col("length") > at)).select("conv_id", "length")
    if not done:
        nothing = rows.select("conv_id", "pos", "node", "bytes", "upto", F.col("conv_id").alias("least"))
        return nothing.where("false"), lengths.select("conv_id", F.lit(None).cast("long").alias("top")).where("false")
    found, top = done[0], tops[0]
    for more, further in zip(done[1:], tops[1:], strict=True):
        found, top = found.unionByName(more), top.unionByName(further)
    return found, top


class _Open:
    """A node on the path to the suffix that the sweep has reached."""

    __slots__ = ("bytes", "children", "closed", "depth", "ends", "id", "least", "leaves", "n", "saved")

    def __init__(self, turn: bytes, size: int, depth: int):
        self.id, self.bytes, self.depth = turn, size, depth
        self.n = self.leaves = self.saved = self.children = 0
        self.least, self.closed, self.ends = None, [], None

    def row(self, parent: int | None) -> tuple:
        ends = (self.ends or hashlib.sha256()).hexdigest()
        return self.least, self.depth, parent, self.n, self.children, self.leaves, self.saved, ends, self.bytes


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes sorted by (container, ids, conv_id), with the parent of the container's top: the nodes of each container.
    Held are the open path and, for its nodes, the children that have been closed."""
    names = [p.strip().split()[0] for p in NODE.split(", ")]
    kinds = [*([pa.int64()] * 7), pa.string(), pa.int64()]
    container, path, parent, out = None, [], None, []

    def finish() -> None:
        """The suffixes of the last node of the path have all passed: sum it up; its children learn their parent and leave."""
        node = path.pop()
        node.saved += (node.n - 1) * node.bytes
        node.leaves = node.leaves or 1
        out.extend(child.row(node.least) for child in node.closed)
        node.closed = []
        if path:
            path[-1].closed.append(node)
            path[-1].children += 1
            path[-1].leaves += node.leaves
            path[-1].saved += node.saved
        else:
            out.append(node.row(parent))

    def flush():
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.record_batch(columns, names=names)

    for batch in batches:
        for own, conv, top, above, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != container:
                while path:
                    finish()
                container, parent = own, above
            shared = 0
            while shared < len(path) and shared < len(ids) and path[shared].id == ids[shared]:
                shared += 1
            while len(path) > shared:
                finish()
            for k in range(shared, len(ids)):
                path.append(_Open(ids[k], sizes[k], top + k))
            for node in path:
                node.n += 1
                if node.least is None or conv < node.least:
                    node.least = conv
            last, number = path[-1], str(conv).encode()
            if last.ends is None:
                last.ends = hashlib.sha256(number)
            else:  # equal suffixes come one after the other, by conv_id
                last.ends.update(b"," + number)
        if out:
            yield flush()
    while path:
        finish()
    if out:
        yield flush()


def prefix_trie(conversations: DataFrame, family: int = 5, heads: int = 9, limit: int = LIMIT) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see ``rebuilt``): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first ``depth`` turns (role, text), named by its smallest member. Containers of
    conversations are burst by next turn until none has more than ``limit`` turns left, or a 65,536th of all turns if that is more;
    the remaining suffixes are sorted, whole containers to a task, and swept into nodes. What heads sum over their subtrees
    comes from their members: a conversation owns the nodes that it is the smallest member of, which are those from some depth
    on, so that no head waits for another one.

    Null turns come first; turns with equal numbers are ordered by the digest of their content, so repeated rows are repeated
    turns. Null role or text is empty, rows without conv_id are left out, other columns are not read. Without any
    conversation there is no root and no row.
    """
    rows, lengths = rebuilt(turn_ids(conversations), family, heads)
    lengths = stored(lengths, "lengths")
    rows = stored(_named(rows), "named-turns")
    total = lengths.agg(F.sum("length")).first()[0] or 0
    tops_of, top = burst(rows, lengths, max(limit, total // 65_536))
    head_rows = stored(tops_of, "head-turns")
    root = lengths.agg(F.min("conv_id")).first()[0]
    # The turn before a container's top is a head, and knows its smallest member; before that is the root.
    above = head_rows.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), F.col("least").alias("_least"))
    tops = top.where("top is not null").join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("top") - 1 == F.col("_pos")), "left")
    tops = tops.select(F.col("conv_id").alias("_own"), "top", F.coalesce("_least", F.lit(root).cast("long")).alias("_above"))
    inside = rows.join(tops, F.col("conv_id") == F.col("_own")).where("pos >= top")
    first = F.col("_suffix")[0]
    suffixes = (
        inside.groupBy("conv_id", "top", "_above")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "id", "bytes"))).alias("_suffix"))
        .select(
            first["node"].alias("container"), "conv_id", "top", "_above",
            F.transform("_suffix", lambda x: x["id"]).alias("ids"), F.transform("_suffix", lambda x: x["bytes"]).alias("sizes"),
        )
    )
    shards = suffixes.repartition("container").sortWithinPartitions("container", "ids", "conv_id")
    nodes = stored(shards.mapInArrow(_swept, NODE), "nodes")

    # What each conversation owns: from which depth on, the bytes there, and whether its end is a leaf.
    head_nodes = head_rows.where("conv_id = least").select(
        "conv_id", F.col("pos").alias("depth"), F.lit(1).cast("long").alias("n_children"), F.col("bytes").alias("own_bytes")
    )
    owned = nodes.select("conv_id", "depth", "n_children", "own_bytes").unionByName(head_nodes)
    owns = owned.groupBy("conv_id").agg(
        F.min("depth").alias("born"), F.sum("own_bytes").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    whole = rows.groupBy("conv_id").agg(F.sum("bytes").alias("bytes"))
    members = stored(
        lengths.join(owns, "conv_id", "left").join(whole, "conv_id", "left").fillna({"own": 0, "leaf": 0, "bytes": 0}), "members"
    )
    at_heads = head_rows.select("conv_id", F.col("pos").alias("depth"), "node", "least", F.col("bytes").alias("_bytes"), "upto").join(members, "conv_id")
    at_root = members.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("node"), F.lit(root).cast("long").alias("least"),
        F.lit(0).cast("long").alias("_bytes"), F.lit(0).cast("long").alias("upto"), "length", "born", "own", "leaf", "bytes",
    )
    every = at_heads.unionByName(at_root)
    left = F.col("bytes") - F.col("upto") + F.col("_bytes")
    ends = every.where("length = depth").select("node", "conv_id", F.col("conv_id").cast("string").cast("binary").alias("_piece"))
    sha = joined_sha256(ends, "node", ["conv_id"], "_piece", ",", "ends").withColumnsRenamed({"group": "_node", "sha": "_sha"})
    sums = every.groupBy("node", "depth", "least").agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("length") > F.col("depth")) & (F.col("born") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("born") <= F.col("depth"), 0).otherwise(left - F.when(F.col("born") > 0, F.col("own")).otherwise(0))).alias("saved_tokens"),
    )
    up = above.withColumnsRenamed({"_least": "_up"})
    placed = sums.join(up, (F.col("least") == F.col("_conv")) & (F.col("depth") - 1 == F.col("_pos")), "left").join(
        sha, F.col("node") == F.col("_node"), "left"
    )
    nothing = hashlib.sha256().hexdigest()
    above_all = placed.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("_up", F.lit(root).cast("long"))).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1).cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("_sha", F.lit(nothing)).alias("ends_sha256"),
    )
    return nodes.drop("own_bytes").unionByName(above_all)
