"""Trie of conversations by their turns, built from sorted shards around a skeleton of splitter paths.

Conversations are cut into segments of ``SEGMENT`` turns, so no row holds a
whole one.  The segments that start at the same node form a small trie of
their own: a *group*.  Keys ``(segment number, node it starts at, path of turn
digests, conversation)`` are sorted into shards between splitters.  A node
whose path is no prefix of a splitter lies in one shard, which finishes it
while it walks its sorted rows.  The prefixes of the splitters are the
*skeleton*: every shard gets them, each gives partial aggregates for those it
meets, and these are reduced, first by node in Spark and then up the skeleton,
whose size is bounded by the number of shards times ``SEGMENT``.

Sums over subtrees that reach into later segments come from the groups of
those segments: their own sums are added up along the tree of groups by
doubling the distance, in as many rounds as the logarithm of the longest
conversation.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.numbering import sorted_ids
from threadloom.session import cut_lineage

#: Turns of a segment.
SEGMENT = 64
#: Segments in a row whose fingerprints are combined by one window.
BLOCK_SEGMENTS = 1_024
#: Keys that are sampled for each splitter; the driver gets this many times the number of shards.
SAMPLES = 32
#: Conversation ids of one piece of a list that goes to a skeleton node.
IDS_AT_ONCE = 4_096
#: Hex characters of a turn's digest.
DIGEST = 32

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()

NODE, PARTIAL, IDS, GROUP = range(4)
OUT = pa.schema(
    [
        ("kind", pa.int32()), ("skeleton", pa.int32()), ("parent_skeleton", pa.int32()), ("prefix", pa.string()), ("depth", pa.int64()),
        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
    ]
)
OUT_SQL = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint' if f.type == pa.int64() else 'string'}" for f in OUT)


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, position, n_turns, digest, words)``; positions from 0 by turn, null first.

    Null roles and texts are empty; rows without a conversation are left out.
    Equal turn numbers are ordered by digest, and rows that are equal in all
    have any order, which changes nothing.  Positions come from one sort of
    all turns, so a conversation that holds most of them is shared by many
    tasks.
    """
    c = conversations
    who, said = F.coalesce(c[role], F.lit("")), F.coalesce(c[text], F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256), 1, DIGEST)
    turns = c.filter(c[conv].isNotNull()).select(
        c[conv].cast("bigint").alias("conv_id"), c[turn].alias("_turn"), digest.alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("_tie"),
    )
    placed = sorted_ids(turns, ["conv_id", F.col("_turn").asc_nulls_first(), "digest", "_tie"], "_id").drop("_turn", "_tie")
    whole = placed.groupBy("conv_id").agg(F.min("_id").alias("_start"), F.count("*").alias("n_turns"))
    return placed.join(whole, "conv_id").select("conv_id", (F.col("_id") - F.col("_start")).alias("position"), "n_turns", "digest", "words")


def share_openings(turns: DataFrame, opening: Column, most: int, base: Column) -> tuple[DataFrame, DataFrame]:
    """Turns and members of conversations whose first turns are replaced by those of another.

    Of each conversation the first ``opening`` turns (an expression of
    ``conv_id``, ``most`` at most) go, and the first ``opening`` ones of
    conversation ``base`` come in their place, as far as there are any.
    """
    turns = turns.withColumn("_h", opening)
    own = turns.groupBy("conv_id").agg(F.max("n_turns").alias("_own"), F.max("_h").alias("_h")).withColumn("_base", base)
    bases = own.select(F.col("conv_id").alias("_base"), F.col("_own").alias("_there"))
    joined = own.join(bases, "_base", "left")
    came = F.least("_h", F.coalesce("_there", F.lit(0)))
    members = cut_lineage(joined.select("conv_id", "_h", "_base", came.alias("_came"), (F.greatest(F.col("_own") - F.col("_h"), F.lit(0)) + came).alias("n_turns")))
    first = turns.filter(F.col("position") < most).select(F.col("conv_id").alias("_base"), "position", "digest", "words")
    heads = first.join(members, "_base").filter(F.col("position") < F.col("_h")).select("conv_id", "position", "n_turns", "digest", "words")
    rest = (
        turns.drop("n_turns", "_h")
        .join(members, "conv_id")
        .filter(F.col("position") >= F.col("_h"))
        .select("conv_id", (F.col("position") - F.col("_h") + F.col("_came")).alias("position"), "n_turns", "digest", "words")
    )
    return rest.unionByName(heads), members.select("conv_id", "n_turns")


def segments(turns: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``(conv_id, segment, prefix, next, more, path, words)``: at most ``size`` turns a row, and one row for a conversation without turns.

    ``prefix`` names the node that the segment starts at (empty: the root) and
    ``next`` the one it ends at if it is full: a fingerprint of 128 bits over
    all earlier segments, combined by exclusive or, so it takes no walk along
    the conversation.
    """
    one = F.struct("position", "digest", "words")
    number = F.floor(F.col("position") / F.lit(size)).cast("bigint")
    rows = turns.select("conv_id", "n_turns", number.alias("segment"), one.alias("_turn"))
    empty = members.filter("n_turns = 0").select("conv_id", "n_turns", F.lit(0).cast("bigint").alias("segment"), F.lit(None).cast(rows.schema["_turn"].dataType).alias("_turn"))
    packed = rows.unionByName(empty).groupBy("conv_id", "segment").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list("_turn")).alias("_turns"))
    packed = cut_lineage(
        packed.select(
            "conv_id", "segment", (F.col("n_turns") > size * (F.col("segment") + 1)).alias("more"),
            F.array_join("_turns.digest", "").alias("path"), F.col("_turns.words").alias("words"),
        )
    )
    full = F.length("path") == size * DIGEST
    short = packed.filter((F.col("segment") == 0) & ~full).withColumn("prefix", F.lit("")).withColumn("next", F.lit(None).cast("string"))
    long = packed.filter((F.col("segment") > 0) | full).withColumn("_block", F.floor(F.col("segment") / BLOCK_SEGMENTS))
    prints = {"_a": F.xxhash64("segment", "path"), "_b": F.xxhash64(F.reverse("path"), "segment")}
    long = long.withColumns(prints)
    blocks = long.groupBy("conv_id", "_block").agg(F.bit_xor("_a").alias("_all_a"), F.bit_xor("_b").alias("_all_b"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "_block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    blocks = blocks.select("conv_id", "_block", *[F.coalesce(F.bit_xor(f"_all{c}").over(before), zero).alias(f"_base{c}") for c in prints])
    long = long.withColumns({f"_in{c}": F.coalesce(F.bit_xor(c).over(inside), zero) for c in prints}).join(blocks, ["conv_id", "_block"])
    at = {c: F.col(f"_base{c}").bitwiseXOR(F.col(f"_in{c}")) for c in prints}
    name = lambda parts: F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts])
    long = long.select(
        *packed.columns, F.when(F.col("segment") == 0, F.lit("")).otherwise(name(at.values())).alias("prefix"),
        F.when(full, name([p.bitwiseXOR(F.col(c)) for c, p in at.items()])).alias("next"),
    )
    return short.unionByName(long)


class Skeleton:
    """The trie of the splitter paths; nodes are numbered so that parents come first."""

    def __init__(self, splitters: list[tuple[int, str, str, int]], size: int) -> None:
        self.splitters, self.size = splitters, size
        self.ids: list[list[int]] = []
        self.parent: list[int] = []
        last: tuple[int, str, str] = (-1, "", "")
        for segment, prefix, path, _ in splitters:
            same = common(path, last[2]) if (segment, prefix) == last[:2] else -1
            ids = self.ids[-1][: same + 1] if same >= 0 else []
            while len(ids) <= len(path) // DIGEST:
                self.parent.append(ids[-1] if ids else -1)
                ids.append(len(self.parent) - 1)
            self.ids.append(ids)
            last = segment, prefix, path

    def shard(self, key: tuple[int, str, str, int]) -> int:
        return bisect_right(self.splitters, key)

    def at(self, shard: int, segment: int, prefix: str, path: str) -> list[int]:
        """Numbers of the skeleton nodes on a path that lies in a shard, from its top down."""
        best: list[int] = []
        for k in (shard - 1, shard):
            if 0 <= k < len(self.splitters) and self.splitters[k][:2] == (segment, prefix):
                same = common(path, self.splitters[k][2]) + 1
                if same > len(best):
                    best = self.ids[k][:same]
        return best


def common(a: str, b: str) -> int:
    """Turns that two paths start with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    k = 0
    while a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


class Node:
    __slots__ = ("carried", "children", "conv", "depth", "digest", "ids", "leaves", "n", "saved", "skeleton", "waiting", "words")

    def __init__(self, depth: int, words: int, skeleton: int) -> None:
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.conv = self.digest = None
        self.n = self.children = self.leaves = self.saved = 0
        self.carried = (0, 0, 0)
        self.ids: list[int] = []
        #: Finished children, which need this node's smallest member; a node of the skeleton has none, as theirs comes by its number.
        self.waiting: list[list] = []


class Walk:
    """Finishes the nodes of a shard from its sorted rows; it holds one path and the children of the nodes on it."""

    def __init__(self, skeleton: Skeleton) -> None:
        self.skeleton, self.rows = skeleton, []
        self.group, self.path, self.stack = None, "", []

    def row(self, shard: int, segment: int, prefix: str, path: str, conv: int, words: list[int], top: int | None, carried: tuple | None) -> None:
        """``carried``: children, leaves and saved tokens below the row's last node, if the conversation goes on."""
        if (shard, segment, prefix) != self.group:
            self.end()
            self.group, self.path, self.top = (shard, segment, prefix), "", top
            marks = self.skeleton.at(*self.group, path)
            self.stack = [Node(segment * self.skeleton.size, 0, marks[0] if marks else -1)]
            same = 0
        else:
            same = common(path, self.path)
        while len(self.stack) > same + 1:
            self.close()
        if len(path) > same * DIGEST:
            marks = self.skeleton.at(*self.group, path)
            for k in range(same + 1, len(path) // DIGEST + 1):
                self.stack.append(Node(segment * self.skeleton.size + k, words[k - 1], marks[k] if k < len(marks) else -1))
        self.path, node = path, self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None or conv < node.conv else node.conv
        if carried is not None:
            node.carried = carried
        elif node.skeleton >= 0:
            node.ids.append(conv)
            if len(node.ids) == IDS_AT_ONCE:
                self.send_ids(node)
        elif node.digest is None:
            node.digest = hashlib.sha256(b"%d" % conv)
        else:
            node.digest.update(b",%d" % conv)

    def send_ids(self, node: Node) -> None:
        if node.ids:
            self.rows.append([IDS, node.skeleton, None, None, node.depth, node.ids[0], None, None, None, None, None, None, ",".join(map(str, node.ids))])
            node.ids = []

    def close(self) -> None:
        node, segment, prefix = self.stack.pop(), *self.group[1:]
        up = self.stack[-1] if self.stack else None
        children, leaves, saved = node.children + node.carried[0], node.leaves + node.carried[1], node.saved + node.carried[2]
        starts_group = up is None and segment > 0
        if node.skeleton < 0 and not starts_group:
            leaves = leaves or int(children == 0)
            saved += (node.n - 1) * node.words
        digest = EMPTY if node.digest is None else node.digest.hexdigest()
        # the node above a segment's first turn is the same for its whole group
        parent = self.top if up is not None and segment > 0 and len(self.stack) == 1 else None
        kind = PARTIAL if node.skeleton >= 0 else GROUP if starts_group else NODE
        row = [kind, None, None, prefix, node.depth, node.conv, parent, node.n, children, leaves, saved, node.words, digest]
        for child in node.waiting:
            child[6] = node.conv
            self.rows.append(child)
        if kind == PARTIAL:
            self.send_ids(node)
            # of what all shards have in common only one may count
            row[1], row[8:11], row[12] = node.skeleton, [node.children, node.leaves, node.saved], ",".join(map(str, node.carried))
            self.rows.append(row)
        elif up is None or parent is not None:
            self.rows.append(row)
        elif up.skeleton >= 0:
            row[2] = up.skeleton
            self.rows.append(row)
        else:
            up.waiting.append(row)
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None or node.conv < up.conv else up.conv
            if node.skeleton < 0:
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved

    def end(self) -> None:
        while self.stack:
            self.close()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(OUT)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


KEY = ("segment", "prefix", "path", "conv_id")


def _skeleton(rows: DataFrame, shards: int, size: int) -> Skeleton:
    """Splitters from a sample of ``SAMPLES * shards`` keys, whatever the number of rows."""
    total = rows.count()
    share = min(1.0, SAMPLES * shards / max(total, 1))
    mark = F.pmod(F.xxhash64("conv_id", "segment", F.lit(11)), F.lit(1 << 30))
    keys = sorted(tuple(r) for r in rows.filter(mark < int(share * (1 << 30)) + 1).select(*KEY).collect())
    picked = [keys[len(keys) * k // shards] for k in range(1, shards)] if keys else []
    return Skeleton(sorted(set(picked)), size)


def _walked(rows: DataFrame, size: int) -> tuple[DataFrame, Skeleton]:
    """What the shards give: finished nodes, partial aggregates of skeleton nodes, lists of ids, sums of groups."""
    spark = rows.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    skeleton = _skeleton(rows, shards, size)
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            numbers = pa.array([shared.value.shard(k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "shard"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Walk(shared.value)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", *KEY, "words", "top", "more", "children", "leaves", "saved")]
            for shard, segment, prefix, path, conv, words, top, more, *carried in zip(*columns, strict=True):
                run.row(shard, segment, prefix, path, conv, words, top, tuple(carried) if more else None)
            yield run.batch()
        run.end()
        yield run.batch()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(deal, f"{kinds}, shard int").repartitionById(shards, "shard").sortWithinPartitions("shard", *KEY)
    return cut_lineage(dealt.mapInArrow(walk, OUT_SQL)), skeleton


def _reduced(walked: DataFrame, skeleton: Skeleton) -> list[list]:
    """Skeleton nodes ``[number, prefix, depth, conv, parent, n_convs, children, leaves, saved, starts a group]``, by number.

    Partial aggregates are reduced to one row a node by Spark; those rows, at
    most a segment's turns and one for each shard, are folded up the skeleton here.
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    more = [F.max(c).alias(c) for c in ("prefix", "depth", "parent_conv_id", "words", "ends")]
    rows = walked.filter(F.col("kind") == PARTIAL).groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums, *more).collect()
    found = {r["skeleton"]: r for r in rows}
    below = {k: [0, 0, 0] for k in found}
    out: dict[int, list] = {}
    for k in sorted(found, reverse=True):
        r, up = found[k], skeleton.parent[k]
        carried = [int(x) for x in r["ends"].split(",")]
        children, leaves, saved = (a + b + c for a, b, c in zip((r["n_children"], r["n_leaves"], r["saved_tokens"]), below[k], carried, strict=True))
        starts_group = up < 0 and r["depth"] > 0
        if not starts_group:
            leaves, saved = leaves or int(children == 0), saved + (r["n_convs"] - 1) * r["words"]
        parent = r["parent_conv_id"] if r["parent_conv_id"] is not None else found[up]["conv_id"] if up >= 0 else None
        out[k] = [k, r["prefix"], r["depth"], r["conv_id"], parent, r["n_convs"], children, leaves, saved, starts_group]
        if up >= 0:
            for x, v in enumerate((1, leaves, saved)):
                below[up][x] += v
    return [out[k] for k in sorted(out)]


def _id_lists(walked: DataFrame) -> DataFrame:
    """``(skeleton, ends_sha256)``: pieces of id lists go through the hash in order, and none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            numbers, hashes = [], []
            for k, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if k != node:
                    if node is not None:
                        numbers.append(node)
                        hashes.append(digest.hexdigest())
                    node, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(hashes, pa.string())], ["skeleton", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()], pa.string())], ["skeleton", "ends_sha256"])

    pieces = walked.filter(F.col("kind") == IDS).select("skeleton", "conv_id", "ends")
    return pieces.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").mapInArrow(run, "skeleton int, ends_sha256 string")


def _later(rows: DataFrame, size: int) -> DataFrame:
    """``(next, children, leaves, saved)`` of every node that a later segment starts at: all that lies below it."""
    spark = rows.sparkSession
    bare = rows.filter("segment > 0").select(
        *KEY, "words", "more", F.lit(None).cast("bigint").alias("top"),
        # a node that goes on is no leaf, whatever is below it
        F.lit(1).cast("bigint").alias("children"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"),
    )
    walked, skeleton = _walked(bare, size)
    groups = [(r[1], r[6], r[7], r[8]) for r in _reduced(walked, skeleton) if r[9]]
    own = walked.filter(F.col("kind") == GROUP).select(F.col("prefix").alias("id"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    own = own.unionByName(spark.createDataFrame(groups, own.schema))
    over = rows.filter("more and segment > 0").select(F.col("next").alias("id"), F.col("prefix").alias("above")).distinct()
    now = cut_lineage(own.join(over, "id", "left"))
    while not now.filter("above is not null").isEmpty():
        sums = now.filter("above is not null").groupBy(F.col("above").alias("id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        far = now.select(F.col("id").alias("above"), F.col("above").alias("_far"))
        now = cut_lineage(
            now.join(sums, "id", "left")
            .join(far, "above", "left")
            .select(
                "id", "children", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), F.col("_far").alias("above"),
            )
        )
    return now.select(F.col("id").alias("next"), "children", "leaves", "saved")


def trie_nodes(turns: DataFrame, members: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of conversations given as ``numbered_turns`` and ``(conv_id, n_turns)``; columns as ``prefix_trie``."""
    spark = turns.sparkSession
    rows = cut_lineage(segments(turns, members, size))
    nothing = {c: F.lit(None).cast("bigint") for c in ("top", "children", "leaves", "saved")}
    long = rows.filter("segment > 0 or more")
    if long.isEmpty():
        rows = rows.withColumns(nothing)
    else:
        later = _later(rows, size)
        tops = rows.filter("next is not null").groupBy(F.col("next").alias("prefix")).agg(F.min("conv_id").alias("top"))
        long = long.join(tops.filter("prefix <> ''"), "prefix", "left").join(later, "next", "left")
        rows = cut_lineage(rows.filter("segment = 0 and not more").withColumns(nothing).unionByName(long))
    walked, skeleton = _walked(rows, size)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    core = _reduced(walked, skeleton)
    tops = spark.createDataFrame([(r[0], r[3]) for r in core], "parent_skeleton int, _parent bigint")
    done = walked.filter(F.col("kind") == NODE)
    # one row for each skeleton node
    done = done.join(F.broadcast(tops), "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    shared = spark.createDataFrame(
        [(r[0], r[3], r[2], *r[4:9]) for r in core if not r[9]], "skeleton int, " + ", ".join(f"{c} bigint" for c in columns)
    )
    shared = shared.join(_id_lists(walked), "skeleton", "left").select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return done.select(*columns, F.col("ends").alias("ends_sha256")).unionByName(shared)


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """One row for each distinct sequence of first turns (role and text) that conversations share.

    ``conv_id`` is the node's smallest conversation, and with ``depth`` its
    name; ``parent_conv_id`` that of its parent (root: null).  ``n_convs``
    counts the conversations that start with it, ``n_children`` its children,
    ``n_leaves`` the nodes without children in its subtree, itself included;
    ``saved_tokens`` is summed over the subtree: (n_convs - 1) times the words
    of a node's last text, which a shared prefix need not process again.
    ``ends_sha256`` hashes the decimal ids of the conversations that end here,
    ascending and joined by commas.

    Null roles and texts count as empty, null turns come first, repeated rows
    are turns of their own, rows without conversation id are left out, other
    columns too, whatever their names.  An empty table has no conversation
    and so no node, not even a root.  Ids are whole numbers.  Turns are
    compared by 128 bits of SHA-256.  ``size``: turns of a segment, which
    changes no result.
    """
    turns = numbered_turns(conversations, conv, turn, role, text)
    return trie_nodes(turns, turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")), size)
