"""Near-duplicates by bottom-k sketches, inverted lists of retained values and exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import LOWERED, MOST_BITS, Memo, slices, texts
from threadloom.operators.components import connected_components
from threadloom.session import cut_lineage

#: Smallest hashes that make a sketch.
SKETCH = 64
#: A value in more sketches than this is hot: other values find the pairs that share it.
HOT = 16
#: log of the chance (1e-9) that two sets at the threshold share no retained value.
MISS = 20.7
#: How far below the threshold an estimate may lie: six standard deviations of a share of 0.8 among 64.
SLACK = 0.3
#: Documents on each side of a block of exact comparisons.
BLOCK_DOCS = 128
#: Column of the ids that rows have while they are compared.
ROW = "_near_row"
#: Parts into which the members of a hot list are dealt where they are joined with a row of their list.
PARTS = 32

MIX, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(memo: Memo, text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of a text's shingles, from one hash function.

    A text of fewer words is one shingle; its length goes into the hash, so it
    equals no longer one.
    """
    words = text.encode().translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    rolled = np.full(n, size, np.uint64)
    for k in range(size):
        rolled = (rolled ^ hashes[k : k + n]) * MIX
        rolled ^= rolled >> np.uint64(32)
    rolled = (rolled * FINISH) >> np.uint64(1)
    rolled.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(rolled[1:], rolled[:-1], out=keep[1:])
    return rolled[keep].astype(np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """``(doc_id, n_shingles, digest, sketch)`` of every row; the digest tells equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        for batch in slices(batches):
            sets = [shingle_set(memo, t, size) for t in texts(batch, "_text")]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists_of([s[:SKETCH] for s in sets])],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, sketch array<bigint>")


def likely_among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``ids``, which saves shuffling them.

    A bit map of the ids' hashes, 16 bits an id and 32 MB at most in all, is
    broadcast in pieces of 4 KB.  It lets some others through, beyond some ten
    million ids more and more, so a join must follow.
    """
    bits, n = 1 << 15, ids.count()
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    spot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    piece, at = F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)
    pieces = ids.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_piece", piece).join(F.broadcast(pieces), "_piece")
    return met.filter(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select(rows.columns)


def full_sets(docs: DataFrame, classes: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """``(doc_id, shingles)`` of the texts that stand for ``classes`` (``id, digest``), from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        for batch in slices(batches):
            sets = [shingle_set(memo, t, size) for t in texts(batch, "_text")]
            # a key may have other texts too
            own = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column(2).to_pylist(), strict=True)]
            ids = batch.column(0).filter(pa.array(own, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, lists_of([s for s, o in zip(sets, own, strict=True) if o])], ["doc_id", "shingles"])

    wanted = cut_lineage(classes.select(F.col("id").alias("doc_id"), "digest"))
    source = likely_among(docs.select(docs[key].alias("doc_id"), docs[text].alias("_text")), wanted, "doc_id")
    source = source.join(wanted.hint("shuffle_hash"), "doc_id")
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def retained(classes: DataFrame) -> DataFrame:
    """``(value, id, n, hot)``: the values by which a class can be found.

    Sets with Jaccard 0.8 or more share one of the first ``n // 5 + 1`` values
    in *any* common order of all values; here cold values come first, each
    kind by hash.  Fewer do with a chance of missing below 1e-9: among cold
    values that are a share f of the set, the Jaccard is 1 - 0.2 / f at least.
    A class with too few cold values also keeps the first values whatever
    their kind, by which it meets others of its sort.
    """
    values = classes.select("id", F.explode("sketch").alias("value"))
    hot = values.groupBy("value").count().filter(F.col("count") > HOT).select("value")
    hot_of = values.join(hot, "value").groupBy("id").agg(F.collect_list("value").alias("hot"))
    cold = F.when(F.col("hot").isNull(), F.col("sketch")).otherwise(F.array_except("sketch", "hot"))
    seen = classes.join(hot_of, "id", "left").select("id", "n", "sketch", "hot", cold.alias("cold"))
    need = (F.floor(F.col("n") / 5) + 1).cast("int")
    share = F.size("cold") / F.size("sketch")
    likely = F.when(share > 0.2, F.ceil(F.lit(MISS) / F.log(share / 0.2))).otherwise(F.lit(1 << 30)).cast("int")
    take = F.least(need, likely)
    enough = F.size("cold") >= take
    first = F.slice("cold", F.lit(1), F.greatest(F.lit(1), F.least(take, F.size("cold"))))
    plain = F.slice("sketch", F.lit(1), F.least(need, F.lit(16)))
    picked = F.when(enough, first).otherwise(F.array_union(F.col("cold"), plain))
    listed = seen.select("id", "n", "hot", F.explode(picked).alias("value"))
    return listed.select("value", "id", "n", F.coalesce(F.array_contains("hot", F.col("value")), F.lit(False)).alias("hot"))


def close_sizes() -> Column:
    """Sets whose sizes differ more can't have the Jaccard (0.8 = 4 / 5)."""
    return 5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2")


def estimate() -> Column:
    """Share of the ``SKETCH`` smallest values of both sketches together that are in both."""
    union = F.slice(F.array_sort(F.array_union("sketch", "sketch2")), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, F.col("sketch")), F.col("sketch2"))) / F.size(union)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(id, id2)`` whose sketches don't speak against a Jaccard of 0.8."""
    one = classes.select("id", "sketch")
    two = classes.select(F.col("id").alias("id2"), F.col("sketch").alias("sketch2"))
    return pairs.join(one, "id").join(two, "id2").filter(estimate() >= 0.8 - SLACK).select("id", "id2")


def links(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs whose full sets have Jaccard 0.8 or more."""
    a = full.select(F.col("doc_id").alias("id"), F.col("shingles").alias("a"))
    b = full.select(F.col("doc_id").alias("id2"), F.col("shingles").alias("b"))
    both = pairs.join(a, "id").join(b, "id2")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * shared >= 80 * (F.size("a") + F.size("b") - shared)).select(F.col("id").alias("src"), F.col("id2").alias("dst"))


def ordered(pairs: DataFrame) -> DataFrame:
    """The pairs with the smaller id first; the same pair may come from many lists."""
    return pairs.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"))


def list_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of lists that have at most ``HOT`` members."""
    mates = lists.select("value", F.col("id").alias("id2"), F.col("n").alias("n2"))
    return ordered(lists.join(mates, "value").filter((F.col("id") < F.col("id2")) & close_sizes()))


def with_list_row(lists: DataFrame, once: DataFrame) -> DataFrame:
    """Members of hot lists with the columns of ``once``, which has one row a list.

    That row is copied ``PARTS`` times and each member meets one of the
    copies, so no task takes a whole list.
    """
    copies = once.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    return dealt.join(copies, ["value", "part"]).drop("part")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Every member of a list with one other.

    That one is drawn by a hash that lists share in four kinds, so that the
    lists of one group draw few different ones.
    """
    draw = F.xxhash64(F.col("id"), F.pmod(F.col("value"), F.lit(4)))
    centre = lists.groupBy("value").agg(F.min(F.struct(draw.alias("draw"), "id", "n")).alias("c"))
    centre = centre.select("value", F.col("c.id").alias("id2"), F.col("c.n").alias("n2"))
    return ordered(with_list_row(lists, centre).filter((F.col("id") != F.col("id2")) & close_sizes()))


def block_links(left: pa.Table) -> pa.Table:
    """Pairs of components that some stray and some member of a block link."""
    labels = left.column("label").to_pylist()
    sets = [np.asarray(x.values) for x in left.column("shingles").combine_chunks()]
    stray = [k for k, s in enumerate(left.column("stray").to_pylist()) if s]
    mate = [k for k, s in enumerate(left.column("stray").to_pylist()) if not s]
    src, dst = [], []
    if stray and mate:
        # only what both sides have can be shared
        common = np.intersect1d(np.unique(np.concatenate([sets[k] for k in stray])), np.unique(np.concatenate([sets[k] for k in mate])))

        def rows(part: list[int]) -> np.ndarray:
            out = np.zeros((len(part), len(common)), np.float32)
            for r, k in enumerate(part):
                at = np.searchsorted(common, sets[k])
                at = at[at < len(common)]
                own = sets[k][: len(at)]
                out[r, at[common[at] == own]] = 1
            return out

        shared = np.rint(rows(stray) @ rows(mate).T)
        sizes = np.array([len(s) for s in sets], float)
        linked = 100 * shared >= 80 * (sizes[stray][:, None] + sizes[mate][None, :] - shared)
        found = {(labels[stray[i]], labels[mate[j]]): None for i, j in zip(*np.nonzero(linked), strict=True)}
        src, dst = [a for a, b in found if a != b], [b for a, b in found if a != b]
    kind = left.schema.field("label").type
    return pa.table({"src": pa.array(src, kind), "dst": pa.array(dst, kind)})


def stray_links(lists: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs ``(src, dst)`` of components with linked members in one list.

    The component most of a list belongs to is its main one.  All members that
    meet in lists of one main component are a group, and those outside of it
    are its strays: they are compared with all of the group by full sets,
    ``BLOCK_DOCS`` against as many at a time.  A large group that is one
    component has few strays; blocks never hold more than their two sides.
    """
    parts = lists.groupBy("value", "label").agg(F.count("*").alias("m"))
    most = parts.groupBy("value").agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    met = with_list_row(lists, most.select("value", F.col("most.label").alias("main"))).select("main", "id", "label").distinct()
    met = cut_lineage(met.withColumn("stray", F.col("label") != F.col("main")))
    sides = met.groupBy("main").agg(F.count("*").alias("n"), F.sum(F.col("stray").cast("int")).alias("s"))
    sides = sides.select("main", F.ceil(F.col("n") / BLOCK_DOCS).cast("int").alias("n"), F.ceil(F.col("s") / BLOCK_DOCS).cast("int").alias("s"))
    dealt = met.join(sides, "main").withColumn("h", F.xxhash64("id"))
    place, row = F.pmod("h", "n").cast("int"), F.pmod("h", "s").cast("int")
    # each stray meets every block of members, each member every block of strays
    as_stray = dealt.filter("stray").select("main", "id", "label", "stray", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    as_mate = dealt.select("main", "id", "label", F.lit(False).alias("stray"), place.alias("place"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("row"))
    blocks = as_stray.unionByName(as_mate).join(full.withColumnRenamed("doc_id", "id"), "id")
    kind = lists.schema["id"].dataType.simpleString()
    return blocks.groupBy("main", "row", "place").applyInArrow(block_links, f"src {kind}, dst {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` of every row.

    A document's set has its distinct shingles of ``size`` words (ASCII white
    space parts words, A-Z count as a-z).  Documents whose sets have Jaccard
    0.8 or more are linked; ``component_id`` is the smallest key that can be
    reached, and ``kept`` tells that it is the row's own.

    Equal sets are one class.  Bottom-k sketches come from one hash function;
    inverted lists of retained values give the pairs of classes, the sketch of
    a pair's union filters them, and full sets confirm them (as 63-bit
    hashes).  Lists are not cut: in a hot one every member first meets one
    other, and members that are then not in the component of most are compared
    with all of them by full sets in blocks, which loses no component.

    Null, empty and wordless texts have an empty set and are linked with
    nothing.  Rows that share a key are one document: what one of them is
    linked with, all are.  A row without a key is its own document
    (``component_id`` null, ``kept`` true).  Other columns are not returned.
    """
    sets = cut_lineage(sketches(docs, size, text, key))
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut_lineage(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
        )
    )
    entries = cut_lineage(retained(classes))
    shared = entries.groupBy("value").count().filter(F.col("count") > 1).select("value")
    lists = cut_lineage(entries.join(shared, "value"))
    hot = lists.filter("hot").select("value", "id", "n")
    # a pair of a list that is not hot is compared; a hot list's members meet one of them, and what this leaves apart in blocks
    pairs = cut_lineage(likely(list_pairs(lists.filter("NOT hot")).union(star_pairs(hot)).distinct(), classes))
    asked = pairs.select(F.explode(F.array("id", "id2")).alias("id")).union(hot.select("id")).distinct()
    full = cut_lineage(full_sets(docs, classes.select("id", "digest").join(asked, "id"), size, text, key))
    # rows of one key with different texts
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b")
    own = known.join(twice.select("doc_id"), "doc_id").join(classes.select("digest", "id"), "digest").select("doc_id", "id")
    edges = own.join(own.groupBy("doc_id").agg(F.min("id").alias("dst")), "doc_id").select(F.col("id").alias("src"), "dst")
    components = connected_components(edges.union(links(pairs, full)))
    labelled = hot.join(components, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # components grow together over links of strays; a class that nothing was linked with is a component of its own
    grown = connected_components(stray_links(labelled, full)).select(F.col("id").alias("label"), F.col("label").alias("_top"))
    own_label = classes.select("digest", "id").join(components, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    by_class = own_label.join(grown, "label", "left").select("digest", F.coalesce("_top", "label").alias("component_id"))
    found = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(by_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        F.col("doc_id").alias(key),
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of near copies, with all its columns: the row with the smallest key.

    Rows are compared, not keys: each has its own id, so rows without a key
    or with a key that others have are searched and dropped like all.  Of
    rows with the same key the first counts, and null is the largest key.
    Wordless texts are linked with nothing and stay.
    """
    # the ids hold for all later readers because they are written down
    rows = cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = cut_lineage(near_duplicates(rows, size, text, ROW).select(ROW, "component_id"))
    # each row meets its key by its own id; the best of a component is found by partial minima, so no component is a hot key
    placed = found.select(ROW, "component_id").join(rows.select(ROW, F.col(key).alias("_key")), ROW)
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", ROW))
    best = placed.groupBy("component_id").agg(first.alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    gone = found.select(ROW).join(best, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").drop(ROW)
