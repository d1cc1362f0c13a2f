"""Byte windows that occur twice or more anywhere in the corpus, by depth-limited radix sort.

The suffixes of all texts are ordered only through their first ``width``
bytes (a window), by most-significant-digit passes that let go of every
suffix that stands alone; what is still together after the last digit is
exactly the repeated windows.

Two digits come before the literal ones, so that one record stands for many
suffixes.  The first is the *mark*: of the half-width grams inside a window,
the one with the smallest fingerprint, and its offset.  Neighbouring windows
mostly share their mark, and such a *block* is one record.  Windows are equal
only if their marks are, so a mark met once ends its whole block.  The second
digit is the content of the block: blocks met twice are repeated windows
throughout.  Only blocks whose mark stands in different surroundings go on,
as bytes: their windows are sorted by offset and then by eight literal bytes
a pass, in the task that holds all blocks of the mark.  Marks with more than
``crowd`` different blocks are not gathered: two more digits, compared by
128-bit digests, split their windows into pieces of ``PIECE`` neighbours, the
bytes that all windows of a piece share and then all bytes of the piece.  A
piece met twice is repeated throughout, one that shares its first digit with
no other ends there, and only windows of the remaining ones are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import passes
from threadloom.session import cut_lineage

WIDTH = 200
#: Different blocks of a mark that one task may gather.
CROWD = 512
#: Bytes that one step of a task holds: blocks of whole marks.
STEP_BYTES = 1 << 21
#: Bytes of texts whose blocks a task finds at once: some arrays with eight bytes for each stay in a core's cache.
TEXT_BYTES = 1 << 18
#: Windows of a piece of a block whose mark is crowded.
PIECE = 8
#: Rows of windows compared at once with the smallest fingerprint.
LOOKUP_ROWS = 4_096

LETTERS = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_prints(data: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every gram of ``size`` bytes, from those of its two halves."""
    prints, step = LETTERS[data], 1
    while 2 * step <= size:
        prints, step = _mixed(prints[:-step], prints[step:]), 2 * step
    return prints if step == size else _mixed(prints[: len(prints) - (size - step)], prints[size - step :])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while 2 * step <= size:
        values, step = np.minimum(values[:-step], values[step:]), 2 * step
    return values if step == size else np.minimum(values[: len(values) - (size - step)], values[size - step :])


class Blocks:
    """The blocks of some texts: windows ``first`` to ``last`` of ``data`` have their mark at ``mark``.

    ``name`` is the fingerprint of a block's bytes and the place of its mark,
    ``gram`` that of its mark.
    """

    def __init__(self, texts: list[bytes], width: int) -> None:
        half, lengths = (width + 1) // 2, np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        n, inside = len(self.data) - width + 1, width - half + 1
        if n < 1:
            self.first = self.last = self.mark = self.text = np.zeros(0, np.int64)
            self.gram = self.name = np.zeros(0, np.int64)
            return
        grams = gram_prints(self.data, half)
        least = sliding_min(grams, inside)
        # windows that cross texts are none
        valid = np.ones(n, bool)
        for end in self.begins[1:-1].tolist():
            valid[max(0, end - width + 1) : end] = False
        new = np.ones(n + 1, bool)
        new[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        new[self.begins[:-1][self.begins[:-1] < n]] = True
        edges = np.flatnonzero(new)
        first, last = edges[:-1], edges[1:] - 1
        first, last = first[valid[first]], last[valid[first]]
        view = np.lib.stride_tricks.sliding_window_view(grams, inside)

        def marks(at: np.ndarray) -> np.ndarray:
            parts = [at[k : k + LOOKUP_ROWS] for k in range(0, len(at), LOOKUP_ROWS)]
            return np.concatenate([p + (view[p] == least[p, None]).argmax(1) for p in parts]) if parts else at

        mark = marks(first)
        # the same fingerprint again, further on: those windows have a later mark
        tied = np.flatnonzero(last > mark)
        if len(tied):
            more = np.concatenate([np.arange(mark[k] + 1, last[k] + 1) for k in tied.tolist()])
            owner = np.repeat(tied, last[tied] - mark[tied])
            later = marks(more)
            cut = np.flatnonzero(np.concatenate([[True], (later[1:] != later[:-1]) | (owner[1:] != owner[:-1])]))
            last = np.concatenate([np.minimum(last, mark), more[np.append(cut[1:], len(more)) - 1]])
            first, mark = np.concatenate([first, more[cut]]), np.concatenate([mark, later[cut]])
        rest = width - half
        ends = _mixed(_mixed(grams[first], grams[first + rest]), _mixed(grams[last], grams[last + rest]))
        shape = ((mark - first) << 32 | (last - first)).astype(np.uint64)
        self.first, self.last, self.mark = first, last, mark
        self.gram, self.name = grams[mark].view(np.int64), _mixed(ends, shape).view(np.int64)
        self.text = np.searchsorted(self.begins, first, side="right") - 1

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """One block of every kind in every text, and how many there are of it."""
        order = np.lexsort((self.name, self.gram, self.text))
        keys = [x[order] for x in (self.text, self.gram, self.name)]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(order) else order
        return order[new], np.diff(np.append(new, len(order)))


def equal_windows(data: np.ndarray, group: np.ndarray, offset: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which windows at ``at`` equal another of the same group and offset: radix passes over eight bytes each.

    A pass splits every bucket by the next digit and lets go of buckets with
    one member.
    """
    left, bucket = np.arange(len(at)), group
    view = np.lib.stride_tricks.sliding_window_view(data, min(8, width)) if len(data) >= 8 else data[None]
    places = [*range(0, width - 8, 8), max(0, width - 8)]
    for place in [None, *places]:
        digit = offset[left] if place is None else _big_endian(view[at[left] + place])
        order = np.lexsort((digit, bucket))
        one, two = bucket[order], digit[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        number = np.cumsum(new) - 1
        stay = np.bincount(number)[number] > 1
        left, bucket = left[order[stay]], number[stay]
        if not len(left):
            break
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


def _big_endian(rows: np.ndarray) -> np.ndarray:
    if rows.shape[1] < 8:
        rows = np.pad(rows, ((0, 0), (0, 8 - rows.shape[1])))
    return np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches whose texts have about ``TEXT_BYTES``, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + TEXT_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _block_rows(texts: DataFrame, width: int, known: Callable | None = None) -> DataFrame:
    """``(rid, gram, name, n)``: the kinds of blocks of every text; with ``known`` only those whose gram passes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            blocks = Blocks([t.encode() for t in batch.column("text").to_pylist()], width)
            one, n = blocks.kinds()
            if known is not None:
                stay = known(blocks.gram[one])
                one, n = one[stay], n[stay]
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[blocks.text[one]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, blocks.gram[one], blocks.name[one], n)], ["rid", "gram", "name", "n"])

    return texts.select("rid", "text").mapInArrow(run, "rid bigint, gram bigint, name bigint, n bigint")


def _region_rows(asked: DataFrame, width: int) -> DataFrame:
    """``(gram, name, rid, lone, crowded, lead, windows, bytes)`` of the blocks that a text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            blocks = Blocks([t.encode() for t in batch.column("text").to_pylist()], width)
            one, _ = blocks.kinds()
            place = {key: k for k, key in zip(one.tolist(), zip(blocks.text[one].tolist(), blocks.gram[one].tolist(), blocks.name[one].tolist(), strict=True), strict=True)}
            rows = []
            for t, (rid, asks) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("asks").to_pylist(), strict=True)):
                for a in asks or ():
                    k = place.get((t, a["gram"], a["name"]))
                    if k is not None:  # another text may have the same row number
                        first, last = int(blocks.first[k]), int(blocks.last[k])
                        rows.append((a["gram"], a["name"], rid, a["lone"], a["crowded"], int(blocks.mark[k]) - first, last - first + 1, blocks.data[first : last + width].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, REGION, strict=True)], schema=REGION)

    return asked.filter(F.size("asks") > 0).select("rid", "text", "asks").mapInArrow(
        run, "gram bigint, name bigint, rid bigint, lone boolean, crowded boolean, lead int, windows int, bytes binary"
    )


REGION = pa.schema(
    [
        ("gram", pa.int64()), ("name", pa.int64()), ("rid", pa.int64()), ("lone", pa.bool_()), ("crowded", pa.bool_()),
        ("lead", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary()),
    ]
)
FOUND = "rid bigint, gram bigint, name bigint, places array<int>"


def _sorted_regions(regions: DataFrame, width: int) -> DataFrame:
    """``(rid, gram, name, places)``: windows of lone blocks that occur in another block of the same mark."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        begins = np.cumsum([0, *(len(r[6]) for r in rows)])[:-1]
        windows = np.array([r[5] for r in rows], np.int64)
        block = np.repeat(np.arange(len(rows)), windows)
        step = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = np.unique([r[0] for r in rows], return_inverse=True)[1][block]
        offset = np.array([r[4] for r in rows], np.int64)[block] - step
        again = equal_windows(data, group, offset, begins[block] + step, width)
        out, cut = [], np.cumsum(windows) - windows
        for k, r in enumerate(rows):
            if r[3] and len(places := np.flatnonzero(again[cut[k] : cut[k] + windows[k]])):
                out.append((r[2], r[0], r[1], places.tolist()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.list_(pa.int32())], strict=True)], ["rid", "gram", "name", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "rid", "lone", "lead", "windows", "bytes")), strict=True):
                if row[:2] == last:  # the same block from copies of its text
                    continue
                if size > STEP_BYTES and row[0] != last[0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[6]), row[:2]
        if held:
            yield sort(held)

    rows = regions.filter(~F.col("crowded")).drop("crowded")
    return rows.repartition("gram").sortWithinPartitions("gram", "name").mapInArrow(run, FOUND)


def _pieces(regions: DataFrame, width: int) -> DataFrame:
    """``(core, whole, gram, name, rid, lone, place, windows, bytes)``: blocks cut where the offset of their mark is a multiple of ``PIECE``.

    ``core`` is the digest of the bytes that windows with the piece's offsets
    share, also if the block has only some of them; ``whole`` that of all
    bytes of the piece, and which offsets it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for gram, name, rid, lone, lead, windows, data in zip(*(batch.column(f.name).to_pylist() for f in PIECES_OF), strict=True):
                k = 0
                while k < windows:
                    offset = lead - k  # of the mark in window k, falling by one a window
                    low = offset - offset % PIECE
                    end = min(windows, lead - low + 1)
                    # the first window that any block may have here starts low + PIECE - 1 before the mark, the last one low before it
                    core = data[lead - low : max(lead - low, lead - low - PIECE + 1 + width)]
                    piece = data[k : end - 1 + width]
                    head = gram.to_bytes(8, "big", signed=True) + low.to_bytes(4, "big")
                    whole = xxhash.xxh3_128_digest(head + offset.to_bytes(4, "big") + (end - k).to_bytes(4, "big") + piece)
                    rows.append((xxhash.xxh3_128_digest(head + core), whole, gram, name, rid, lone, k, end - k, piece))
                    k = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 9, PIECES, strict=True)], schema=PIECES)

    one = regions.filter("crowded").dropDuplicates(["gram", "name"]).select([f.name for f in PIECES_OF])
    return one.mapInArrow(run, "core binary, whole binary, gram bigint, name bigint, rid bigint, lone boolean, place int, windows int, bytes binary")


PIECES_OF = [REGION.field(f) for f in ("gram", "name", "rid", "lone", "lead", "windows", "bytes")]
PIECES = pa.schema(
    [
        ("core", pa.binary()), ("whole", pa.binary()), ("gram", pa.int64()), ("name", pa.int64()), ("rid", pa.int64()), ("lone", pa.bool_()),
        ("place", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary()),
    ]
)


def _piece_windows(pieces: DataFrame, width: int) -> DataFrame:
    """``(digest, gram, name, rid, lone, place)`` of the windows of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for gram, name, rid, lone, place, windows, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "rid", "lone", "place", "windows", "bytes")), strict=True):
                rows += [(xxhash.xxh3_128_digest(data[k : k + width]), gram, name, rid, lone, place + k) for k in range(windows)]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "gram", "name", "rid", "lone", "place"])

    return pieces.mapInArrow(run, "digest binary, gram bigint, name bigint, rid bigint, lone boolean, place int")


def _counted_regions(regions: DataFrame, width: int) -> DataFrame:
    """The same for marks with too many blocks to gather: pieces of blocks and then windows are counted by digest, wherever they are."""
    pieces = cut_lineage(_pieces(regions, width))
    one = F.min(F.struct("gram", "name", "rid", "lone", "place", "windows", "bytes"))
    kinds = cut_lineage(pieces.groupBy("core", "whole").agg(F.count("*").alias("n"), one.alias("one")))
    # pieces met twice
    again = pieces.filter("lone").drop("bytes").join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"])
    again = again.select("rid", "gram", "name", F.sequence("place", F.col("place") + F.col("windows") - 1).alias("places"))
    # what shares its core with other pieces: a piece that was met twice is judged, and only shown to the others
    mixed = kinds.groupBy("core").agg(F.count("*").alias("wholes")).filter("wholes > 1").select("core")
    shown = kinds.join(mixed, "core").select("one.*", "n").withColumn("lone", F.col("lone") & (F.col("n") == 1)).drop("n")
    windows = cut_lineage(_piece_windows(shown, width))
    twice = windows.groupBy("digest").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = windows.filter("lone").join(twice, "digest").select("rid", "gram", "name", F.array("place").alias("places"))
    return again.unionByName(found).groupBy("rid", "gram", "name").agg(F.flatten(F.collect_list("places")).alias("places"))


def _removed(texts: DataFrame, width: int) -> DataFrame:
    """``(hash, spans, kept_sha256)`` of texts with their repeated blocks (``whole``) and single windows (``parts``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            blocks = Blocks(raw, width)
            known = {}
            for t, (whole, parts) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                known |= {(t, w["gram"], w["name"]): None for w in whole or ()}
                known |= {(t, p["gram"], p["name"]): p["places"] for p in parts or ()}
            start = np.zeros(len(blocks.data) + 1, np.int32)
            for k, key in enumerate(zip(blocks.text.tolist(), blocks.gram.tolist(), blocks.name.tolist(), strict=True)):
                if key in known:
                    places = known[key]
                    if places is None:
                        start[blocks.first[k] : blocks.last[k] + 1] = 1
                    else:
                        start[blocks.first[k] + np.array(places)] = 1
            at = np.flatnonzero(start[:-1])
            ends = np.zeros(len(blocks.data) + 1, np.int32)
            ends[at] += 1
            ends[at + width] -= 1
            covered = np.cumsum(ends)[:-1] > 0
            spans, hashes = [], []
            for t in range(len(raw)):
                mine = covered[blocks.begins[t] : blocks.begins[t + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]).astype(np.int8))).reshape(-1, 2)
                spans.append([{"start": a, "length": b - a} for a, b in edges.tolist()])
                hashes.append(hashlib.sha256(np.frombuffer(raw[t], np.uint8)[~mine].tobytes()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(spans, kind), pa.array(hashes, pa.string())], ["hash", "spans", "kept_sha256"])

    return texts.select("hash", "text", "whole", "parts").mapInArrow(run, "hash string, spans array<struct<start: bigint, length: bigint>>, kept_sha256 string")


def repeated_spans(texts: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """``(hash, spans, kept_sha256)`` of the texts with repeated windows, by the SHA-256 of the text; ``texts`` is ``(hash, text)``."""
    texts = texts.filter(F.octet_length("text") >= width).withColumn("rid", F.xxhash64("text"))
    # first digit: marks that stand alone go
    marks = cut_lineage(_block_rows(texts, width).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"))
    rows = cut_lineage(_block_rows(texts, width, passes(marks, "gram")))
    # second digit: the whole block
    kinds = cut_lineage(rows.groupBy("gram", "name").agg(F.sum("n").alias("n"), F.min("rid").alias("rid")))
    crowds = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    again = kinds.filter("n > 1").select("gram", "name")
    whole = rows.select("rid", "gram", "name").join(again, ["gram", "name"])
    asks = kinds.join(crowds, "gram").select("rid", "gram", "name", (F.col("n") == 1).alias("lone"), (F.col("kinds") > crowd).alias("crowded"))
    both = whole.withColumn("lone", F.lit(None).cast("boolean")).withColumn("crowded", F.lit(None).cast("boolean")).unionByName(asks)
    # each list is as long as its text at most
    ask = F.when(F.col("lone").isNotNull(), F.struct("gram", "name", "lone", "crowded"))
    own = F.when(F.col("lone").isNull(), F.struct("gram", "name"))
    needs = cut_lineage(both.groupBy("rid").agg(F.collect_set(own).alias("whole"), F.collect_set(ask).alias("asks")))
    asked = cut_lineage(_among(texts.select("rid", "hash", "text"), passes(needs, "rid")).join(needs, "rid"))
    # literal digits, for blocks whose mark has other surroundings elsewhere
    regions = cut_lineage(_region_rows(asked, width))
    places = _sorted_regions(regions, width).unionByName(_counted_regions(regions, width))
    parts = places.groupBy("rid").agg(F.collect_list(F.struct("gram", "name", "places")).alias("parts"))
    found = _removed(asked.select("rid", "hash", "text", "whole").join(parts, "rid", "left"), width)
    return found.filter(F.size("spans") > 0).dropDuplicates(["hash"])


def _among(texts: DataFrame, known: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Texts whose number passes; copies that a task has met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for batch in batches:
            stay = known(batch.column("rid").to_numpy(zero_copy_only=False)).tolist()
            hashes = batch.column("hash").to_pylist()
            for k, h in enumerate(hashes):
                if stay[k] and h in met:
                    stay[k] = False
                elif stay[k]:
                    met.add(h)
            if len(met) > 1_000_000:  # forgetting only lets copies through
                met.clear()
            yield batch.filter(pa.array(stay, pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(F.sha2(body.cast("binary"), 256).alias("hash"), body.alias("text"))


def repeated_windows(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``(key, n_bytes, spans, kept_sha256)`` of each document.

    ``spans`` are the maximal stretches ``(start, length)`` of UTF-8 bytes
    that lie in some window of ``width`` bytes that also starts anywhere else,
    in the same document or another; windows may overlap and never cross
    documents, and are judged on the texts as given.  ``kept_sha256`` is the
    hash of the bytes outside of them, in order; ``without_repeats`` gives
    those bytes.

    A null text is empty; texts shorter than a window have no span.  Repeated
    rows, also of one key, are documents of their own, so a text of a window
    or more that occurs twice goes whole.  Null keys stay; an empty table
    gives no rows; other columns are left out.
    """
    if width < 2:
        raise ValueError("width must be 2 bytes at least")
    # written first, so that the join is between plain tables and Spark can split a text with many copies
    spans = cut_lineage(repeated_spans(_hashed(docs, text), width, crowd))
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key], F.sha2(body.cast("binary"), 256).alias("_hash"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, F.col("_hash") == F.col("hash"), "left").select(
        rows[key], "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "_hash").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``docs`` with the bytes outside of repeated windows in column ``text``, as binary, since cuts may split characters.

    Rows and cases as in ``repeated_windows``; all columns stay, null texts
    become empty.
    """
    name = "_" + "_".join(docs.columns)  # no given column has this name
    spans = cut_lineage(repeated_spans(_hashed(docs, text), width, crowd).select(F.col("hash").alias(name), F.col("spans").alias(f"{name}s")))
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.withColumns({text: body, name: F.sha2(body, 256)}).join(spans, name, "left")
    at = F.col(f"{name}s")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(at, lambda s: s.start + s.length))
    ends = F.concat(F.transform(at, lambda s: s.start), F.array(F.octet_length(text).cast("bigint")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.hex(F.substring(F.col(text), p.a.cast("int") + 1, (p.b - p.a).cast("int"))))
    kept = F.when(at.isNull(), F.col(text)).otherwise(F.unhex(F.array_join(pieces, "")))
    return rows.withColumn(text, kept).select(*docs.columns)
