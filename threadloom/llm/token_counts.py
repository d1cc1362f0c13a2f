"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from threadloom.llm.common import Memo, map_texts

# The split pattern of byte-level BPE; white space as Unicode defines it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Added to the count of a piece that cannot be counted apart from its neighbours.
UNSURE = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take code points from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-rank adjacent pair is merged until none has a rank.

    Symbols form a linked list; a heap holds the pairs by (rank, place).  A
    popped pair that is no longer there is skipped.  No token ids are made.
    """
    n = left = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        alive[j] = False
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, k))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, i))
    return left


class Counter:
    """Counts tokens of texts with the merges of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(PIECES)
        self.symbol = dict(enumerate(byte_symbols()))
        self.pieces = Memo(self.piece)
        self.first = Memo(self.chunk)
        self.spaced = Memo(self.spaced_chunk)

    def piece(self, piece: str) -> int:
        return merged_length([*piece.encode().decode("latin-1").translate(self.symbol)], self.ranks)

    def chunk(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split.findall(text)))

    def spaced_chunk(self, text: str) -> int:
        """Tokens of a space and ``text``.

        A token may start at any space after a character that is no space, so
        such chunks are counted each on its own.  A chunk that starts with
        more white space may belong to what stands before.
        """
        return UNSURE if not text or text[0].isspace() else self.chunk(" " + text)

    def plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        n = self.first[first] + sum(map(self.spaced.__getitem__, rest))
        return n if n < UNSURE else self.chunk(text)

    def count(self, text: str) -> int:
        """Tokens of a text; a special string in it is one token."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row, in one pass without a shuffle.

    ``path`` names a byte-level BPE file (JSON) that every worker can read.
    The count is the number of initial symbols (bytes) less the merges.  Null
    counts as an empty text (0 tokens); a null key stays null; repeated rows
    are counted each; other columns are not returned.  A text of any length
    is counted whole.
    """

    def make():
        count = counter(path).count

        def work(texts: list[str]) -> dict:
            tokens = list(map(count, texts))
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return work

    return map_texts(docs, make, "n_bytes bigint, n_tokens bigint, over_limit boolean", text, key)
