"""License scans: MinHash bands over text windows retrieve templates, exact containment confirms them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache
from importlib.resources import files

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from threadloom.llm.common import Memo, map_texts
from threadloom.llm.decontaminate import words_of

# Wordings of common licenses, here single sentences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain."),
)


def gnu_notices(name: str, title: str, version: str, what: str) -> list[tuple[str, str]]:
    """The notice of a GNU license as its text proposes it, its core, and the form that names one version only."""
    core = f"under the terms of the {title} as published by the Free Software Foundation"
    either = f"either version {version} of the License, or (at your option) any later version."
    return [
        (name, f"{what} you can redistribute it and/or modify it {core}; {either}"),
        (name, f"{core}, either version {version} of the License"),
        (name, f"{core}; version {version} of the License"),
        (name, f"{core}, version {version}. {what[: what.index(' is')]} is distributed in the hope that it will be useful"),
        (name, f"under the terms of the {title} version {version} as published by the Free Software Foundation"),
        (name, f"licensed under the {title} version {version} or later"),
        (name, f"licensed under the {title} v{version}"),
        (name, f"SPDX-License-Identifier: {name}-only"),
        (name, f"SPDX-License-Identifier: {name}-or-later"),
    ]


PROGRAM, LIBRARY = "This program is free software:", "This library is free software;"
GPL, LESSER, AFFERO = (f"GNU {kind}General Public License" for kind in ("", "Lesser ", "Affero "))
CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))


def cc_notices(kind: str, title: str, version: str, port: str) -> list[tuple[str, str]]:
    """Notices, address and SPDX tag of a Creative Commons license, and the passage by which its text names itself."""
    if version == "3.0":
        title = title.replace("Derivatives", "Derivs")
    name, full = f"CC-{kind}-{version}", f"Creative Commons {title} {version} {port}"
    return [
        (name, f"is licensed under a {full} License."),
        (name, f"is licensed under the {full} License."),
        (name, f"licensed under CC {kind} {version}"),
        (name, f"licensed under {title} {version} {port}"),
        (name, f"creativecommons.org/licenses/{kind.lower()}/{version}"),
        (name, f"SPDX-License-Identifier: {name}"),
        *([(name, f"You accept and agree to be bound by the terms and conditions of this {full} Public License")] if version == "4.0" else []),
    ]


NOTICES = (
    *gnu_notices("GPL-1.0", GPL, "1", PROGRAM),
    *gnu_notices("GPL-2.0", GPL, "2", PROGRAM),
    *gnu_notices("GPL-3.0", GPL, "3", PROGRAM),
    *gnu_notices("LGPL-2.0", "GNU Library General Public License", "2", LIBRARY),
    *gnu_notices("LGPL-2.1", LESSER, "2.1", LIBRARY),
    *gnu_notices("LGPL-3.0", LESSER, "3", LIBRARY),
    *gnu_notices("LGPL-3.0", LESSER, "3", PROGRAM)[:1],
    *gnu_notices("AGPL-3.0", AFFERO, "3", PROGRAM),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MPL-1.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0")),
    *(n for kind, title in CC for version, port in (("4.0", "International"), ("3.0", "Unported")) for n in cc_notices(kind, title, version, port)),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
)
#: Whole texts, 120 to 5,200 words each, in the files of this folder.
WHOLE = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Zlib")
TEXTS = tuple((name, (files(__package__) / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")) for name in WHOLE)
ALL = TEMPLATES + NOTICES + TEXTS

SHINGLE = 5
#: Bands of one row each.  A window holds a template copy of containment 0.8 with a
#: Jaccard of 0.36 at least (see ``Index``), so all bands miss with a chance of 0.64 ** 24 = 2e-5.
BANDS = 24
#: Templates of fewer shingles stay beside a larger match that holds them.
LONG = 10
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.array([(0x9E3779B1 * (2 * k + 1) + 2 * k * k) | 1 for k in range(1, BANDS + 1)], np.uint64).astype(np.uint32)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One 32-bit hash of every ``size`` words; fewer words give none."""
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = (rolled ^ hashes[k : k + n]) * MIX
        rolled ^= rolled >> np.uint64(29)
    return (rolled >> np.uint64(32)).astype(np.uint32)


def band_values(shingles: np.ndarray, band: int) -> np.ndarray:
    """The band's hash of each shingle: multiply, fold, multiply."""
    x = shingles * FACTORS[band]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


class Index:
    """Templates by the length of the windows that look for them.

    A template of n shingles is sought with windows of L shingles, L the next
    power of two, a quarter of L apart.  Some window then holds the template
    whole or all but an eighth, and for n > L / 2 at a containment of 0.8 the
    Jaccard of the two is 0.8 n / (L + 0.2 n) > 0.36.
    """

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.names = [name for name, _ in templates]
        self.shingles: list[set[tuple]] = []
        by_window: dict[int, list[int]] = defaultdict(list)
        signatures: list[list[int]] = []
        for i, (name, text) in enumerate(templates):
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"the template of {name} has fewer than {SHINGLE} words")
            self.shingles.append({tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)})
            hashes = shingle_hashes(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
            signatures.append([int(band_values(hashes, b).min()) for b in range(BANDS)])
            by_window[1 << (len(words) - SHINGLE).bit_length()].append(i)
        #: by window length and band: which high halves occur, and the templates of each value
        self.levels = []
        for length, members in sorted(by_window.items()):
            bands = []
            for b in range(BANDS):
                maybe, exact = np.zeros(1 << 16, bool), defaultdict(list)
                for i in members:
                    maybe[signatures[i][b] >> 16] = True
                    exact[signatures[i][b]].append(i)
                bands.append((maybe, dict(exact)))
            self.levels.append((length, bands))

    def candidates(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """``(start, window length, template)`` of windows that agree with a template in a band."""
        found = set()
        longest = self.levels[-1][0]
        for b in range(BANDS):
            low = np.concatenate([band_values(shingles, b), np.full(longest, 0xFFFFFFFF, np.uint32)])
            width = 1
            for length, bands in self.levels:
                while width < length:  # minima of twice the length
                    low = np.minimum(low[:-width], low[width:])
                    width *= 2
                step = max(1, length // 4)
                minima = low[: len(shingles) : step]
                maybe, exact = bands[b]
                for k in np.flatnonzero(maybe[minima >> np.uint32(16)]):
                    found.update((int(k) * step, length, i) for i in exact.get(int(minima[k]), ()))
        return found

    def matches(self, words: list[bytes], found: list[tuple[int, int, int]], least: float) -> list[tuple[str, int, int]]:
        """``(name, first word, end)`` of the windows of one text that contain ``least`` of a template's shingles."""
        best: dict[int, list[tuple[int, int, set[int]]]] = defaultdict(list)
        for start, length, i in found:
            lo, hi = max(0, start - length), min(len(words) - SHINGLE + 1, start + 2 * length)
            at = [(k, s) for k in range(lo, hi) if (s := tuple(words[k : k + SHINGLE])) in self.shingles[i]]
            if len({s for _, s in at}) >= least * len(self.shingles[i]):
                best[i].append((at[0][0], at[-1][0] + SHINGLE, {k for k, _ in at}))
        whole = []
        for i, spans in best.items():
            spans.sort(key=lambda m: m[:2])
            own = [spans[0]]
            for a, b, places in spans[1:]:  # windows overlap: one match
                if a < own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]), own[-1][2] | places)
                else:
                    own.append((a, b, places))
            whole += [(i, *m) for m in own]
        kept = [m for m in whole if not self.rival(m, whole, words)]
        return sorted({(self.names[i], a, b) for i, a, b, _ in kept}, key=lambda m: (m[1], m[2], m[0]))

    def rival(self, match: tuple, others: list[tuple], words: list[bytes]) -> bool:
        """Whether a match with words changed lies in a larger one of another name: GPL in the notice of the LGPL."""
        i, _, _, places = match
        if len(self.shingles[i]) < LONG or len({tuple(words[k : k + SHINGLE]) for k in places}) == len(self.shingles[i]):
            return False
        return any(
            len(q) > len(places) and self.names[j] != self.names[i] and len(places & q) >= 0.8 * len(places) for j, _, _, q in others
        )


@lru_cache(1)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    """The index, made once by each worker process."""
    return Index(templates)


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = ALL, least: float = 0.8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(key, n_matches, licenses, spans)`` of every row, in one pass without a shuffle.

    ``licenses`` lists the names found, sorted and comma-joined; ``spans`` has
    ``name:start:end`` in words (end exclusive) in the order of the text.  A
    match contains ``least`` of a template's distinct shingles of five words.
    Licenses share wording: a match of a template of ``LONG`` shingles or more
    that is not complete is left out where a larger match of another name
    holds its words.

    Words are runs of ASCII letters (in either case), digits and non-ASCII
    characters.  Null, empty and short texts match nothing; null keys stay
    null; repeated rows are scanned each; other columns are not returned.
    """

    shared = docs.sparkSession.sparkContext.broadcast(tuple(templates))

    def make():
        index, memo = index_of(shared.value), Memo(xxhash.xxh3_64_intdigest)

        def work(texts: list[str]) -> dict:
            words = [words_of(t) for t in texts]
            ends = np.cumsum([0, *map(len, words)])
            hashes = np.fromiter((memo[w] for found in words for w in found), np.uint64, int(ends[-1]))
            by_text: dict[int, list] = defaultdict(list)
            for start, length, i in sorted(index.candidates(shingle_hashes(hashes))):
                # a window may begin before the text it finds a template in
                first, last = np.searchsorted(ends, [start, start + length], "right") - 1
                for d in range(int(first), min(int(last), len(words) - 1) + 1):
                    by_text[d].append((start - int(ends[d]), length, i))
            found = [index.matches(w, by_text[d], least) if d in by_text else [] for d, w in enumerate(words)]
            return {
                "n_matches": list(map(len, found)),
                "licenses": [",".join(sorted({m[0] for m in ms})) for ms in found],
                "spans": [",".join(f"{name}:{a}:{b}" for name, a, b in ms) for ms in found],
            }

        return work

    return map_texts(docs, make, "n_matches bigint, licenses string, spans string", text, key)
