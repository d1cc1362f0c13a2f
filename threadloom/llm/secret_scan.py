"""Secrets: known patterns, and password guess costs of values in credential context."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import map_texts, sha256, slices
from threadloom.session import cut_lineage

# The base patterns and the least length of what they match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "guess")

#: Names that mark a value as a credential: those of the base pattern and others, also as the end of a longer
#: name (dbPassword, user_token).  English words that end in "pass" are no names.
NAMES = (
    r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth"
    r"|(?<!com)(?<!by)(?<!tres)(?<!sur)(?<!over)(?<!under)pass)"
)
GAP = r"\n(?![\x20\t\r]*\n)"
#: What a value in quotes is, by group; the first that fits counts.  It ends at its closing quote, in any characters;
#: one quote that is not closed before an empty line is no quote.
QUOTED = (
    r'"""(.+?)"""',
    r"'''(.+?)'''",
    r'""([^"\s,;:)\]}>][^"]*+)""',
    rf'"((?:[^"\\\n]|\\.|""(?=\w)|{GAP})*+)"',
    rf"'((?:[^'\\\n]|\\.|''(?=\w)|(?<=[a-z])'(?=(?:s|t|re|ve|ll|d|m)\b)|{GAP})*+)'",
    rf"`((?:[^`\n]|{GAP})*+)`",
    rf"“((?:[^“”\n]|{GAP})*+)”",
    rf"„((?:[^„“”\n]|{GAP})*+)[“”]",
    rf"‘((?:[^‘’\n]|{GAP})*+)’",
    rf"«((?:[^«»\n]|{GAP})*+)»",
)
#: A value without quotes ends at white space.
BARE = r"""["'`“„‘«]?([^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+)"""
CONTEXT = rf"""{NAMES}["']?[\x20\t]*(?::=|=>|={{1,3}}|:)[\x20\t]*(?:(?:[bfru@$]{{1,2}}(?=["']))?(?:{"|".join(QUOTED)})|{BARE})"""
#: Signs behind a value without quotes that do not belong to it.
AFTER = "\"'`,;.)]}>”’»"

# Common parts of passwords, most frequent first.
WORDS = (
    "password pass admin welcome letmein login master hello monkey dragon qwerty football baseball sunshine shadow princess "
    "superman batman trustno iloveyou love secret freedom whatever michael jordan charlie summer winter spring autumn test "
    "guest root user changeme default server system access token key example sample company office monday friday january "
    "october december pepper ginger cookie banana orange purple flower soccer hockey tiger killer ranger hunter star money "
    "the and you for that with this not from one all new old red blue green black white"
).split()
# Short names that stand in program code and in no list of words.
CODE_WORDS = (
    "api args auth aws cfg cli config conn creds ctx db dotenv dst env environ fetch func gcp getenv headers http https init "
    "json jwt kwargs len obj os param params pwd req res settings sql src ssh std str sys tls tmp tokens uri url utils uuid yaml"
).split()
# Function words: text that has them reads as a sentence.
FUNCTION_WORDS = frozenset(
    "a an and are as at be been but by can do for from has have if in into is it its may must no not of on or our see should "
    "so that the their then there this to use was we were when which will with you your "
    "aus bei das dem den der des die ein eine für im ist mit nicht oder und von wird zu "
    "au aux avec dans de des du en est et la le les pas pour sur un une con del el los las no para por que se sin su".split()
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301$57", "aaeoisst")
DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d"
)

RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words of the corpus that join the dictionary: the most frequent ones (about 1 MB for each task), in so many documents at least.
CORPUS_WORDS = 50_000
LEAST_DOCS = 3
LONGEST_WORD = 30
#: A word by itself, not right behind an assignment or a quote, where a value would begin.
PLAIN_WORD = r"""(?<![\p{L}\p{N}_=:"'“„‘«`]|[=:]\s)\p{L}{3,%d}(?![\p{L}\p{N}_])""" % LONGEST_WORD
#: Words of a public vocabulary, most frequent first.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
JOINS = frozenset(" -_./")
STEP = {(a, b) for row in ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:], strict=False)}
#: Guesses of a new part cost as much as two alternatives.
PART = 1.0
ANY = math.log2(95)


def alphabet(value: str) -> float:
    """Bits a guesser needs for a character of ``value``."""
    lower, upper, digits = (re.search(p, value) is not None for p in ("[a-z]", "[A-Z]", "[0-9]"))
    if digits and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 4.0
    n = 26 * lower + 26 * upper + 10 * digits + 33 * (re.search(r"[^A-Za-z0-9]", value) is not None)
    return math.log2(max(n, 2))


def vocabulary_words(path: str) -> list[str]:
    """The whole words of a public word-piece vocabulary, in its order."""
    with open(path, encoding="utf-8") as f:
        places = json.load(f)["model"]["vocab"]
    ends = (w[:-4] for w in sorted(places, key=places.get) if w.endswith("</w>"))
    return [w for w in ends if 3 <= len(w) <= LONGEST_WORD and w.isalpha()]


def corpus_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The words that stand in most documents, most frequent first, ties by the word; at most ``CORPUS_WORDS``.

    The least number of documents is the lowest that no more words than that
    reach, so words with equal numbers are in or out together and only these
    words reach the driver.

    Words are counted over all documents, once in each, by Spark.  What stands
    where a value begins isn't counted, so a secret with many copies doesn't
    become a word.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(docs[text]), F.lit(PLAIN_WORD), F.lit(0)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    counts = cut_lineage(counts)
    # a row per number of documents
    above = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", above).filter(F.col("above") <= CORPUS_WORDS).agg(F.min("n")).first()[0]
    if least is None:
        return []
    return [r["word"] for r in counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()]


def ranked(*lists: Iterable[str]) -> dict[str, int]:
    """Guess number of each word: common parts of passwords, then the lists in turn, a word of each at a time."""
    ranks = dict(RANK)
    for words in lists:
        for place, word in enumerate(words, 1):
            rank = len(RANK) + len(lists) * place
            if ranks.get(word, rank + 1) > rank:
                ranks[word] = rank
    return ranks


def guess_bits(value: str, ranks: Mapping[str, int] = RANK) -> float:
    """log2 of the guesses for ``value`` when it is cut at the least cost.

    ``best[j]`` is the least cost of the first j characters: the last part is
    a word (rank, capitals, look-alike signs), a date, one repeated character,
    a walk along the keyboard or alphabet, a sign that joins words, or brute
    force.  ``ranks`` gives the guess number of words.  The work grows
    with the length only: words and dates are short, and runs are taken from
    where they start.
    """
    n, bits = len(value), alphabet(value)
    low = value.lower()
    plain = low.translate(LEET)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i] in "0123" and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
            if m.end() - i > 4 and value[i : i + 2] in ("19", "20") and value[i + 2 : i + 4].isdigit():
                dates.setdefault(i + 4, []).append(i)
    best, force = [0.0] + [math.inf] * n, math.inf
    repeat_from = walk_from = 0
    for j in range(1, n + 1):
        c = low[j - 1]
        if j > 1:
            repeat_from = repeat_from if value[j - 1] == value[j - 2] else j - 1
            walk_from = walk_from if (low[j - 2], c) in STEP else j - 1
        force = min(force, best[j - 1] + PART) + bits
        cost = force
        if j - repeat_from >= 3:
            cost = min(cost, best[repeat_from] + PART + bits + math.log2(j - repeat_from))
        if j - walk_from >= 3:
            cost = min(cost, best[walk_from] + PART + math.log2(len(ROWS) * 20) + math.log2(j - walk_from))
        if value[j - 1] in JOINS:
            cost = min(cost, best[j - 1] + 2 * PART)
        for k in range(3, min(j, LONGEST_WORD) + 1):
            rank = ranks.get(low[j - k : j]) or 2 * ranks.get(plain[j - k : j], 0)
            if rank:
                changed = 0 if value[j - k : j].islower() else 1 + (not value[j - k : j].istitle())
                cost = min(cost, best[j - k] + PART + math.log2(rank) + changed)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + PART + math.log2(365 * 120 if j - i > 4 else 200))
        best[j] = cost
    return best[n]


def value_of(m: re.Match) -> tuple[int, int]:
    """Start and end of the value that a match of ``CONTEXT`` found."""
    start, end = m.span(m.lastindex)
    if m.lastindex == m.re.groups:
        end = start + len(m[m.lastindex].rstrip(AFTER))
    return start, end


#: Names joined as in program code; a called or indexed one goes on with a bracket.
PATH = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*", re.ASCII)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A place for a value: ``${NAME}``, ``$NAME``, ``{{ name }}``, ``<your name>``, ``%(name)s``.
PLACE = re.compile(r"\$?\{+\s*([\w.]+)\s*\}*|\$(\w+)|<([\w\s.-]+)>?|%\((\w+)\)?s?", re.ASCII)
LITERAL = re.compile(r""""([^"\n]*)"|'([^'\n]*)'""")
CONSTANT = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
SENTENCE_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Scanner:
    def __init__(self, least_bits: float, ranks: Mapping[str, int] = RANK) -> None:
        self.least_bits = least_bits
        self.ranks = ranks
        self.code_words = frozenset(CODE_WORDS)
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.context = re.compile(CONTEXT, re.IGNORECASE | re.ASCII | re.DOTALL)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])  # a whole run or nothing, as the base pattern has it

    def known(self, word: str) -> bool:
        """Whether ``word`` is in the dictionary, or two words of it in one."""
        word = word.lower()
        if word in self.ranks or word in self.code_words:
            return True
        return any(word[:k] in self.ranks and word[k:] in self.ranks for k in range(3, min(len(word), LONGEST_WORD) - 2))

    def names(self, path: str) -> bool:
        """Whether names consist of words, with short numbers or letters between."""
        parts = NAME_PART.findall(path)
        return any(len(p) > 2 and self.known(p) for p in parts) and all(len(p) < 3 or (p.isalpha() and self.known(p)) for p in parts)

    def sentence(self, value: str) -> bool:
        """Whether ``value`` reads as text: four known words or more, a function word among any four on average."""
        words = value.split()
        bare = [w.strip(".,;:!?()\"'") for w in words]
        if len(words) < 4 or 4 * sum(w.lower() in FUNCTION_WORDS for w in bare) < len(words):
            return False
        return all(SENTENCE_WORD.fullmatch(w) and (len(w) < 3 or all(map(self.known, re.split("['’-]", w)))) for w in bare)

    def expression(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """Where the arguments of the code at ``start`` lie, an empty range if it has none; None: it is no code.

        Code is a path of names that is called or indexed, a path with two
        names or more, or a place for a value.
        """
        value = text[start:end]
        if (m := PLACE.fullmatch(value)) and self.names(m[m.lastindex]):
            return end, end
        m = PATH.match(text, start)
        if not m:
            return None
        stop = m.end()
        # what is given a quoted literal is code, whatever its name
        given = text[stop : stop + 2] in ('("', "('", '["', "['") and not re.search("[0-9]", m[0])
        if not given and not self.names(m[0]):
            return None
        if stop >= end:
            return (end, end) if re.search(r"\.|::|->", value) else None
        if text[stop] not in "([":
            return None
        line = text.find("\n", stop)
        return stop, len(text) if line < 0 else line

    def literals(self, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Quoted arguments up to the bracket that closes the first, names of settings left out, that cost enough."""
        depth, at = 0, start
        while at < end:
            if m := LITERAL.match(text, at, end):
                span = m.span(m.lastindex)
                if not CONSTANT.fullmatch(m[m.lastindex]) and self.costly(m[m.lastindex]):
                    yield span
                at = m.end()
                continue
            depth += (text[at] in "([{") - (text[at] in ")]}")
            at += 1
            if depth == 0:
                return

    def costly(self, value: str) -> bool:
        return bool(value) and guess_bits(value, self.ranks) >= self.least_bits and not self.sentence(value)

    def values(self, text: str) -> Iterator[tuple[int, int]]:
        """``(start, end)`` of the values in credential context that cost enough guesses.

        Sentences and code are no values; the literals that code is given are.
        A cheap value is searched in turn: it may be the name of the next one.
        """
        at = 0
        while m := self.context.search(text, at):
            start, end = value_of(m)
            at = max(start, at + 1)
            if start >= end:
                continue
            if inside := self.expression(text, start, end):
                for span in self.literals(text, *inside):
                    yield span
                    at = max(at, span[1])
            elif self.costly(text[start:end]):
                yield start, end
                at = m.end()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in the order of start, then of ``KINDS``."""
        found: list[tuple[str, int, int]] = []
        if "=" in text or ":" in text:
            found += [("assign", m.start(), m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
            found += [("guess", *v) for v in self.values(text)]
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        found += [("hex", m.start(), m.end()) for m in self.hex.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    def redacted(self, text: str, mark: str) -> str:
        """``text`` with its secrets replaced; overlapping spans count as one.

        The base pattern may end inside a value; the rest goes with it, whatever its guesses cost.
        """
        spans = self.spans(text)
        if not spans:
            return text
        spans = [(kind, a, max(b, value_of(self.context.match(text, a))[1]) if kind == "assign" else b) for kind, a, b in spans]
        out, at = [], 0
        start, end = spans[0][1:]
        for _, a, b in [*spans[1:], ("", len(text) + 1, 0)]:
            if a < end:
                end = max(end, b)
                continue
            out += [text[at:start], mark]
            at, start, end = end, a, b
        return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def dictionary(docs: DataFrame, text: str, vocabulary: str | None) -> dict[str, int]:
    """Guess numbers of words: those of passwords, of a public vocabulary and of the documents."""
    return ranked(vocabulary_words(vocabulary) if vocabulary else (), corpus_words(docs, text))


def scan_secrets(
    docs: DataFrame, least_bits: float = 36.0, text: str = "text", key: str = "doc_id", vocabulary: str | None = VOCABULARY
) -> DataFrame:
    """``(key, n_assign, n_access, n_hex, n_guess, base_sha256, spans)`` of every row.

    The base patterns give spans of kind assign, access and hex (of the whole
    match, in code points, end exclusive).  A value in credential context, in
    quotes up to the closing quote and else up to white space, whose guesses
    cost ``least_bits`` or more is a span of kind guess, which overlaps a base
    span or stands alone.  Words cost what their place in the dictionary asks
    (``vocabulary`` is read on the driver, the documents' own words are counted
    by Spark).  Sentences, code and places for a value are no secrets, but
    literals that code is given may be.  Null counts as an empty text: no
    spans, and the digest of an empty string.  A null key stays null, repeated
    rows are scanned each, other columns are not returned.
    """

    ranks = dictionary(docs, text, vocabulary)

    def make():
        scanner = Scanner(least_bits, ranks)

        def work(texts: list[str]) -> dict:
            spans = [scanner.spans(t) for t in texts]
            out = {f"n_{kind}": [sum(s[0] == kind for s in found) for found in spans] for kind in KINDS}
            base = [joined([s for s in found if s[0] != "guess"]) for found in spans]
            return out | {"base_sha256": list(map(sha256, base)), "spans": list(map(joined, spans))}

        return work

    schema = ", ".join(f"n_{kind} bigint" for kind in KINDS) + ", base_sha256 string, spans string"
    return map_texts(docs, make, schema, text, key)


def redact_secrets(
    docs: DataFrame, least_bits: float = 36.0, mark: str = "[SECRET]", text: str = "text", vocabulary: str | None = VOCABULARY
) -> DataFrame:
    """The same rows and columns; every span that ``scan_secrets`` finds in ``text`` is replaced by ``mark``.

    A base match is replaced with the whole value it begins.
    ``n_chars``, where there is such a column, becomes the new length.  Null
    and empty texts stay, as do equal rows, each redacted by itself; an empty
    table stays empty.
    """
    ranks = dictionary(docs, text, vocabulary)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least_bits, ranks)
        for batch in slices(batches):
            new = [t and scanner.redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length(text), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
