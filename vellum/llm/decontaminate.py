"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers, names and units turn into typed placeholders, other words are lower-cased. Windows of
canonical tokens of the benchmark are indexed by hash, and every document's windows are looked up in that index, so a question whose numbers
or names were exchanged still meets its original. Matched windows on one diagonal form runs; in a run the slots must be consistent: equal
values of the item stand for equal values in the document and different ones for different ones; where they don't, only windows whose values
are those of the item count. The benchmark is taken in blocks of a fixed
number of items; a block's index has a bounded size and goes to all executors, and every document meets every block.
"""

from __future__ import annotations

import re
import string
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import in_slices, small_batches, table
from vellum.llm.names import GIVEN_NAMES

WINDOW = 8
#: A window needs so many tokens that aren't placeholders.
LITERALS = 3
#: An item is found where consistent runs cover so many of its tokens, or 80 % of a shorter item. Items with fewer than 4 tokens say nothing.
ENOUGH, SHARE, LEAST = 13, 0.8, 4
#: Characters of the items of one index, which takes about ten bytes for each in a worker: a pass over the documents serves as many.
BLOCK_CHARS = 5_000_000
#: Entries and characters of a worker's memory of words.
MEMORY, MEMORY_CHARS = 200_000, 4_000_000

#: Units, as they stand after a number.
UNITS = set(
    "% mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ton tons l ml liter liters litre litres"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent mph kmh".split()
)
#: Number words.
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())

TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+|%")
CAP, STOP, NUMBER, UNIT, GIVEN = 1, 2, 4, 8, 16
PLACE = {NUMBER: 1, UNIT: 2, CAP: 3}
MEANING = dict.fromkeys(GIVEN_NAMES, GIVEN) | dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUMBER)
#: Signs that may stand around a word, that may follow the end of a sentence, and that end one.
AROUND, CLOSING, ENDS = string.punctuation.replace("%", "") + "“”„‘’«»…", "\"'”’»)]*_", tuple(".!?:…")
hashed = xxhash.xxh64_intdigest
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Codes of white-space delimited words; tables give a code's tokens: where they begin, how many there are, their hashes and flags."""

    def __init__(self) -> None:
        super().__init__()
        self.start, self.count, self.value, self.flags = array("q"), array("q"), array("Q"), array("B")
        self.chars = 0
        self.again = np.zeros(1 << 16, bool)

    def __missing__(self, word: str) -> int:
        bare = word.strip(AROUND)
        if bare.isalpha():  # one token, as most words are: what follows says the same of it
            low = bare.lower()
            flags = MEANING.get(low, 0)
            if bare[0].isupper() and not bare.isupper():
                flags |= CAP
            else:
                flags &= ~GIVEN
            if bare != word and word.rstrip(CLOSING)[-1:] in ENDS:
                flags |= STOP
            code = len(self.start)
            self.start.append(len(self.value))
            self.count.append(1)
            self.value.append(hashed(low.encode("utf-8", "replace")))
            self.flags.append(flags)
            self[word] = code
            self.chars += len(word)
            return code
        tokens = TOKEN.findall(word)
        self.start.append(len(self.value))
        self.count.append(len(tokens))
        for token in tokens:
            low = token.lower()
            flags = MEANING.get(low, 0) or NUMBER * token[0].isdigit()
            if token[0].isupper() and not token.isupper():
                flags |= CAP
            else:
                flags &= ~GIVEN
            self.value.append(hashed(low.encode("utf-8", "replace")))
            self.flags.append(flags)
        if tokens and word.rstrip(CLOSING)[-1:] in ENDS:
            self.flags[-1] |= STOP
        self[word] = code = len(self.start) - 1
        self.chars += len(word)
        return code

    def forget(self) -> None:
        """Keeps the words that a later text had again since the last time, unless they fill half the memory by themselves."""
        kept = [w for w, again in zip(self, self.again.tolist(), strict=False) if again]
        held = sum(map(len, kept))
        if 2 * len(kept) > MEMORY or 2 * held > MEMORY_CHARS:
            kept, held = [], 0
        codes = np.fromiter(map(self.__getitem__, kept), np.int64, len(kept))
        count = np.frombuffer(self.count, np.int64)[codes]
        first = np.cumsum(count) - count
        at = np.repeat(np.frombuffer(self.start, np.int64)[codes] - first, count) + np.arange(int(count.sum()))
        tables = [first, count, np.frombuffer(self.value, np.uint64)[at], np.frombuffer(self.flags, np.uint8)[at]]
        self.clear()
        self.update(zip(kept, range(len(kept)), strict=True))
        self.chars = held
        self.again[:] = False
        for table, rows in zip((self.start, self.count, self.value, self.flags), tables, strict=True):
            del table[:]
            table.frombytes(rows.tobytes())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, flags, word): the tokens of a text's words, and which word each is of."""
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64)
        if len(self) >= MEMORY or self.chars >= MEMORY_CHARS:  # between texts, so that no code of this one is lost
            self.forget()
        known = len(self.start)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.again) < len(self.start):
            self.again = np.r_[self.again, np.zeros(len(self.start), bool)]
        self.again[codes[codes < known]] = True
        count = np.frombuffer(self.count, np.int64)[codes]
        word = np.repeat(np.arange(len(words)), count)
        if not len(word):
            return np.empty(0, np.uint64), np.empty(0, np.uint8), word
        inside = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.frombuffer(self.start, np.int64)[codes], count) + inside
        return np.frombuffer(self.value, np.uint64)[at], np.frombuffer(self.flags, np.uint8)[at], word


WORDS = Words()


def after(flag: np.ndarray) -> np.ndarray:
    """For each place whether the one before it has the flag."""
    out = np.zeros(len(flag), bool)
    out[1:] = flag[:-1]
    return out


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, word): canonical tokens (placeholders are 1 to 3), hashes of what stands there, and the index of the word it begins in.

    Number words and digits are numbers; a unit is one only after a number; a name is a capitalised word inside a sentence or a known given
    name, and neighbouring names inside a sentence are one.
    """
    value, flags, word = WORDS.of((text or "").split())
    if not len(value):
        return value, value, word
    number = flags & NUMBER > 0
    inside = flags & STOP == 0
    unit = after(number) & (flags & UNIT > 0)
    name = ((flags & CAP > 0) & after(inside) | (flags & GIVEN > 0)) & ~number & ~unit
    token = np.where(number, PLACE[NUMBER], np.where(unit, PLACE[UNIT], np.where(name, PLACE[CAP], value)))
    keep = np.flatnonzero(~(name & after(name & inside)))
    return token[keep].astype(np.uint64), np.add.reduceat(value, keep), word[keep]


def window_hashes(token: np.ndarray, size: int) -> np.ndarray:
    n = len(token) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * ODD + token[j : j + n]
    return h ^ (h >> np.uint64(29))


def windows_of(token: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """window_hashes of several sizes in one pass."""
    out, h = dict.fromkeys(sizes, np.empty(0, np.uint64)), token
    for size in range(1, min(len(token), max(sizes, default=0)) + 1):
        if size > 1:
            h = h[:-1] * ODD + token[size - 1 :]
        if size in sizes:
            out[size] = h ^ (h >> np.uint64(29))
    return out


def window_size(n: int) -> int:
    """Tokens of a window of an item of n: so few that one is left whole by as many exchanged words as a short item may have."""
    need = int(np.ceil(SHARE * n))
    return WINDOW if need > ENOUGH else int(np.ceil(need / (n - need + 1)))


class Index:
    """Windows of a block of items: for each window size, sorted hashes with item and position; windows poor in literals by their values."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        rows: dict[tuple[int, bool], list[tuple[int, int, int]]] = defaultdict(list)
        for k, (item, text) in enumerate(items):
            token, value, _ = canonical(text)
            if len(token) < LEAST:
                continue
            self.items[k] = (item, token, value)
            size = window_size(len(token))
            literal = np.convolve(token > 3, np.ones(size, int), "valid")
            for p, (h, v) in enumerate(zip(window_hashes(token, size).tolist(), window_hashes(value, size).tolist(), strict=True)):
                if literal[p] >= LITERALS:
                    rows[size, False].append((h, k, p))
                # the first word of a whole item may be taken for a name in a document, so the first window is also known by its values
                if literal[p] < LITERALS or p == 0:
                    rows[size, True].append((v, k, p))
        self.tables = {}
        for key, own in rows.items():
            own.sort()
            hashes = np.array([r[0] for r in own], np.uint64)
            there = np.zeros(1 << 20, bool)
            there[hashes >> np.uint64(44)] = True
            self.tables[key] = (hashes, there, np.array([r[1:] for r in own], np.int64))

    def find(self, text: str | None) -> list[tuple]:
        """Rows (item_id, coverage, tokens, first word, last word, places, exact) of a text, one for each item found in it."""
        token, value, word = canonical(text)
        diagonals: dict[tuple[int, int], list[tuple[int, int, bool]]] = defaultdict(list)
        hashed_windows = [windows_of(own, {size for size, is_raw in self.tables if is_raw == raw}) for raw, own in ((False, token), (True, value))]
        for (size, raw), (hashes, there, where) in self.tables.items():
            own = hashed_windows[raw][size]
            at = np.flatnonzero(there[own >> np.uint64(44)])
            low, high = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], "right")
            for d, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for k, p in where[a:b].tolist():
                    diagonals[k, d - p].append((p, size, raw))
        best: dict[int, tuple] = {}
        for (k, shift), windows in diagonals.items():
            item, its, was = self.items[k]
            covered = np.zeros(len(its), bool)
            run: list[tuple[int, int]] = []
            for p, size, raw in [*sorted(windows), (len(its) + WINDOW + 1, 0, True)]:
                if raw:
                    if size and np.array_equal(was[p : p + size], value[p + shift : p + shift + size]):
                        covered[p : p + size] = True
                    if size:
                        continue
                if run and p > run[-1][0] + run[-1][1]:
                    a, b = run[0][0], run[-1][0] + run[-1][1]
                    # a name before or after the passage may have merged with its first or last slot
                    for c, d in ((a, b), (a + 1, b), (a, b - 1), (a + 1, b - 1)):
                        if np.array_equal(its[c:d], token[c + shift : d + shift]) and consistent(its[c:d], was[c:d], value[c + shift : d + shift]):
                            covered[c:d] = True
                            break
                    else:
                        for c, d in literal_spans(was[a:b] == value[a + shift : b + shift], run[-1][1]):
                            covered[a + c : a + d] = True
                    run = []
                run.append((p, size))
            if covered.any():
                extend(covered, its, was, token, value, shift)
            n = int(covered.sum())
            if n and n >= min(ENOUGH, SHARE * len(its)):
                a, b = np.flatnonzero(covered)[[0, -1]].tolist()
                exact = bool((was[covered] == value[np.flatnonzero(covered) + shift]).all())
                before = best.get(k)
                row = (item, n / len(its), n, int(word[a + shift]), int(word[b + shift]), 1 + (before[5] if before else 0), exact)
                best[k] = row if before is None or row[2] > before[2] else (*before[:5], row[5], before[6])
        return list(best.values())


def consistent(token: np.ndarray, was: np.ndarray, now: np.ndarray) -> bool:
    """Whether the slots of one kind map one to one from the item's values to the document's."""
    for kind in PLACE.values():
        slots = token == kind
        pairs = set(zip(was[slots].tolist(), now[slots].tolist(), strict=True))
        if not len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
            return False
    return True


def extend(covered: np.ndarray, its: np.ndarray, was: np.ndarray, token: np.ndarray, value: np.ndarray, shift: int) -> None:
    """Adds to covered what matches beside it on the diagonal, over single mismatches: equal tokens, and slots that keep to the map of those
    covered. After a mismatch the next token has to be the same literally."""
    low, high = max(0, -shift), min(len(its), len(token) - shift)
    there, back = {}, {}
    for i in np.flatnonzero(covered & (its <= 3)).tolist():
        kind = int(its[i])
        there.setdefault((kind, int(was[i])), int(value[i + shift]))
        back.setdefault((kind, int(value[i + shift])), int(was[i]))
    for step in (1, -1):
        for start in np.flatnonzero(covered).tolist():
            i, missed = start + step, False
            while low <= i < high and not covered[i]:
                kind, a, b = int(its[i]), int(was[i]), int(value[i + shift])
                fits = a == b if missed or its[i] != token[i + shift] else kind > 3 or there.get((kind, a), b) == b and back.get((kind, b), a) == a
                if fits:
                    covered[i] = True
                    if kind <= 3 and its[i] == token[i + shift]:
                        there.setdefault((kind, a), b)
                        back.setdefault((kind, b), a)
                elif missed:
                    break
                missed = not fits
                i += step


def literal_spans(same: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where `size` or more neighbouring values are the same: they are a copy whatever the slots around them hold."""
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8))).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a >= size]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about BLOCK_CHARS characters; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        if r["text"]:
            block.append((r["item_id"], r["text"]))
            held += len(r["text"])
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


FOUND = "doc_id long, item_id long, coverage double, tokens int, start_char long, end_char long, places int, exact boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, coverage (share of the item's canonical tokens that
    consistent runs cover), tokens (how many), start_char and end_char (the span of the best place), places (how many there are), exact
    (no slot differs).

    Null and empty texts on either side match nothing; items of fewer than 4 tokens neither. Repeated documents and items give their own
    rows; a null id stays null. Empty tables give no rows. Other columns aren't read.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(spark)
    out = spark.createDataFrame([], FOUND)
    for block in blocks(benchmark):
        shipped = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in in_slices(batches):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if found := index.find(text):
                        spans = [m.span() for m in re.finditer(r"\S+", text)]
                        rows += [(doc, i, c, n, spans[a][0], spans[b][1], k, e) for i, c, n, a, b, k, e in found]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

        out = out.union(docs.mapInArrow(run, FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no item of the benchmark is found. Null and empty texts stay, repeated rows stay or go alike,
    ids aren't used; an empty benchmark leaves docs as they are."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in in_slices(batches):
                yield batch.filter(pa.array([not index.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated for all documents and the whole benchmark: a row for each document and item found in it."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
