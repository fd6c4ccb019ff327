"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are whole numbers up to the capacity, so the packing is planned on a histogram of lengths: `capacity` counts, however many
documents there are. Singles, pairs and triples of lengths are looked up by their sum; from the longest length down, combinations that fill
its gap exactly are consumed as often as the counts allow, and what no combination fills goes best-fit decreasing into the open gaps. The
plan is a list of patterns with multiplicities (its size depends on the capacity alone), and every piece finds its place by its rank among
the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import gapless_rank, in_slices, materialize, small_batches, table

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Entries of a worker's memory of space-delimited words; it starts anew when full.
MEMORY = 300_000
#: Longer words aren't remembered.
LONGEST = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes; remembers words that follow a space.

    Pre-tokens never cross a place where one space stands before a character that isn't white space, so a text's ids are those of its
    space-delimited words in turn, each with its space. Texts in which white space follows a space are encoded at once.
    """

    class Whole(Exception):
        pass

    def __init__(self, definition: str):
        super().__init__()
        alphabet, read = byte_alphabet(), json.loads(definition)
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in read.get("added_tokens", [])}
        if any(t.get(flag) for t in read.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them or stand for whole words only aren't supported")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in read["model"]["vocab"].items() if token not in self.added}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise self.Whole
        ids = self.encode(" " + word)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text; a string of an added token in it is that token, and what stands between them is encoded by itself."""
        if any(token in text for token in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *words = text.split(" ")
        try:
            start = self.encode(first)
            return struct.pack(f"<{len(start)}I", *start) + b"".join(map(self.__getitem__, words))
        except self.Whole:
            found = self.encode(text)
            return struct.pack(f"<{len(found)}I", *found)


@lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary): each whole text's ids, then `end`, cut only where longer than `capacity`.

    `tokenizer` is the path of a byte-level BPE definition, read on the driver. All pieces but the first have `capacity` ids. A null or
    empty text has the id `end` alone. Repeated rows give their pieces again.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped.value)
        for batch in in_slices(batches):
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (own.ids(text) if text else b"") + last
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                held += len(ids)
                if held > 16 << 20:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how many sequences follow each. Every counted length is used exactly as often as counted.

    Combinations of up to three lengths that fill a gap exactly may use up the short lengths that best fit would need elsewhere, so it is
    planned with combinations of up to three, two, one and no lengths; the plan of fewest sequences is taken, of equal ones the first.
    """
    return min((planned(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda p: sum(times for _, times in p))


def planned(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with exact combinations of up to `most` lengths for each gap, then best-fit decreasing; with none, best fit alone."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(have[x]) // n for x, n in need.items())
        if times:
            patterns.append((lengths, times))
            for x, n in need.items():
                have[x] -= n * times
        return times > 0

    def pair(total: int) -> list[tuple[int, int]]:
        """Pairs of available lengths with this sum, those with the longest first."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[(have[a] > 0) & (have[total - a] > 0)] if len(a) else a
        return [(int(x), int(total - x)) for x in a]

    for first in range(capacity, 0, -1):
        gap = capacity - first
        if not have[first]:
            continue
        if not gap:
            take((first,))
            continue
        if most >= 1:
            take((first, gap))
        for a, b in pair(gap) if most >= 2 else ():
            take((first, a, b))
        for a in range(gap - 2, 0, -1) if most >= 3 else ():
            if not have[first]:
                break
            if have[a]:
                for b, c in pair(gap - a):
                    if b <= a and have[first]:
                        take((first, a, b, c))

    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            gap = next((g for g in range(length, capacity) if open_by_gap.get(g)), None)
            if gap is None:
                # as many of this length in each new sequence as fit, and one with the rest
                each = capacity // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        room = capacity - n * length
                        (open_by_gap[room].append if room else patterns.append)(((length,) * n, times))
                left = 0
                continue
            own, times = open_by_gap[gap].pop()
            used = min(times, left)
            if times > used:
                open_by_gap[gap].append((own, times - used))
            room = gap - length
            (open_by_gap[room].append if room else patterns.append)(((*own, length), used))
            left -= used
    return patterns + [x for group in open_by_gap.values() for x in group]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, …) with sequence_id long and offset long added: a place for each piece, gapless from 0 in its sequence.

    Lengths run from 1 to `capacity`. pieces is read twice: pass a materialized one. The driver gets `capacity` counts at most. Repeated
    rows are pieces of their own. An empty table packs into nothing.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, base, used = [], 0, defaultdict(int)
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + times, base - used[length], offset))
            used[length] += times
            offset += length
        base += times
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "slot_length long, low long, high long, shift long, offset long")
    ranked = gapless_rank(pieces, ["length"], F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece")], "__rank", bounded=True)
    # the places are as many as the plan has slots: bounded by the capacity, not by the documents
    return (
        ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
        .select(*[F.col(c) for c in pieces.columns], (F.col("__rank") + F.col("shift")).alias("sequence_id"), "offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, pieces): the ids of each sequence in order, from packed pieces that still carry ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.expr("aggregate(transform(r, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.expr("transform(r, x -> struct(x.doc_id, x.piece, x.offset, x.length))").alias("pieces"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """The packed pieces of docs(doc_id, text) with a CRC-32 of their ids. Null and empty texts, null ids, repeated rows and empty tables: see
    tokenized_pieces and pack; other columns aren't read."""
    pieces = tokenized_pieces(docs, public_tokenizers.path(TOKENIZER))
    digest = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_digest of all documents: a row for each piece."""
    return packed_digest(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """packed_digest of the documents that the stages before kept."""
    return packed_digest(docs)
