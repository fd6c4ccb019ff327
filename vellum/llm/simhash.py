"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has 64 bits, and two link if at most RADIUS = 3 of them differ. Half of an odd radius is no whole number: full balls would
have to hold everything within 2 bits on one side (2,081 variants). So the bits are cut into three blocks, and each fingerprint is
projected three times, each time with one block left out. If two fingerprints differ in 3 bits at most, leaving out a block that holds one
of these bits (any, if they are equal) leaves 2 at most, and then the balls of half that radius, 1, meet exactly. Every projection emits all
its variants within 1 bit: 131 rows for each distinct fingerprint, whatever the corpus. Rows are shuffled on the variant; in a bucket a
search over the XOR of whole fingerprints verifies and emits a spanning forest of the true links, never all pairs. Equal fingerprints
are merged before, so a bucket holds at most 44 x 2**22 fingerprints even if a third of the corpus is one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import components, hot_join, in_slices, materialize, sized, small_batches, table

RADIUS = 3
BLOCKS = ((0, 22), (22, 43), (43, 64))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Near copies of the pipeline: runs of so many words, and the share of them (a fraction) that two texts have in common.
SHINGLE, SIMILAR = 5, (4, 5)
#: A pair at similarity s shares no band key with probability (1 - s**BAND_ROWS)**BANDS: 6e-4 at 0.8, 1e-5 at 0.85.
BANDS, BAND_ROWS = 40, 8
MULTIPLY, ADD = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), dtype=np.uint32)
MULTIPLY |= np.uint32(1)
#: A sketch has one bit of each of so many minima. Bits of a pair at 0.8 differ with probability 0.1 each: more than FAR of them in 1 of 100,000 pairs.
SKETCH, FAR = 256, 47
#: Distinct shingles of one chunk of a bucket (32 MB of hashes), and members of one chunk of a star.
CHUNK, STAR = 1 << 22, 512


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (fewer: the whole sequence; none: nothing), repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, dtype="<u8")
    line, size = b" ".join(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(start[: len(found) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], dtype="<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    """Another, independent looking hash for each hash."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: bit i is 1 if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of a text's shingles; zero without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball_variants(fps: DataFrame) -> DataFrame:
    """(variant, code) of each projection of fp and all its variants within one bit. code holds, from its lowest bit on, the bits left out,
    the bit flipped plus 1 (0: none) and the block's number; with the variant it gives fp again, in few bytes."""
    rows = []
    for k, (lo, hi) in enumerate(BLOCKS):
        keep = ((1 << 64) - 1) ^ (((1 << hi) - 1) ^ ((1 << lo) - 1))
        rows += [(signed(keep), signed(flip), lo, (1 << hi - lo) - 1, (k << 29) | (at << 22)) for at, flip in [(0, 0), *((i + 1, 1 << i) for i in range(64) if keep >> i & 1)]]
    ball = F.array(*[F.struct(*[F.lit(x).cast("long" if i < 2 else "int").alias(n) for i, (n, x) in enumerate(zip(("keep", "flip", "lo", "mask", "tag"), r, strict=True))]) for r in rows])
    variant = F.col("fp").bitwiseAND(F.col("x.keep")).bitwiseXOR(F.col("x.flip"))
    code = F.expr("cast(shiftrightunsigned(fp, x.lo) & cast(x.mask as bigint) as int) | x.tag")
    return fps.select("fp", F.explode(ball).alias("x")).select(variant.alias("variant"), code.alias("code"))


def decoded(variant: np.ndarray, code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    flip, block = (code >> 22) & 127, code >> 29
    low = np.array([lo for lo, _ in BLOCKS], dtype=np.int64)[block]
    return variant ^ np.where(flip > 0, np.left_shift(np.int64(1), np.maximum(flip - 1, 0)), 0) | ((code & ((1 << 22) - 1)) << low)


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph over distinct fingerprints in which those within RADIUS bits are linked."""
    rest, edges = members, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= RADIUS
            if near.any():
                hit, rest = rest[near], rest[~near]
                edges += [(int(x), int(y)) for y in hit]
                front += list(hit)
    return edges


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) from rows (variant, code) sorted by variant."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
        found = [(a[near], b[near])]
        for s, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if more := forest(np.unique(fp[s : s + n])):
                found.append(tuple(np.array(more, dtype=np.int64).T))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        once = once[:, once[0] != once[1]]
        return pa.RecordBatch.from_arrays([pa.array(once[0], pa.int64()), pa.array(once[1], pa.int64())], ["a", "b"])

    for batch in batches:
        variant = batch.column(0).to_numpy()
        key, fp = np.concatenate([key, variant]), np.concatenate([fp, decoded(variant, batch.column(1).to_numpy())])
        if len(key) and (whole := int(np.searchsorted(key, key[-1]))):
            yield links(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield links(key, fp)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct rows (fp) that connect all that are within RADIUS bits."""
    return ball_variants(fps).repartition("variant").sortWithinPartitions("variant").mapInArrow(bucket_links, "a long, b long").distinct()


def balls(fps: DataFrame) -> DataFrame:
    """(fp, low, n, root) of rows (doc_id, fp): each distinct fingerprint's smallest doc_id and number of rows, and the smallest fingerprint in
    its component."""
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return materialize(own.join(components(links(own.select("fp"))), own.fp == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))


def linked(fps: DataFrame) -> DataFrame:
    """(fp, n, component_id) of rows (doc_id, fp): how many rows each distinct fingerprint has, and the smallest doc_id in its component."""
    rooted = balls(fps)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m"))
    return hot_join(rooted, least, "root", "m", rooted.count()).select("fp", "n", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fp, component_id.

    Null and empty texts and those of white space only have fingerprint zero and link to each other like any other equal texts. Fewer than
    `words` words: the whole sequence is the one shingle. Repeated rows give a row each. A null doc_id gets its fingerprint and its
    component's smallest doc_id that isn't null. An empty table gives none; other columns, whatever their names, aren't read.
    """
    fps = materialize(fingerprints(docs, words))
    return hot_join(fps, linked(fps), "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


def minima(h: np.ndarray) -> np.ndarray:
    """The minimum of a set of hashes under each of BANDS x BAND_ROWS random maps; of an empty set, the largest number."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLY), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 1 << 9):  # parts that stay in the cache
        for k in range(0, len(least), 64):
            part = MULTIPLY[k : k + 64] * low[at : at + (1 << 9)]
            part += ADD[k : k + 64]
            np.minimum(least[k : k + 64], part.min(axis=1), out=least[k : k + 64])
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BAND_ROWS minima; all texts without words share theirs."""
    key = np.arange(BANDS, dtype=np.uint64)
    for own in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = mixed(key ^ own)
    return key


def sketch(least: np.ndarray) -> bytes:
    """One bit of each of the first SKETCH minima: two sets' bits are equal where their minima are, and by chance elsewhere."""
    salted = least[:SKETCH].astype(np.uint64) + (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32))
    return np.packbits((mixed(salted) & np.uint64(1)).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, own, fp, size, sketch, bands): a hash of the text, its fingerprint, how many distinct shingles it has, and their sketch and band
    keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            every = [shingle_hashes(t, SHINGLE) for t in batch.column(2).to_pylist()]
            sets = [np.unique(h) for h in every]
            least = [minima(h) for h in sets]
            flat = pa.array(np.concatenate([band_keys(x) for x in least]).view("<i8") if sets else [], pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.int32()), flat)
            more = [pa.array(list(map(majority, every)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(sketch, least)), pa.binary()), bands]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["doc_id", "own", "fp", "size", "sketch", "bands"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text").mapInArrow(run, "doc_id long, own long, fp long, size long, sketch binary, bands array<long>")


def with_balls(own: DataFrame) -> DataFrame:
    """own(own, rep, fp, size, sketch, bands), a materialized table, with one more key in bands instead of fp: that of the texts whose
    fingerprints ball hashing connects."""
    found = balls(own.select(F.col("rep").alias("doc_id"), "fp")).select("fp", "n", "root")
    keyed = hot_join(own, found, "fp", "n", own.count())
    return keyed.select("own", "rep", "size", "sketch", F.concat("bands", F.array(F.xxhash64("root", F.lit("ball")))).alias("bands"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes (sorted, distinct) share SIMILAR of their union or more, in whole numbers; two empty sets do."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    if min(len(x), len(y)) * SIMILAR[1] < max(len(x), len(y)) * SIMILAR[0]:
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0]


def with_texts(units: DataFrame, docs: DataFrame) -> DataFrame:
    """units(own, rep, …) with text: that of the row of docs with the hash `own` and the id `rep`. Only texts that are asked for are shuffled,
    unless their list is too long to broadcast."""
    asked = sized(materialize(units.select("own", "rep").distinct()))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("own"), "text")
    on = (texts.own == asked.own) & texts.rep.eqNullSafe(asked.rep)
    return units.drop("rep").join(texts.join(asked, on, "left_semi").select("own", "text"), "own")


def star_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) from rows (hub, part, leaf, own, text) sorted by the first three: each member's set is held against its hub's."""
    last, hub = None, np.empty(0, "<u8")
    for batch in in_slices(batches):
        keep = []
        for h, part, leaf, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            own = np.unique(shingle_hashes(text, SHINGLE))
            if not leaf and (h, part) != last:
                last, hub = (h, part), own
            keep.append(leaf and similar(hub, own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Unit:
    """Members of one unit of a bucket: texts of several components, some of which are to be held against all others."""

    def __init__(self) -> None:
        self.own: list[int] = []
        self.root: list[int] = []
        self.probe: list[bool] = []
        self.base: list[bool] = []
        self.sketch: list[bytes] = []
        self.text: list[str | None] = []

    def edges(self) -> list[tuple[int, int]]:
        """A link for each two components that a verified pair joins; pairs of joined components aren't verified again."""
        sets: dict[int, np.ndarray] = {}
        joined: dict[int, int] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(self.text[i], SHINGLE))
            return sets[i]

        def find(r: int) -> int:
            while (up := joined.get(r, r)) != r:
                r = up
            return r

        own, root = np.array(self.own), np.array(self.root)
        bits = np.frombuffer(b"".join(self.sketch), dtype="<u8").reshape(len(own), -1)
        base, found = np.flatnonzero(self.base), []
        for i in np.flatnonzero(self.probe).tolist():
            apart = np.zeros(len(base), dtype=np.int32)
            for word in range(bits.shape[1]):
                apart += np.bitwise_count(bits[base, word] ^ bits[i, word])
            for j in base[(apart <= FAR) & (root[base] != root[i])].tolist():
                r, s = find(self.root[i]), find(self.root[j])
                if r != s and similar(shingles(i), shingles(j)):
                    joined[max(r, s)] = min(r, s)
                    found.append((int(own[i]), int(own[j])))
        return found


def unit_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) between components from rows (band, i, j, probe, base, own, root, sketch, text) sorted by the first three."""
    last, unit = None, Unit()
    for batch in in_slices(batches):
        found = []
        for band, i, j, probe, base, *row in zip(*[batch.column(k).to_pylist() for k in range(9)], strict=True):
            if (band, i, j) != last:
                found += unit.edges() if last else []
                last, unit = (band, i, j), Unit()
            unit.probe.append(probe)
            unit.base.append(base)
            for column, x in zip((unit.own, unit.root, unit.sketch, unit.text), row, strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    if last:
        found = unit.edges()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_links(own: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): verified links between rows own(own, rep, size, sketch, bands) of docs that connect all pairs with an equal band key.

    Of a bucket (the texts with one band key) the member that shares most buckets with others is its hub. First all members are held
    against their hubs. Where members of a bucket are in different components then, all outside its largest component are held against
    the whole bucket: sketches first, sets where these don't rule the pair out. A bucket is cut into chunks of a bounded number of shingles,
    and each two chunks that hold such a pair meet in a task; texts travel once for each such bucket, not for each pair.
    """
    texts_of = own.select("own", "rep")
    member = own.select("own", F.explode("bands").alias("band"))
    buckets = materialize(member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = buckets.agg(F.sum("n")).first()[0] or 0
    member = materialize(hot_join(member, buckets, "band", "n", total), replaces=(buckets,))
    degree = member.groupBy("own").agg(F.sum(F.col("n") - 1).alias("degree"))
    hubs = member.join(degree, "own").groupBy("band").agg(F.max(F.struct("degree", "own")).alias("hub"), F.count(F.lit(1)).alias("n")).select("band", F.col("hub.own").alias("hub"), F.col("n").alias("m"))
    stars = hot_join(member, hubs, "band", "m", total).where("own != hub").select("hub", "own").distinct()
    stars = materialize(stars.withColumn("at", F.pmod(F.xxhash64("own", F.lit("star")), F.lit(1 << 30))))
    parts = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"), F.count(F.lit(1)).alias("m"))
    leaves = hot_join(stars, parts, "hub", "m", total).select("hub", F.pmod("at", "parts").cast("int").alias("part"), F.lit(True).alias("leaf"), "own")
    heads = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("leaf"), F.col("hub").alias("own"))
    met = with_texts(materialize(leaves.union(heads).join(texts_of, "own"), replaces=(stars,)), docs).select("hub", "part", "leaf", "own", "text")
    edges = materialize(met.repartition("hub", "part").sortWithinPartitions("hub", "part", "leaf").mapInArrow(star_edges, "a long, b long"))

    known = member.join(components(edges), F.col("own") == F.col("node"), "left").select("band", "own", F.coalesce("root", "own").alias("root"))
    known = materialize(known.join(own.select("own", "rep", "size", "sketch"), "own"), replaces=(member,))
    sides = known.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sides = sides.groupBy("band").agg(F.max(F.struct("n", "root")).alias("big"), F.max(F.struct("n", "root", "size")).alias("most"), F.sum("size").alias("all"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"))
    chunks = [F.greatest(F.lit(1), F.ceil(x / CHUNK)).cast("int").alias(n) for x, n in ((F.col("all") - F.col("most.size"), "probes"), (F.col("all"), "bases"))]
    sides = sides.where("roots > 1").select("band", "n", F.col("big.root").alias("big"), *chunks)
    split = hot_join(known, sides, "band", "n", total).withColumn("outside", F.col("root") != F.col("big"))
    at = [F.pmod(F.xxhash64("own", F.lit(n)), F.col(n)).cast("int") for n in ("probes", "bases")]
    asking = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("bases") - 1), lambda j: F.struct(at[0].alias("i"), j.alias("j")))).otherwise(F.expr("cast(array() as array<struct<i:int,j:int>>)"))
    asked = F.transform(F.sequence(F.lit(0), F.col("probes") - 1), lambda i: F.struct(i.alias("i"), at[1].alias("j")))
    units = split.withColumn("mine", F.struct(at[0].alias("i"), at[1].alias("j"))).withColumn("unit", F.explode(F.array_union(asking, asked)))
    probe, base = F.col("outside") & (F.col("unit.i") == F.col("mine.i")), F.col("unit.j") == F.col("mine.j")
    units = units.select("band", F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), probe.alias("probe"), base.alias("base"), "own", "rep", "root", "sketch")
    met = with_texts(materialize(units, replaces=(known,)), docs).select("band", "i", "j", "probe", "base", "own", "root", "sketch", "text")
    more = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(unit_edges, "a long, b long")
    return materialize(edges.union(more), replaces=(edges,))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, all columns: the one with the smallest doc_id.

    Near copies share 0.8 of the union of their five-word shingles or more; groups are the connected components of these pairs. Candidates
    are texts whose SimHash fingerprints ball hashing connects, and for pairs that differ in more than RADIUS bits texts with an equal band
    key; every link is verified on the real sets (similar_links). Null and empty texts are copies of each
    other, and so are repeated rows; a null id counts as the smallest. An empty table stays empty. Columns whose names begin with __vellum_
    are reserved.
    """
    rows = materialize(signatures(docs))
    first = [F.first(c).alias(c) for c in ("fp", "size", "sketch", "bands")]
    own = materialize(rows.groupBy("own").agg(F.min(F.struct("doc_id")).alias("k"), *first).select("own", F.col("k.doc_id").alias("rep"), "fp", "size", "sketch", "bands"))
    own = materialize(with_balls(own), replaces=(own,))
    edges = similar_links(own, docs)
    group = own.join(components(edges), F.col("own") == F.col("node"), "left").withColumn("group", F.coalesce("root", "own"))
    keep = group.groupBy("group").agg(F.min(F.struct("rep", "own")).alias("k")).select(F.col("k.rep").alias("kept"), F.col("k.own").alias("its"))
    seen = rows.groupBy("doc_id", "own").agg(F.count(F.lit(1)).alias("n"))
    told = seen.join(keep, (F.col("own") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("kept")), "left")
    # what isn't a group's one row: rows that go, and rows that are there several times
    odd = materialize(told.where(F.col("its").isNull() | (F.col("n") > 1)).select(F.col("doc_id").alias("__vellum_id"), F.col("own").alias("__vellum_own"), F.col("its").isNotNull().alias("__vellum_again")), replaces=(rows, own, edges))
    told = sized(odd)
    same = (F.col("__vellum_text") == F.col("__vellum_own")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__vellum_id"))
    marked = docs.withColumn("__vellum_text", F.xxhash64("text")).join(told, same, "left")
    kept = marked.where(F.col("__vellum_again").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    if odd.where("__vellum_again").isEmpty():
        return kept
    return kept.union(marked.where("__vellum_again").dropDuplicates(["__vellum_own", "__vellum_id"]).select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, see deduplicate for nulls, ties, repeated rows and empty tables."""
    return deduplicate(docs)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents on three-word shingles: a row for each."""
    found = near_duplicates(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
