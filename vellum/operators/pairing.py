"""Label-value lines, and the interpretation of a region's segments as pairs, a table or plain lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from math import cbrt, exp, inf, sqrt
from statistics import fmean, median
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators.grouped import map_groups


def parse_kv_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, label, value) of each row: the first ": " of its text that makes a label and a value, null where none does.

    Each possible split is a row, so votes are taken on plain columns, and the first good one of a key wins.
    """
    pieces = F.split(t.collapsed(F.col(text)), ": ")
    tries = df.select(*keys, pieces.alias("p")).select(*keys, "p", F.explode_outer(F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1))).alias("i"))
    parts = tries.select(*keys, "i", t.trimmed(F.array_join(F.slice("p", F.lit(1), F.col("i")), ": ")).alias("label"), t.trimmed(F.array_join(F.slice("p", F.col("i") + 1, F.size("p") - F.col("i")), ": ")).alias("value"))
    votes = parts.withColumn("vl", t.cell_vote(F.col("label"))).withColumn("vv", t.cell_vote(F.col("value")))
    label, value = F.col("label"), F.col("value")
    score = t.type_plausibility(F.col("vl.v"), F.when(F.col("vv.strong"), F.col("vv.v")).otherwise(0.0))
    good = ~t.is_clock_split(label, value) & t.valid_kv_shape(label, value) & ~value.rlike(t.PROSE) & (score > t.LINES_SCORE)
    first = F.min(F.when(good, F.struct("i", "label", "value")))
    return votes.groupBy(*keys).agg(first.alias("f")).select(*keys, F.col("f.label").alias("label"), F.col("f.value").alias("value"))


# ---- the interpreter of one region ----

#: The mixtures of the three readings, the least jump of gaps, the neutral quality of a band, the column gap in line heights.
STACKED, INLINE, TABLE, PRIOR = (0.5, 0.25, 0.25), (0.5, 0.25, 0.25), (0.4, 0.4, 0.2), 0.1
JUMP, NEUTRAL, COLUMN_GAP, ROW_SHARE = 1.3, 0.25, 2.2, 0.6


class Seg(NamedTuple):
    """A segment of a line: its place among the region's segments, text, box and vote."""

    at: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    v: float
    strong: bool

    @property
    def cy(self) -> float:
        return (self.y0 + self.y1) / 2

    @property
    def cx(self) -> float:
        return (self.x0 + self.x1) / 2


class Pair(NamedTuple):
    label: str
    value: str
    labels: tuple[int, ...]
    values: tuple[int, ...]
    plausible: float
    margin: float
    align: float
    y: float
    x: float


class Reading(NamedTuple):
    kind: str
    layout: str
    score: float
    evidence: float
    signature: object
    pairs: tuple[Pair, ...] = ()
    cap: float = inf


def sigma(v: float) -> float:
    return 1 / (1 + exp(-t.SIGMA_K * v))


def plausible(label: float, value: float) -> float:
    return sqrt(sigma(label) * sigma(-value))


def mean_vote(votes: list[tuple[float, bool]]) -> float:
    weights = [1.0 if strong else 0.5 for _, strong in votes]
    return sum(w * v for w, (v, _) in zip(weights, votes, strict=True)) / sum(weights) if votes else 0.0


def in_context(vote: tuple[float, bool], context: float) -> float:
    return vote[0] if vote[1] else (vote[0] + 2 * context) / 3


def rows_of(segs: list[Seg], line_height: float) -> list[list[Seg]]:
    """Rows from top to bottom: a segment joins while its center is near the running median of the row's centers."""
    rows: list[list[Seg]] = []
    center = -inf
    for s in sorted(segs, key=lambda s: s.cy):
        if rows and abs(s.cy - center) <= line_height * ROW_SHARE:
            rows[-1].append(s)
        else:
            rows.append([s])
        center = median(x.cy for x in rows[-1])
    return [sorted(r, key=lambda s: s.x0) for r in rows]


def jump(gaps: list[float]) -> tuple[set[int], float] | None:
    """The indices of large gaps and the factor that parts them from small ones, if one does."""
    if len(gaps) < 2:
        return None
    order = sorted((max(g, 1e-9), i) for i, g in enumerate(gaps))
    factors = [b[0] / a[0] for a, b in pairwise(order)]
    margin = max(factors)
    cut = factors.index(margin) + 1
    small, big = order[:cut], order[cut:]
    if margin < JUMP or small[-1][0] / small[0][0] > margin or big[-1][0] / big[0][0] > margin:
        return None
    return {i for _, i in big}, margin


def runs(values: list[float], gap: float) -> list[float]:
    """Means of runs of sorted values without a step over gap."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= gap:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [fmean(g) for g in groups]


def nearest(centers: list[float], v: float) -> int:
    return min(range(len(centers)), key=lambda i: (abs(centers[i] - v), i))


def columns_of(segs: list[Seg], line_height: float) -> list[tuple[list[float], list[int]]]:
    """Ways to put segments into columns: by left edges, by centers, by jumps of left edges; equal ways once."""
    left, mid = [s.x0 for s in segs], [s.cx for s in segs]
    ways = [(runs(left, line_height * COLUMN_GAP), left), (runs(mid, line_height * COLUMN_GAP), mid)]
    edges = sorted(left)
    if split := jump([b - a for a, b in pairwise(edges)]):
        parts = [[edges[0]]]
        for i, v in enumerate(edges[1:]):
            parts += [[v]] if i in split[0] else []
            parts[-1] += [] if i in split[0] else [v]
        ways.append(([fmean(p) for p in parts], left))
    out: dict[tuple[int, ...], list[float]] = {}
    for centers, values in ways:
        out.setdefault(tuple(nearest(centers, v) for v in values), centers)
    return [(centers, list(assigned)) for assigned, centers in out.items()]


def bands_of(centers: list[float], votes: list[float], quality) -> list[tuple[list[list[int]], float]]:
    """Ways to part rows into bands of a label row and its value rows, with how clearly they part; equal ways once."""
    n = len(centers)

    def cut(where: set[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(n):
            if i == 0 or i in where:
                out.append([])
            out[-1].append(i)
        return out

    ways = [(cut(set()), inf)]
    if split := jump([b - a for a, b in pairwise(centers)]):
        ways.append((cut({i + 1 for i in split[0]}), split[1]))
    turns = {i: min(votes[i], -votes[i - 1]) for i in range(1, n) if votes[i] > 0 > votes[i - 1]}
    ways.append((cut(set(turns)), 1 + (fmean(turns.values()) if turns else 0.0)))
    best, back = [0.0], [0]
    for j in range(1, n + 1):
        scores = [best[i] + ((quality(i, j - 1) - NEUTRAL) * (j - i) if j - i > 1 else 0.0) for i in range(j)]
        best.append(max(scores))
        back.append(scores.index(best[-1]))
    at, where = n, set()
    while at:
        at = back[at]
        where.add(at)
    ways += [(cut(where), inf), (cut(set(range(n))), inf)]
    once: dict[str, tuple[list[list[int]], float]] = {}
    for bands, cap in ways:
        once.setdefault(str(bands), (bands, cap))
    return list(once.values())


def bare(text: str) -> str:
    return text.strip().removesuffix(":").strip()


def joined(texts: list[str]) -> str:
    out = texts[0] if texts else ""
    for x in texts[1:]:
        out += (" " if out.rstrip()[-1:] in (",", ";", ":", "-") else ", ") + x
    return " ".join(out.split())


def plain_vote(text: str) -> tuple[float, bool]:
    """functions.text.cell_vote in plain Python, without a lexicon: for cells that come about inside the interpreter."""
    whole = text.strip()
    body = whole.removesuffix(":").strip()
    if not whole:
        return 0.0, False
    words = body.split()
    compact = re.sub(r"[\s\-/.+()]", "", body)
    value = (
        any(re.search(p, body) for p in (*t.DATE_SHAPES, *t.MEASURE_SHAPES, t.TITLED))
        or len(compact) >= 5 and re.fullmatch("[A-Za-z0-9]+", compact) and len(re.sub(r"\D", "", compact)) / len(compact) >= 0.6
        or re.search(t.LAST_FIRST, body) and len(parts := [w for w in re.split(r"[\s,]+", body) if w]) <= 6 and all(re.match("[A-Z]", w) for w in parts)
        or len(words) >= 8 and sum(bool(re.match("[a-z]", w)) for w in words) / len(words) >= 0.4
    )
    told = [1.0] * (whole.endswith(":") and len(whole) > 1) + [-1.0] * bool(value)
    if told:
        return fmean(told), True
    n, marked = len(words), sum(bool(re.search(t.MARKER, w)) for w in words)
    v = 0.4 if n <= 2 else 0.15 if n <= 4 else -0.3 if n <= 7 else -0.6
    v += -0.25 if re.match("[a-z]", body) else 0.3 if all(re.match("[A-Z0-9(]", w) for w in words) else 0.0
    if marked == n and n >= 2:
        v -= 0.3
    elif (marked, n) != (1, 1) and (signs := len(re.sub("[^A-Za-z0-9]", "", body))):
        v -= 0.8 * min(1.0, 2 * len(re.sub(r"\D", "", body)) / signs)
    if re.search(r"[.,;]\Z", body) and not (body.endswith(".") and len(words[-1]) <= 4):
        v -= 0.3
    return max(-1.0, min(1.0, v)), False


class Grid:
    """Cells of rows and columns; segments that meet in one cell merge, and their vote is taken anew without a lexicon."""

    def __init__(self, rows: list[list[Seg]], column: dict[int, int], n: int, vote) -> None:
        self.cells: list[dict[int, tuple[list[Seg], str, tuple[float, bool]]]] = []
        for row in rows:
            own: dict[int, list[Seg]] = {}
            for s in row:
                own.setdefault(column[s.at], []).append(s)
            texts = {c: " ".join(" ".join(x.text for x in g).split()) for c, g in own.items()}
            self.cells.append({c: (g, texts[c], (g[0].v, g[0].strong) if len(g) == 1 else vote(texts[c])) for c, g in own.items()})
        self.n = n
        self.total = sum(map(len, self.cells))
        self.votes = [mean_vote([vote for _, _, vote in row.values()]) for row in self.cells]

    def penalty(self, centers: list[float], width: float) -> float:
        """Less for merged cells, a wide first cell, columns close together, and rows of one cell."""
        width = max(1.0, width)
        merged = sum(len(g) > 1 for row in self.cells for g, *_ in row.values())
        first = [max(s.x1 for s in row[min(row)][0]) - min(s.x0 for s in row[min(row)][0]) for row in self.cells if row]
        share, span = (median(first) if first else 0.0) / width, (max(centers) - min(centers)) / width
        several = sum(len(row) > 1 for row in self.cells)
        p = 1 - 0.5 * merged / self.total if self.total else 1.0
        p *= max(0.4, 1 - 2 * (share - 0.3)) if share > 0.3 else 1.0
        p *= max(0.2, span / 0.12) if span < 0.12 else 1.0
        return p * (1.0 if several > 1 else 0.6 if several else 0.3)


def stacked(grid: Grid, centers: list[float], penalty: float) -> Iterator[Reading]:
    """Labels in a row, their values in the rows below."""
    split = jump([b - a for a, b in pairwise(centers)])

    def quality(label: int, last: int) -> float:
        values = list(range(label + 1, last + 1))
        return plausible(grid.votes[label], max(grid.votes[r] for r in (values[:-1] if len(values) > 1 else values))) ** 2

    for bands, cap in bands_of(centers, grid.votes, quality):
        pairs, scores, taken = [], [], 0
        for band in (b for b in bands if len(b) > 1):
            head, below = grid.cells[band[0]], band[1:]
            scores.append(quality(band[0], band[-1]))
            context = mean_vote([vote for r in below for _, _, vote in grid.cells[r].values()])
            for c, (segs, text, vote) in sorted(head.items()):
                values = [grid.cells[r][c] for r in below if c in grid.cells[r] and grid.cells[r][c][1]]
                if not text or not values:
                    continue
                group = mean_vote([v for _, _, v in values]), any(v[1] for _, _, v in values)
                y = (min(s.y0 for s in segs) + max(s.y1 for s in segs)) / 2
                pairs.append(Pair(bare(text), joined([x for _, x, _ in values]), tuple(s.at for s in segs), tuple(s.at for g, *_ in values for s in g), plausible(in_context(vote, grid.votes[band[0]]), in_context(group, context)), inf, 1.0, y, min(s.x0 for s in segs)))
                taken += 1 + len(values)
        n = len(centers)
        starts = {b[0] for b in bands[1:]}
        geometry = sum((i in starts) == (i - 1 in split[0]) for i in range(1, n)) / (n - 1) if split and n > 1 else 0.5
        mix = STACKED[0] * (fmean(scores) if scores else 0.0) + STACKED[1] * geometry + STACKED[2] * (taken / grid.total if grid.total else 0.0)
        yield Reading("kv" if pairs else "lines", "stacked", mix * penalty, mix * penalty, tuple((p.label, p.value) for p in pairs) or "lines", tuple(pairs), cap)


def inline(segs: list[Seg], centers: list[float], assigned: list[int], penalty: float, pitch: float) -> Reading | None:
    """Labels in a column, their values in the next one to the right."""
    cols: list[list[Seg]] = [[] for _ in centers]
    for s, c in zip(segs, assigned, strict=True):
        cols[c].append(s)
    cols = [sorted(c, key=lambda s: s.cy) for c in cols]
    votes = [mean_vote([(s.v, s.strong) for s in c]) for c in cols]
    labels, values = [c for c in range(len(cols)) if votes[c] > 0], [c for c in range(len(cols)) if votes[c] <= 0]
    meetings = []
    for a in labels:
        right = [b for b in values if centers[b] > centers[a]]
        if right:
            b = min(right, key=lambda b: centers[b])
            if max((x for x in labels if centers[x] < centers[b]), key=lambda x: (centers[x], -x)) == a:
                meetings.append((a, b))
    pairs, type_scores, mutual, n_labels, used = [], [], 0, 0, set()
    for a, b in meetings:
        type_scores.append(plausible(votes[a], votes[b]) ** 2)
        n_labels += len(cols[a])
        steps = [y.cy - x.cy for x, y in pairwise(cols[a])]
        step = (median(steps) if steps else 0.0) or pitch
        claims: dict[int, tuple[Seg, float, float]] = {}  # by value
        for label in cols[a]:
            near = sorted(cols[b], key=lambda v: abs(v.cy - label.cy))
            if near and min(cols[a], key=lambda x: abs(near[0].cy - x.cy)) is label:
                d = abs(near[0].cy - label.cy)
                margin = abs(near[1].cy - label.cy) / max(d, 1e-6) if len(near) > 1 else inf
                claims[near[0].at] = (label, margin, max(0.0, 1 - d / max(step, 1e-6)))
                mutual += 1
        own: dict[int, list] = {}
        for v in cols[b]:
            if v.at in claims:
                label, margin, align = claims[v.at]
                e = own.setdefault(label.at, [label, [], margin, align])
                e[1].append(v)
                e[2:] = [min(e[2], margin), min(e[3], align)]
        heads = [x for x in cols[a] if x.at in own]
        for v in cols[b]:
            above = [x for x in heads if x.cy <= v.cy]
            if v.at not in claims and above:
                own[above[-1].at][1].append(v)
        for label, found, margin, align in own.values():
            found.sort(key=lambda s: s.cy)
            if bare(label.text):
                group = mean_vote([(s.v, s.strong) for s in found]), any(s.strong for s in found)
                pairs.append(Pair(bare(label.text), joined([s.text.strip() for s in found if s.text.strip()]), (label.at,), tuple(s.at for s in found), plausible(in_context((label.v, label.strong), votes[a]), in_context(group, votes[b])), margin, align, label.cy, label.x0))
                used |= {label.at, *(s.at for s in found)}
    if not pairs:
        return None
    mix = INLINE[0] * fmean(type_scores) + INLINE[1] * mutual / max(1, n_labels) + INLINE[2] * len(used) / len(segs)
    score = mix * penalty * fmean(p.align for p in pairs)
    return Reading("kv", "inline", score, score, tuple((p.label, p.value) for p in pairs), tuple(pairs))


def as_table(grid: Grid, penalty: float, prior: bool) -> Reading:
    """A header row over columns of one kind each."""
    header = sigma(grid.votes[0] - max(0.0, max(grid.votes[1:], default=0.0)))
    agreed = weight = 0.0
    for c in range(grid.n):
        column = [row[c][2] for row in grid.cells[1:] if c in row]
        if column:
            typed = [(v, 1.0 if strong else 0.5) for v, strong in column if abs(v) >= 0.05]
            same = abs(sum(w * v for v, w in typed)) / sum(w * abs(v) for v, w in typed) if len(typed) > 1 else 0.5
            agreed += same * len(column)
            weight += len(column)
    fill = grid.total / max(1, len(grid.cells) * grid.n)
    mix = TABLE[0] * header + TABLE[1] * (agreed / weight if weight else 0.5) + TABLE[2] * fill * min(1.0, len(grid.cells) / 3)
    return Reading("table", "", mix * penalty + (PRIOR if prior else 0.0), mix * penalty, "table")


def disputes(p: Pair, q: Pair) -> bool:
    """Whether q binds segments of p otherwise."""
    a, b, c, d = set(p.labels), set(p.values), set(q.labels), set(q.values)
    return bool(a & c and b != d or b & d and a != c or a & d or b & c)


def interpret(segs: list[Seg], line_height: float, pitch: float, width: float, vote, prior: bool = False) -> tuple[Reading, float, list[tuple[Pair, float]]]:
    """The best reading of a region, the evidence of the best other one, and for label-value readings the pairs with their confidence."""
    plain = Reading("lines", "", t.LINES_SCORE, t.LINES_SCORE, "lines")
    if len(segs) < 3:
        return plain, 0.0, []
    rows = rows_of(segs, line_height)
    centers = [median(s.cy for s in r) for r in rows]
    readings = [plain]
    for anchors, assigned in columns_of(segs, line_height):
        if len(anchors) < 2:
            continue
        grid = Grid(rows, {s.at: c for s, c in zip(segs, assigned, strict=True)}, len(anchors), vote)
        penalty = grid.penalty(anchors, width)
        readings += stacked(grid, centers, penalty)
        side = inline(segs, anchors, assigned, penalty, pitch)
        readings += [side] if side else []
        readings.append(as_table(grid, penalty, prior))
    best = max(readings, key=lambda r: r.score)
    other = max((r.evidence for r in readings if r.signature != best.signature), default=0.0)
    if best.kind != "kv":
        return best, other, []

    def mapped(m: float) -> float:
        return 1 - 1 / max(1.0, m) ** 2

    rest = max(r.evidence for r in readings if r.kind != "kv")
    out = []
    for p in best.pairs:
        against = max((r.evidence for r in readings if r.kind == "kv" and r is not best and any(disputes(p, q) for q in r.pairs)), default=0.0)
        margin = min(best.evidence / against if against else inf, best.cap, p.margin)
        out.append((p, min(1.0, max(0.01, cbrt(p.plausible * mapped(margin) * p.align * mapped(best.evidence / rest))))))
    return best, other, sorted(out, key=lambda x: (x[0].y, x[0].x))


PAIRS = "region_id long, kind string, layout string, score double, runner_up double, label string, value string, conf double"


def interpret_regions(segments: DataFrame) -> DataFrame:
    """Rows (region_id, kind, layout, score, runner_up, label, value, conf): a row for each pair, or one without label for other regions.

    segments(region_id, seg, text, x0, y0, x1, y1, line_height, pitch, page_width). Votes are taken in the JVM; a region's segments then go
    through one pure function; cells merged there vote by plain_vote.
    """
    voted = segments.withColumn("vote", t.cell_vote(F.col("text"))).select("region_id", "seg", "text", "x0", "y0", "x1", "y1", F.col("vote.v").alias("v"), F.col("vote.strong").alias("strong"), "line_height", "pitch", "page_width")

    def run(region: list) -> list[tuple]:
        segs = [Seg(i, r.text, r.x0, r.y0, r.x1, r.y1, r.v, bool(r.strong)) for i, r in enumerate(region)]
        first = region[0]
        best, other, pairs = interpret(segs, first.line_height, first.pitch, first.page_width, plain_vote)
        return [(first.region_id, best.kind, best.layout, best.score, other, p.label, p.value, c) for p, c in pairs] or [(first.region_id, best.kind, best.layout, best.score, other, None, None, None)]

    return map_groups(voted, "region_id", ["seg"], run, PAIRS)
