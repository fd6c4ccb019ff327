"""Segments to typed blocks: regions of several cells are interpreted, the rest is put in reading order and merged line by line."""

from __future__ import annotations

import re
from collections import Counter
from math import floor
from statistics import median
from typing import NamedTuple

from pyspark.sql import DataFrame

from vellum.functions import text as t
from vellum.operators.grouped import map_groups
from vellum.operators.layout import Box, around, cut_order
from vellum.operators.pairing import Seg, interpret, nearest, plain_vote, plausible, rows_of, runs

#: Fixed values, center to center in line pitches: lines of a list item, of a paragraph or a wrapped value, of a run of list items.
ITEM_STEP, LINE_STEP, RUN_STEP = 1.5, 1.8, 2.2
#: Fixed values, in line heights: indent, list edges, a kv line pulled into a list, margins, right-hand cells, cuts, columns, folded rows.
INDENT, LIST_EDGE, PULLED, MARGIN, CELL, CUT, TABLE_COLUMN, TABLE_FOLD = 0.4, 1.0, 1.2, 1.5, 2.0, 1.2, 2.2, 1.2
#: The page's top in line heights, where a centered line is the title; least words of a list's sentences; most of a title.
TITLE_BAND, SENTENCE, TITLE_WORDS = 8, 4, 8
#: First cells that announce a table.
HEADER_WORDS = set("feature features item items test tests parameter parameters antibody marker field property attribute name description value result".split())


class Block(NamedTuple):
    """A block; a list item's lead is its label, a table's text is its pipe table."""

    kind: str
    depth: int
    text: str
    label: str
    value: str
    y: float
    x: float


class Scales(NamedTuple):
    """What distances on a page are measured by: line height, the body's left edge, the pitch of lines, the page's width."""

    height: float
    left: float
    pitch: float
    width: float


def most_common(values: list[float], step: float) -> float:
    """The most frequent multiple of `step` that values round to, the smaller of equals."""
    counts = Counter(floor(v / step + 0.5) * step for v in values)
    return min(counts, key=lambda k: (-counts[k], k), default=0.0)


def page_scales(boxes: list[Box], width: float) -> Scales:
    """The scales of a page from the boxes of all its segments."""
    height = median(b[3] - b[1] for b in boxes) or 12.0
    rows = rows_of([Seg(i, "", *b, 0.0, False) for i, b in enumerate(boxes)], height)
    centers = [median(s.cy for s in r) for r in rows]
    steps = [b - a for a, b in zip(centers, centers[1:], strict=False) if b > a]
    return Scales(height, most_common([b[0] for b in boxes], max(8.0, height * 0.5)), (median(steps) if steps else 0.0) or height, width or max(b[2] for b in boxes))


def kv_line(text: str, lenient: bool = False) -> tuple[str, str] | None:
    """The first split at ": " that makes a label and a value; lenient: by its shape alone."""
    whole = " ".join(text.split())
    at = whole.find(": ")
    while at >= 0:
        label, value = whole[:at].strip(), whole[at + 2 :].strip()
        words = label.split()
        clock = re.search(r"(^|\D)\d{1,2}\Z", label) and re.match(r"\d{2}(\D|\Z)", value)
        ends = label[-1:] in (",", ";") or label.endswith(".") and len(words[-1]) > 4
        if label and value and not clock and not ends and len(words) <= 7 and re.search("[A-Za-z]", label) and balanced(label) and balanced(value):
            v, strong = plain_vote(value)
            if lenient or not re.search(t.PROSE, value) and plausible(plain_vote(label)[0], v if strong else 0.0) > t.LINES_SCORE:
                return label, value
        at = whole.find(": ", at + 1)
    return None


def balanced(text: str) -> bool:
    for opens, closes in ("()", "[]"):
        depth = 0
        for c in text:
            depth += (c == opens) - (c == closes)
            if depth < 0:
                return False
        if depth:
            return False
    return True


def heading_like(text: str, width: float, page_width: float) -> bool:
    words = text.split()
    if not words or len(words) > 8 or width > page_width * 0.62 or text[-1] in ".,;":
        return False
    return len(words) <= 5 if text.endswith(":") else bool(re.match(t.SPECIAL_HEADING, text) or re.match("[A-Z0-9(]", text) and re.search("[a-z]", text))


class Line(NamedTuple):
    """A segment outside regions: text, box, and where its second word begins and its first one ends (null where words aren't known)."""

    text: str
    box: Box
    second: float | None = None
    first_end: float | None = None

    @property
    def cy(self) -> float:
        return (self.box[1] + self.box[3]) / 2

    def lead(self) -> tuple[str, str]:
        """(lead, rest) of a label and its sentence, an empty lead where there is none."""
        return kv_line(self.text) or ("", self.text)

    def bullet(self, height: float) -> tuple[str, str] | None:
        """(lead, rest) behind a bullet: a plain one, or a letter or sign that a gap sets off."""
        first, _, rest = self.text.partition(" ")
        set_off = self.second is not None and self.first_end is not None and self.second - self.first_end > height * 0.5
        if re.search(t.PLAIN_BULLET, first) or rest and set_off and re.search(t.SET_OFF_BULLET, first):
            rest = " ".join(rest.split())
            return kv_line(rest) or ("", rest)
        return None


def table_of(segs: list[Seg], height: float) -> list[list[str]]:
    """Rows of cells: columns by left edges, and a row without a first cell close below another is part of it."""
    centers = runs([s.x0 for s in segs], height * TABLE_COLUMN)
    rows: list[tuple[list[str], float]] = []
    for row in rows_of(segs, height):
        cells = [""] * len(centers)
        for s in row:
            c = nearest(centers, s.x0)
            cells[c] = f"{cells[c]} {s.text}".strip()
        top, low = min(s.y0 for s in row), max(s.y1 for s in row)
        if rows and not cells[0] and top - rows[-1][1] < height * TABLE_FOLD:
            rows[-1] = ([f"{a} {b}".strip() for a, b in zip(rows[-1][0], cells, strict=True)], low)
        else:
            rows.append((cells, low))
    return [cells for cells, _ in rows]


def pipe_table(rows: list[list[str]]) -> str:
    most = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "/") for c in [*r, *[""] * (most - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * most) + " |", *map(line, rows[1:])]) if rows else ""


def headed(rows: list[list[Seg]]) -> bool:
    """Whether the first cell is a word that heads tables."""
    return bool(rows) and rows[0][0].text.strip().lower() in HEADER_WORDS


def pair_blocks(pairs: list) -> list[Block]:
    return [Block("kv", 0, "", p.label, p.value, p.y, p.x) for p, _ in pairs]


def region_of(rows: list[list[Seg]], scales: Scales) -> list[Block] | None:
    """The blocks of a run of rows of several cells, null where it reads best as plain lines."""
    segs = [s._replace(at=i) for i, s in enumerate(s for r in rows for s in r)]
    box = around([(s.x0, s.y0, s.x1, s.y1) for s in segs])
    if headed(rows) and max(map(len, rows)) > 1:
        return [Block("table", 0, pipe_table(table_of(segs, scales.height)), "", "", box[1], box[0])]
    best, _, pairs = interpret(segs, scales.height, scales.pitch, scales.width, plain_vote)
    if best.kind == "kv":
        return pair_blocks(pairs)
    return [Block("table", 0, pipe_table(table_of(segs, scales.height)), "", "", box[1], box[0])] if best.kind == "table" else None


def list_starts(lines: list[Line], scales: Scales) -> set[int]:
    """The lines that begin items of a list whose bullets are lost: two or more leads with sentences on one left edge, each with the lines
    wrapped below it."""
    edge, found, i = max(scales.height, scales.width * 0.02), set(), 0
    leads = [bool(lead) and len(rest.split()) >= SENTENCE for lead, rest in map(Line.lead, lines)]
    while i < len(lines):
        j, run = i + 1, [i]
        while leads[i] and j < len(lines):
            if leads[j] and abs(lines[j].box[0] - lines[i].box[0]) < edge:
                run.append(j)
            elif leads[j] or lines[j].box[0] < lines[i].box[0] - edge or lines[j].cy - lines[j - 1].cy >= scales.pitch * RUN_STEP:
                break
            j += 1
        if leads[i] and len(run) > 1:
            found |= set(run)
        i = j if leads[i] else i + 1
    return found


class Merger:
    """Lines in reading order to blocks. At most one of a paragraph, a list and a label line is open."""

    def __init__(self, scales: Scales, headings: bool = True) -> None:
        self.scales, self.headings = scales, headings
        self.out: list[Block] = []
        self.para: list[Line] = []
        self.items: list[Block] = []
        self.edge = self.last = 0.0  # of the open list: its text's left edge, its last line's center
        self.pair_at: float | None = None  # the center of the label line that `out` ends with, while it may go on
        self.first = True

    def close(self) -> None:
        if self.para:
            box = around([x.box for x in self.para])
            self.out.append(Block("paragraph", 0, " ".join(" ".join(x.text for x in self.para).split()), "", "", box[1], box[0]))
        self.out += self.items
        self.para, self.items = [], []

    def blocks(self, found: list[Block]) -> None:
        self.close()
        self.out += found

    def starts_item(self, line: Line, listed: bool) -> bool:
        """Opens or goes on with a list if the line begins an item of one."""
        s, (lead, rest) = self.scales, line.lead()
        bullet = line.bullet(s.height)
        indented = line.box[0] > s.left + s.height * INDENT
        beside = bool(self.items) and abs(line.box[0] - self.edge) < s.height * LIST_EDGE
        if not (bullet or listed or lead and (indented or beside)):
            return False
        lead, rest = bullet or (lead, rest)
        if not self.items:
            self.close()
            self.edge = line.second if bullet and line.second is not None else line.box[0]
            before = self.out[-1] if self.out else None
            if before and before.kind == "kv" and abs(before.x - self.edge) < s.height * PULLED:
                self.items.append(Block("listItem", 0, before.value, before.label, "", before.y, before.x))
                self.out.pop()
        self.items.append(Block("listItem", 0, rest, lead, "", line.box[1], line.box[0]))
        self.last = line.cy
        return True

    def goes_on(self, line: Line) -> bool:
        """Whether the line was taken as part of the list item above."""
        s = self.scales
        beside = line.box[0] > s.left + s.height * INDENT or abs(line.box[0] - self.edge) < s.height * LIST_EDGE
        if not self.items or not beside or line.cy - self.last >= s.pitch * ITEM_STEP:
            return False
        self.items[-1] = self.items[-1]._replace(text=" ".join(f"{self.items[-1].text} {line.text}".split()))
        self.last = line.cy
        return True

    def wraps(self, line: Line) -> bool:
        """Whether the line was taken as the rest of the value above."""
        s = self.scales
        if self.pair_at is None or self.para or not 0 < line.cy - self.pair_at <= s.pitch * LINE_STEP or abs(line.box[0] - self.out[-1].x) >= s.height * MARGIN:
            return False
        self.out[-1] = self.out[-1]._replace(value=" ".join(f"{self.out[-1].value} {line.text}".split()))
        self.pair_at = line.cy
        return True

    def add(self, line: Line, listed: bool) -> None:
        s, text = self.scales, line.text.strip()
        x0, y0, x1, _ = line.box
        opens, self.first = self.first, False
        if x1 - x0 > s.width * 0.5 and re.fullmatch(r"[-–—_=.]+", re.sub(r"\s", "", text)):
            self.close()
            self.pair_at = None
            self.out.append(Block("rule", 0, "", "", "", y0, x0))
            return
        if opens and self.headings and len(text.split()) <= TITLE_WORDS and len(text) > 1:
            self.out.append(Block("heading", 1, text, "", "", y0, x0))
            return
        if self.starts_item(line, listed):
            self.pair_at = None
            return
        if self.goes_on(line):
            return
        self.out += self.items
        self.items = []
        if pair := kv_line(text):
            self.close()
            self.out.append(Block("kv", 0, "", *pair, y0, x0))
            self.pair_at = line.cy
            return
        if self.headings and heading_like(text, x1 - x0, s.width):
            self.close()
            self.pair_at = None
            centered = y0 < s.height * TITLE_BAND and abs((x0 + x1) / 2 - s.width / 2) < s.width * 0.12
            self.out.append(Block("heading", 3 if re.match(t.SPECIAL_HEADING, text) else 1 if centered else 2, text, "", "", y0, x0))
            return
        if self.wraps(line):
            return
        self.pair_at = None
        if self.para and (line.cy - self.para[-1].cy > s.pitch * LINE_STEP or abs(x0 - self.para[-1].box[0]) >= s.height * MARGIN):
            self.close()
        self.para.append(line)


def assemble(lines: list[Line], scales: Scales, headings: bool = True) -> list[Block]:
    """Blocks of a page's or region's segments.

    A row of several cells begins a region, which goes on while rows have several cells or one far right of the body's edge; regions of two
    or more rows are interpreted, and where that fails the next row is tried. Regions and other segments are put in reading order, and the
    segments merged. Without headings no line is one.
    """
    if not lines:
        return []
    rows = rows_of([Seg(i, " ".join(x.text.split()), *x.box, *plain_vote(x.text)) for i, x in enumerate(lines)], scales.height)
    atoms: list[tuple[Box, list[Block] | None, int]] = []
    inside: set[int] = set()
    i = 0
    while i < len(rows):
        j = i + 1
        if len(rows[i]) > 1:
            while j < len(rows) and (len(rows[j]) > 1 or rows[j][0].x0 > scales.left + scales.height * CELL):
                j += 1
            if j - i > 1 and (found := region_of(rows[i:j], scales)) is not None:
                own = [s for r in rows[i:j] for s in r]
                atoms.append((around([(s.x0, s.y0, s.x1, s.y1) for s in own]), found, -1))
                inside |= {s.at for s in own}
                i = j
                continue
        i += 1
    atoms += [(x.box, None, i) for i, x in enumerate(lines) if i not in inside]
    order = [atoms[k] for k in cut_order([a[0] for a in atoms], scales.height * CUT)]
    loose = [k for _, found, k in order if found is None]
    listed = {loose[i] for i in list_starts([lines[k] for k in loose], scales)}
    merger = Merger(scales, headings)
    for _, found, k in order:
        if found is None:
            merger.add(lines[k], k in listed)
        else:
            merger.blocks(found)
    merger.close()
    return merger.out


BLOCKS = "page_id long, block_id long, kind string, depth int, text string, label string, value string"


def assemble_pages(segments: DataFrame) -> DataFrame:
    """(page_id, block_id, kind, depth, text, label, value) of segments(page_id, seg, text, x0, y0, x1, y1, page_width), page by page. Where
    segments have them, second_x0 and first_x1 (where the second word begins and the first ends) tell bullets that are set off."""
    known = {"second_x0", "first_x1"} <= set(segments.columns)

    def run(page: list) -> list[tuple]:
        lines = [Line(s.text, (s.x0, s.y0, s.x1, s.y1), *((s.second_x0, s.first_x1) if known else ())) for s in page]
        found = assemble(lines, page_scales([x.box for x in lines], page[0].page_width))
        return [(page[0].page_id, i, b.kind, b.depth, b.text, b.label, b.value) for i, b in enumerate(found)]

    return map_groups(segments, "page_id", ["seg"], run, BLOCKS)
