"""Documents from regions: order with orphans spliced in, neighbouring text joined, each region read by its kind, and the choice between a
model's reading and the source's own."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators.anchoring import Pool
from vellum.operators.assembly import Block, Line, Scales, assemble, headed, kv_line, page_scales, pair_blocks, pipe_table, table_of
from vellum.operators.grouped import map_groups
from vellum.operators.layout import Box, around
from vellum.operators.markup import without_repeats
from vellum.operators.pairing import Seg, interpret, plain_vote, rows_of
from vellum.operators.readings import anchored, blocks_of

#: Gaps in line heights for joined text and orphans; overlap of joined text, and of what stands on one height.
JOIN_GAP, JOIN_OVERLAP, ORPHAN_GAP, SAME_LEVEL = 2.2, 0.25, 2.5, 0.3


class Region(NamedTuple):
    """A layout region with its rank in the learned order (-1: made of orphans), kind, box and lines (text, box)."""

    key: str
    rank: int
    kind: str
    box: Box
    lines: list[tuple[str, Box]]


def orphan_regions(lines: list[tuple[str, Box]], height: float) -> list[Region]:
    """Regions of lines that no region takes: from the top, a gap of over 2.5 lines begins the next."""
    groups: list[list[tuple[str, Box]]] = []
    for line in sorted(lines, key=lambda x: (x[1][1], x[1][0])):
        if not groups or line[1][1] - max(b[3] for _, b in groups[-1]) > height * ORPHAN_GAP:
            groups.append([])
        groups[-1].append(line)
    return [Region(f"orphan-{i}", -1, "text", around([b for _, b in g]), g) for i, g in enumerate(groups)]


def spliced(regions: list[Region], width: float) -> list[Region]:
    """Regions in learned order. One made of orphans stands before the first of these that is on the height of its first line and begins
    right of it, or whose middle is lower."""
    out = sorted((r for r in regions if r.rank >= 0), key=lambda r: r.rank)
    for new in (r for r in regions if r.rank < 0):
        line = min((b for _, b in new.lines), key=lambda b: (b[1], b[0]), default=new.box)

        def follows(r: Region, line=line) -> bool:
            both, least = min(line[3], r.box[3]) - max(line[1], r.box[1]), min(line[3] - line[1], r.box[3] - r.box[1])
            if least > 0 and both / least > SAME_LEVEL:
                return r.box[0] > line[0]
            return r.box[1] + r.box[3] > line[1] + line[3]

        at = next((i for i, r in enumerate(out) if r.rank >= 0 and follows(r)), len(out))
        out.insert(at, new)
    return out


def coalesced(regions: list[Region], height: float) -> list[Region]:
    """Neighbours in order that are text, stand close below each other and share a quarter of the smaller width become one."""
    out: list[Region] = []
    for r in regions:
        p = out[-1] if out else None
        if p and p.kind == r.kind == "text":
            gap = r.box[1] - p.box[3]
            over = min(p.box[2], r.box[2]) - max(p.box[0], r.box[0])
            if gap < height * JOIN_GAP and over > JOIN_OVERLAP * min(p.box[2] - p.box[0], r.box[2] - r.box[0]):
                out[-1] = p._replace(box=around([p.box, r.box]), lines=p.lines + r.lines)
                continue
        out.append(r)
    return out


def lexicon_of(regions: list[Region], orphans: list[tuple[str, Box]], scales: Scales) -> dict[str, set[str]]:
    """For each region the label keys that other parts of the page vouch for: texts that end with a colon anywhere, and first-row cells of up
    to four words of other table regions."""
    base = {key(x) for x in [*(x for r in regions for x, _ in r.lines), *(x for x, _ in orphans)] if x.strip().endswith(":") and len(x.split()) <= 7}
    first = {}
    for r in regions:
        if r.kind == "table" and r.lines:
            rows = rows_of([Seg(i, x, *b, 0.0, False) for i, (x, b) in enumerate(r.lines)], scales.height)
            first[r.key] = {key(s.text) for s in rows[0] if s.text.strip() and len(s.text.split()) <= 4}
    return {r.key: base.union(*(k for other, k in first.items() if other != r.key)) for r in regions}


def key(text: str) -> str:
    """The form in which labels are listed."""
    return " ".join(text.strip().lower().removesuffix(":").split())


def vouched(segs: list[Seg], lexicon: set[str]) -> list[Seg]:
    """Segments with the lexicon's half vote for texts that it lists, where their form alone doesn't decide."""
    return [s if s.strong or key(s.text) not in lexicon else s._replace(v=max(-1.0, min(1.0, s.v + 0.5))) for s in segs]


def table_region(r: Region, scales: Scales, lexicon: set[str]) -> list[Block]:
    """The blocks of a region that the layout calls a table: pairs below a swallowed heading where it reads so, a grid otherwise."""
    lines = sorted(r.lines, key=lambda x: (x[1][1], x[1][0]))
    segs = vouched([Seg(i, " ".join(x.split()), *b, *plain_vote(x)) for i, (x, b) in enumerate(lines)], lexicon)
    rows = rows_of(segs, scales.height)
    head = rows[0][0] if len(rows) >= 3 and len(rows[0]) == 1 else None
    if head and (len(head.text.split()) > 8 or head.text.strip()[-1:] in tuple(".,;:")):
        head = None
    body = rows[1:] if head else rows
    best, _, pairs = interpret([s._replace(at=i) for i, s in enumerate(s for row in body for s in row)], scales.height, scales.pitch, scales.width, plain_vote, True)
    if best.kind == "kv" and not headed(body):
        return [*([Block("heading", 2, head.text.strip(), "", "", head.y0, head.x0)] if head else []), *pair_blocks(pairs)]
    return [Block("table", 0, pipe_table(table_of(segs, scales.height)), "", "", r.box[1], r.box[0])]


def single_line(text: str, box: Box, scales: Scales) -> list[Block]:
    """A region of one line: a rule, a bullet, a pair or a paragraph. It is no list item without a bullet."""
    line = Line(" ".join(text.split()), box)
    if box[2] - box[0] > scales.width * 0.5 and re.fullmatch(r"[-–—_=.]+", re.sub(r"\s", "", text)):
        return [Block("rule", 0, "", "", "", box[1], box[0])]
    if bullet := line.bullet(scales.height):
        return [Block("listItem", 0, bullet[1], bullet[0], "", box[1], box[0])]
    pair = kv_line(line.text)
    return [Block("kv", 0, "", *pair, box[1], box[0]) if pair else Block("paragraph", 0, line.text, "", "", box[1], box[0])]


def region_blocks(r: Region, scales: Scales, lexicon: set[str] = frozenset()) -> list[Block]:
    """A region's blocks by its kind: one heading for titles, a placeholder for pictures without text, a grid or pairs for tables, and lines
    at the page's scales for the rest."""
    lines = sorted(r.lines, key=lambda x: (x[1][1], x[1][0]))
    if r.kind in ("title", "heading"):
        text = " ".join(" ".join(x for x, _ in lines).split())
        return [Block("heading", 1 if r.kind == "title" else 2, text, "", "", r.box[1], r.box[0])] if text else []
    if not lines:
        return [Block("paragraph", 0, "[image]", "", "", r.box[1], r.box[0])] if r.kind == "imageish" else []
    if r.kind == "table":
        return table_region(r, scales, lexicon)
    return single_line(*lines[0], scales) if len(lines) == 1 else assemble([Line(" ".join(x.split()), b) for x, b in lines], scales, headings=False)


def page_blocks(regions: list[Region], orphans: list[tuple[str, Box]], width: float) -> list[tuple[Region, list[Block]]]:
    boxes = [b for r in regions for _, b in r.lines] + [b for _, b in orphans]
    scales = page_scales(boxes, width) if boxes else Scales(12.0, 0.0, 12.0, width)
    lexicon = lexicon_of(regions, orphans, scales)
    order = coalesced(spliced([*regions, *orphan_regions(orphans, scales.height)], width), scales.height)
    return [(r, region_blocks(r, scales, lexicon.get(r.key, set()))) for r in order]


def with_readings(found: list[tuple[Region, list[Block]]], readings: dict[str, str], mode: str = "tables-only", policy: str = "replace") -> tuple[list[Block], list[str]]:
    """The page's blocks with the model's readings, and what happened to their numbers.

    A reading becomes blocks by its region's kind, and its numbers are anchored in the numbers of the source, region by region in order. A
    table that the source reads as pairs keeps them; a table's reading that repeats itself at the end isn't used, nor is one without blocks.
    In mode tables-only, readings of other regions than tables aren't used. A pair whose value is left without a letter or digit becomes text.
    """
    index = {r.key: i for i, (r, _) in enumerate(found)}
    pool = Pool([(index[r.key], x.rstrip(".,/:%-")) for r, _ in found for text, _ in r.lines for x in re.findall(t.NUMBER, text, flags=re.ASCII)])
    out: list[Block] = []
    kinds: list[str] = []
    for r, own in found:
        text, repeats = without_repeats(readings.get(r.key))
        table = r.kind == "table"
        use = text and (table and not repeats and not any(b.kind == "kv" for b in own) or not table and mode != "tables-only")
        read = blocks_of(text, r.kind) if use else []
        if not read:
            out += own
            continue
        read, items, _ = anchored(read, index[r.key], pool, policy)
        kinds += [e.kind for e in items]
        for b in read:
            if b.kind == "kv" and not re.search(r"\w", b.value):
                out.append(Block("paragraph", 0, b.label, "", "", r.box[1], r.box[0]))
            else:
                out.append(Block(b.kind, b.depth, pipe_table([list(c) for c in b.cells]) if b.kind == "table" else b.text, b.label, b.value, r.box[1], r.box[0]))
    return out, kinds


DOCUMENT = "page_id long, block_id long, kind string, depth int, text string, label string, value string, events string"


def documents(lines: DataFrame, mode: str = "tables-only", policy: str = "replace") -> DataFrame:
    """(page_id, block_id, kind, depth, text, label, value, events) of pages.

    lines(page_id, ord, region_key, rank, region_kind, rx0, ry0, rx1, ry1, text, x0, y0, x1, y1, page_width, reading): a row for each line with
    its region (region_key null for orphans) and the region's reading, null where there is none.
    """

    def run(page: list) -> list[tuple]:
        by: dict[str, list] = {}
        orphans = []
        for r in page:
            if r.region_key is None:
                orphans.append((r.text, (r.x0, r.y0, r.x1, r.y1)))
            else:
                by.setdefault(r.region_key, []).append(r)
        regions = [Region(k, int(own[0].rank), own[0].region_kind, (own[0].rx0, own[0].ry0, own[0].rx1, own[0].ry1), [(r.text, (r.x0, r.y0, r.x1, r.y1)) for r in own if r.text is not None]) for k, own in by.items()]
        blocks, events = with_readings(page_blocks(regions, orphans, page[0].page_width), {k: own[0].reading for k, own in by.items()}, mode, policy)
        return [(page[0].page_id, i, b.kind, b.depth, b.text, b.label, b.value, ",".join(events)) for i, b in enumerate(blocks)]

    return map_groups(lines, "page_id", ["ord"], run, DOCUMENT)


def routed(deep: DataFrame, quick: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blocks of the deep reading, or of the quick one for pages whose verdict is fallback."""
    back = verdicts.where("verdict = 'fallback'").select("page_id")
    return deep.join(back, "page_id", "left_anti").unionByName(quick.join(back, "page_id", "left_semi"))


def lexicon_without_self(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(page_id, region_id, key): label keys known on the page, and first-row cells of up to four words of its other table regions.

    rows(page_id, region_id, text) are first rows; base(page_id, key).
    """
    cells = rows.where(F.size(t.words_of(F.col("text"))) <= 4).select("page_id", F.col("region_id").alias("other"), t.lexicon_key(F.col("text")).alias("key"))
    own = rows.select("page_id", "region_id").distinct()
    return own.join(base, "page_id").select("page_id", "region_id", "key").union(own.join(cells, "page_id").where("region_id <> other").select("page_id", "region_id", "key")).distinct()


def empty_value(value: Column) -> Column:
    """Whether a pair's value has nothing left to read."""
    return ~value.rlike(r"[\p{L}\p{N}]")
