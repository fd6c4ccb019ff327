"""A model's readings of regions: cleaned, as blocks by the region's kind, and with their numbers anchored field by field."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators.anchoring import ENDS, Pool, anchor
from vellum.operators.assembly import kv_line
from vellum.operators.grouped import map_groups
from vellum.operators.markup import cell_dialect, folded, parse_blocks, pipe_table, with_pipe_tables

#: How conversational models begin an answer, lines that hold a pair, placeholders.
CHATTER = re.compile(r"(?:here(?:'s| is| are)\b|sure[,.!]|certainly[,.!]|below is\b|the (?:following|markdown|table|text) (?:is|shows|contains)\b|i (?:can|will|'ll)\b)", re.IGNORECASE)
PAIR_LINE = re.compile(r"\*\*([^*]+?)(:)?\*\*(:)?\s+(\S.*)\Z")
PLACEHOLDERS = ("[image]", "[signature]")


class Read(NamedTuple):
    """A block of a reading; a list item's lead is its label."""

    kind: str
    depth: int = 0
    text: str = ""
    label: str = ""
    value: str = ""
    cells: tuple[tuple[str, ...], ...] = ()


def cleaned(raw: str | None) -> str:
    """A reading without fences, comments and an opening remark, its characters folded line by line and its bullets written as dashes."""
    text = re.sub(r"\r\n?", "\n", raw or "").strip()
    if whole := re.fullmatch(r"```[A-Za-z]*\n(.*?)\n?```", text, re.DOTALL):
        text = whole[1]
    lines = [folded(x) for x in text.split("\n") if not x.strip().startswith("```")]
    lines = re.sub(r"(?s)<!--.*?-->", "", "\n".join(lines)).split("\n")
    start = next((i for i, x in enumerate(lines) if x.strip() and not CHATTER.match(x.strip())), len(lines))
    return "\n".join(re.sub(r"^(\s*)[•◦·▪‣*+](\s+)", r"\1-\2", x) for x in lines[start:]).strip()


def parts_of(md: str) -> list[tuple[str, str] | str]:
    """A reading as its bold label lines (pairs) and the Markdown between them; lines inside HTML tables stay Markdown."""
    out: list[tuple[str, str] | str] = []
    held: list[str] = []
    depth = 0
    for line in md.split("\n"):
        depth += len(re.findall(r"(?i)<table\b", line))
        m = None if depth else PAIR_LINE.match(line.strip())
        depth = max(0, depth - len(re.findall(r"(?i)</table>", line)))
        if m and (m[2] or m[3]) and (pair := kv_line(f"{m[1].strip()}: {m[4]}", lenient=True)):
            out += ["\n".join(held)] if held else []
            out.append(pair)
            held = []
        else:
            held.append(line)
    return out + (["\n".join(held)] if held else [])


def mapped(md: str, depth_of) -> list[Read]:
    """Blocks of Markdown; depth_of gives a heading's depth from its own."""
    out = []
    for part in parts_of(md):
        if isinstance(part, tuple):
            out.append(Read("kv", label=part[0], value=part[1]))
            continue
        for kind, depth, text, cells in parse_blocks(with_pipe_tables(part)):
            pair = kv_line(text) if kind in ("paragraph", "listItem") and text not in PLACEHOLDERS else None
            if kind == "table":
                out += [Read("table", cells=tuple(map(tuple, cells)))] if any(c.strip() for r in cells for c in r) else []
            elif kind == "rule":
                out.append(Read("rule"))
            elif not text:
                continue
            elif kind == "heading":
                out.append(Read("heading", depth_of(depth), text))
            elif kind == "listItem":
                out.append(Read("listItem", 0, pair[1] if pair else text, pair[0] if pair else ""))
            else:
                out.append(Read("kv", label=pair[0], value=pair[1]) if pair else Read("paragraph", 0, text))
    return out


def blocks_of(raw: str | None, kind: str) -> list[Read]:
    """A reading's blocks by the kind of its region; none where it is of no use for that kind.

    Titles and headings become one heading; a table keeps one line before it at most; a page keeps its headings' depths up to 3, other
    regions' headings have depth 3.
    """
    text = cleaned(raw)
    if not text:
        return []
    if kind in ("title", "heading"):
        flat = " ".join(" ".join(c for r in cells for c in r) if k == "table" else x for k, _, x, cells in parse_blocks(with_pipe_tables(text)))
        flat = " ".join(flat.split())
        return [Read("heading", 1 if kind == "title" else 2, flat)] if flat else []
    if kind == "table":
        if any(c for r in cell_dialect(text) for c in r):
            return [Read("table", cells=tuple(map(tuple, cell_dialect(text))))]
        found = mapped(text, lambda _: 3)
        at = next((i for i, b in enumerate(found) if b.kind == "table"), None)
        if at is None:
            return []
        return [*[b for b in found[:at] if b.kind in ("heading", "paragraph", "kv")][:1], found[at]]
    return mapped(text, (lambda d: min(3, max(1, d))) if kind == "page" else (lambda _: 3))


class Item(NamedTuple):
    """A number for review: what happened to it, in which field of which block (cell: row and column), and where there."""

    kind: str
    block: int
    field: str
    row: int
    col: int
    start: int
    end: int
    source: str | None
    token: str
    severity: str


def anchored(blocks: list[Read], region: int, pool: Pool, policy: str = "replace") -> tuple[list[Read], list[Item], Counter]:
    """The blocks with the numbers of all fields anchored in turn, the review items, and counts by what happened."""
    items: list[Item] = []
    counts: Counter = Counter()

    def one(text: str, block: int, field: str, row: int = -1, col: int = -1) -> str:
        new, events, own = anchor(text, region, pool, policy)
        items.extend(Item(e.kind, block, field, row, col, e.start, e.end, e.source, e.token, e.severity) for e in events)
        counts.update(own)
        return new

    out = []
    for i, b in enumerate(blocks):
        if b.kind == "table":
            b = b._replace(cells=tuple(tuple(one(c, i, "cell", r, k) for k, c in enumerate(row)) for r, row in enumerate(b.cells)))
        elif b.kind == "kv":
            b = b._replace(label=one(b.label, i, "label"), value=one(b.value, i, "value"))
        elif b.kind != "rule":
            b = b._replace(label=one(b.label, i, "lead") if b.label else "", text=one(b.text, i, "text"))
        out.append(b)
    return out, items, counts


#: What an anchored number can be, besides exact; the columns of their counts.
OUTCOMES = ("split-joined", "replaced", "dropped", "flagged", "ambiguous")
READ = "page_id long, region long, block_id long, kind string, depth int, text string, label string, value string, cells array<array<string>>"
ITEMS = "page_id long, region long, block_id long, kind string, field string, row int, col int, start int, end int, source string, token string, severity string"
COUNTED = f"page_id long, total long, exact long, {', '.join(x.replace('-', '_') + ' long' for x in OUTCOMES)}"


def reading_blocks(readings: DataFrame) -> DataFrame:
    """(page_id, region, block_id, kind, depth, text, label, value, cells): a row for each block of readings(page_id, region, kind, reading)."""

    def run(page: list) -> list[tuple]:
        return [(r.page_id, r.region, i, b.kind, b.depth, b.text, b.label, b.value, [list(x) for x in b.cells]) for r in page for i, b in enumerate(blocks_of(r.reading, r.kind))]

    return map_groups(readings.select("page_id", "region", "kind", "reading"), "page_id", ["region"], run, READ)


def anchored_pages(readings: DataFrame, source: DataFrame, policy: str = "replace", what: str = "items") -> DataFrame:
    """Readings(page_id, region, kind, reading) anchored in source(page_id, region, ord, text), page by page in order of regions.

    Lines of equal ord and readings of one region are taken in order of their kinds and texts, so that each number's fate is always the same.
    what: items (a row for each number to review), blocks (as reading_blocks gives them, anchored) or counts (a row a page: how many numbers
    there are, and what happened to them).
    """

    def run(page: list) -> list[tuple]:
        pool = Pool([(int(r.region), x.rstrip(ENDS)) for r in page if r.kind is None for x in re.findall(t.NUMBER, r.text or "", flags=re.ASCII)])
        rows: list[tuple] = []
        total: Counter = Counter()
        for r in page:
            if r.kind is not None:
                found, items, counts = anchored(blocks_of(r.text, r.kind), int(r.region), pool, policy)
                total.update(counts)
                if what == "blocks":
                    rows += [(r.page_id, r.region, i, b.kind, b.depth, b.text, b.label, b.value, [list(x) for x in b.cells]) for i, b in enumerate(found)]
                elif what == "items":
                    rows += [(r.page_id, r.region, x.block, x.kind, x.field, x.row, x.col, x.start, x.end, x.source, x.token, x.severity) for x in items]
        return rows if what != "counts" else [(page[0].page_id, total["total"], total["exact"], *(total[k] for k in OUTCOMES))]

    # lines of no region come last in the pool
    lines = source.select("page_id", F.lit(0).alias("phase"), F.when(F.col("region") < 0, (1 << 63) - 1).otherwise(F.col("region")).cast("long").alias("place"), F.col("region").cast("long").alias("region"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast("string").alias("kind"), "text")
    read = readings.select("page_id", F.lit(1).alias("phase"), F.col("region").cast("long").alias("place"), F.col("region").cast("long").alias("region"), F.lit(0).cast("long").alias("ord"), "kind", F.col("reading").alias("text"))
    return map_groups(lines.union(read), "page_id", ["phase", "place", "ord", "region", "kind", "text"], run, {"items": ITEMS, "blocks": READ, "counts": COUNTED}[what])


def as_markdown(b: Read) -> str:
    """The Markdown of one block."""
    if b.kind == "table":
        return pipe_table([list(r) for r in b.cells])
    if b.kind == "kv":
        return f"**{b.label}:** {b.value}"
    return {"heading": f"{'#' * b.depth} {b.text}", "listItem": f"- **{b.label}:** {b.text}" if b.label else f"- {b.text}", "rule": "---"}.get(b.kind, b.text)
