"""Markdown and table markup as rows: GFM blocks, HTML tables and the cell dialect as grids, repeats cut off."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from vellum.functions import text as t

BLOCK = StructType([StructField(n, k) for n, k in (("kind", StringType()), ("depth", IntegerType()), ("text", StringType()), ("cells", ArrayType(ArrayType(StringType()))))])
HEADING, ITEM, RULE = re.compile(r"#{1,6}(?:\s|\Z)"), re.compile(r"(\s*)([-*+]|\d{1,9}[.)])(?:\s+(.*)|\Z)"), re.compile(r"(?:-\s*){3,}\Z|(?:\*\s*){3,}\Z|(?:_\s*){3,}\Z")
DASHED, UNDERLINE, FENCE, QUOTE, HTML_BLOCK = re.compile(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\Z"), re.compile(r"(=+|-+)\Z"), re.compile(r"(`{3,}|~{3,})"), re.compile(r">\s?"), re.compile(r"</?[a-zA-Z][^>]*>|<!--")
CELL_BAR = re.compile(r"(?<!\\)\|")
SPAN_MOST = 50
FOLDS = str.maketrans(dict.fromkeys(t.DASHES, "-") | dict.fromkeys(t.SINGLE_QUOTES, "'") | dict.fromkeys(t.DOUBLE_QUOTES, '"'))
#: Escaped signs stand aside as private characters while markup is read.
ESCAPED, ASIDE = re.compile(r"\\([!-/:-@\[-`{-~])"), 0xE100
UNESCAPED = {ASIDE + c: chr(c) for c in range(128)}
#: Inline markup and what stays of it: images, links, code, strong and plain emphasis, strikes, line breaks.
INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"<(https?://[^>\s]+)>"), r"\1"), (re.compile(r"(`+)(.+?)\1"), r"\2"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])"), r"\1"), (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"), (re.compile(r"~~(.+?)~~"), r"\1"),
    (re.compile(r"<br\s*/?>", re.IGNORECASE), " "),
]


def folded(text: str) -> str:
    """Compatibility form with dashes and quotes folded; white space stays."""
    return unicodedata.normalize("NFKC", text).translate(FOLDS)


def inline_text(md: str) -> str:
    """The text of inline Markdown, folded, white space collapsed."""
    md = ESCAPED.sub(lambda m: chr(ASIDE + ord(m[1])), md)
    for pattern, what in INLINE:
        md = pattern.sub(what, md)
    return " ".join(folded(html.unescape(md).translate(UNESCAPED)).split())


def cells_of(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline_text(c.replace("\\|", "|")) for c in CELL_BAR.split(line)]


def parse_blocks(md: str | None) -> list[tuple]:
    """Ordered blocks (kind, depth, text, cells) of a bounded part of GFM: headings of both kinds, list items (nested ones by depth, each with
    its own text), tables, rules and paragraphs, all with plain text. Quotes are read as what they quote; fenced code and HTML blocks are
    left out. Other constructs read as paragraphs."""
    out: list[tuple] = []
    open_as: tuple[str, int] | None = None  # kind and depth of the block that `held` belongs to
    held: list[str] = []
    lines = [QUOTE.sub("", x) if x.lstrip().startswith(">") else x for x in (md or "").split("\n")]
    at, margin = 0, 0

    def close() -> None:
        nonlocal open_as
        text = inline_text(" ".join(held))
        if open_as and (text or open_as[0] == "listItem"):
            out.append((*open_as, text, []))
        open_as = None
        held.clear()

    while at < len(lines):
        line = lines[at].rstrip()
        bare = line.strip()
        at += 1
        table = "|" in bare and at < len(lines) and "|" in lines[at] and DASHED.match(lines[at].strip()) and len(cells_of(bare)) == len(cells_of(lines[at]))
        if not bare:
            if open_as and open_as[0] == "paragraph":
                close()
            margin = 2  # a paragraph behind a blank line is an item's if it is indented
        elif fence := FENCE.match(bare):
            close()
            while at < len(lines) and not lines[at].strip().startswith(fence[1]):
                at += 1
            at += 1
        elif open_as and open_as[0] == "paragraph" and held and UNDERLINE.match(bare):
            open_as = ("heading", 1 if bare[0] == "=" else 2)
            close()
        elif HEADING.match(bare):
            close()
            marks = len(bare) - len(bare.lstrip("#"))
            out.append(("heading", marks, inline_text(re.sub(r"(?:^|\s)#+\Z", "", bare[marks:].strip())), []))
        elif RULE.match(bare):
            close()
            out.append(("rule", 0, "", []))
        elif table:
            close()
            rows, at = [cells_of(bare)], at + 1
            while at < len(lines) and lines[at].strip() and not (HEADING.match(lines[at].strip()) or RULE.match(lines[at].strip()) or ITEM.match(lines[at])):
                rows.append((cells_of(lines[at]) + [""] * len(rows[0]))[: len(rows[0])])
                at += 1
            out.append(("table", 0, "", rows))
        elif m := ITEM.match(line):
            close()
            open_as, margin = ("listItem", len(m[1]) // 2), 0
            held.append(m[3] or "")
        elif not open_as and HTML_BLOCK.match(bare):
            while at < len(lines) and lines[at].strip():
                at += 1
        else:
            if open_as and len(line) - len(line.lstrip()) < margin:
                close()
            open_as, margin = open_as or ("paragraph", 0), 0
            held.append(bare)
    close()
    return out


def block_text(kind: str, text: str, cells: list[list[str]], label: str = "", value: str = "") -> str:
    """All text of a block: a lead or label before it, cells row by row."""
    if kind == "table":
        return " ".join(c for row in cells for c in row)
    return "" if kind == "rule" else f"{label} {value}" if kind == "kv" else f"{label} {text}".strip()


def document_text(md: str | None) -> str:
    """A document's text in reading order, a line a block."""
    return "\n".join(x for kind, _, text, cells in parse_blocks(md) if (x := block_text(kind, text, cells)))


def cell_text(inner: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", " ", inner))).split())


def html_grid(page: str | None) -> list[list[str]]:
    """The first HTML table as rows of cells: spanned slots are filled with the cell's text, and several header rows become one."""
    table = re.search(r"(?is)<table\b.*?(?:</table\s*>|\Z)", page or "")
    grid: dict[tuple[int, int], str] = {}
    heads = 0
    rows = re.split(r"(?i)<tr\b[^>]*>", table[0])[1:] if table else []
    in_head = len(re.split(r"(?i)<tr\b", re.split(r"(?i)</thead\s*>", table[0])[0])) - 1 if table and re.search(r"(?i)</thead\s*>", table[0]) else 0
    leading = True
    for r, row in enumerate(rows):
        cells = re.findall(r"(?is)<(t[hd])\b([^>]*)>(.*?)(?=<t[hdr]\b|</t[hdr]\s*>|</table|</tbody|</thead|\Z)", row)
        c = 0
        for _, attrs, inner in cells:
            while (r, c) in grid:
                c += 1
            across, down = (max(1, min(SPAN_MOST, int(m[1]))) if (m := re.search(rf"(?i){k}\s*=\s*[\"']?(\d+)", attrs)) else 1 for k in ("colspan", "rowspan"))
            for i in range(down):
                for j in range(across):
                    grid.setdefault((r + i, c + j), cell_text(inner))
            c += across
        leading &= bool(cells) and all(k.lower() == "th" for k, *_ in cells)
        heads += leading or r < in_head
    if not grid:
        return []
    n, width = len(rows), 1 + max(c for _, c in grid)
    full = [[grid.get((r, c), "") for c in range(width)] for r in range(n)]
    if heads > 1:
        top = [" ".join(dict.fromkeys(x for x in (full[r][c] for r in range(heads)) if x)) for c in range(width)]
        full = [top, *full[heads:]]
    return full


def pipe_table(rows: list[list[str]]) -> str:
    """A pipe table: bars become slashes, short rows are filled."""
    most = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "/") for c in [*r, *[""] * (most - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * most) + " |", *map(line, rows[1:])]) if rows else ""


def with_pipe_tables(md: str) -> str:
    """Markdown with its HTML tables as pipe tables; those without any text go."""

    def one(m: re.Match) -> str:
        grid = html_grid(m[0])
        return f"\n\n{pipe_table(grid)}\n\n" if any(c.strip() for r in grid for c in r) else "\n\n"

    return re.sub(r"(?is)<table[\s>].*?(?:</table>|\Z)", one, md)


def cell_dialect(text: str) -> list[list[str]]:
    """cell_dialect_grid in plain Python: cells continued from a neighbour are empty."""
    rows = [[" ".join(inner.split()) if kind == "fcel" else "" for kind, inner in re.findall(r"<(fcel|ecel|lcel|ucel|xcel)>([^<]*)", row)] for row in text.split("<nl>")]
    return [r for r in rows if r] if re.search("<fcel>|<ecel>", text) else []


def cell_dialect_grid(c: Column) -> Column:
    """Rows of cells of the dialect in which <fcel> begins a full cell, <ecel> an empty one, <lcel>, <ucel> and <xcel> ones that continue a
    neighbour and so are empty, and <nl> ends a row."""
    marked = lambda row: F.regexp_extract_all(row, F.lit(r"(<(?:fcel|ecel|lcel|ucel|xcel)>[^<]*)"), F.lit(1))
    cells = lambda row: F.transform(marked(row), lambda x: F.when(x.startswith("<fcel>"), t.collapsed(F.substring(x, 7, 1 << 30))).otherwise(""))
    return F.filter(F.transform(F.split(c, "<nl>"), cells), lambda r: F.size(r) > 0)


#: A repeated tail's shortest and longest unit, the least repeats, and how many are looked at.
SHORTEST, LONGEST, REPEATS, MOST_REPEATS = 8, 120, 4, 1000


def without_repeats(text: str | None) -> tuple[str | None, bool]:
    """The text with a tail unit that stands there four times or more kept once, white space at the new end cut, and whether there is one."""
    if text is None:
        return None, False
    for size in range(SHORTEST, min(LONGEST, len(text) // REPEATS) + 1):
        unit, n = text[-size:], 1
        while n < MOST_REPEATS and (n + 1) * size <= len(text) and text.startswith(unit, len(text) - (n + 1) * size):
            n += 1
        if n >= REPEATS:
            return text[: len(text) - size * (n - 1)].rstrip(), True
    return text, False


def blocks_udf():
    @F.pandas_udf(ArrayType(BLOCK))
    def blocks(md: pd.Series) -> pd.Series:
        return md.map(lambda m: [dict(zip(BLOCK.names, b, strict=True)) for b in parse_blocks(m)])

    return blocks


def html_grid_udf():
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def grids(pages: pd.Series) -> pd.Series:
        return pages.map(html_grid)

    return grids


def without_repeats_udf():
    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("repetition", BooleanType())]))
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_repeats(x) for x in texts], columns=["text", "repetition"])

    return cut
