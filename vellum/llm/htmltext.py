"""Main text of web pages from flat text blocks.

A page is read as a flat row of text blocks: what stands between block-level tags. Each block has its word count and link density, those of
its neighbours, and weak signs of its surroundings (whether it stands in an element that calls itself an article, or furniture such as a
menu or a comment list; whether it is a heading). A decision tree, trained here on a table of labelled pages that a rule below builds in
many layouts, decides for each block whether it is main text. Reading a page takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import in_slices, small_batches, table

NAME = re.compile(r"[a-z][a-z0-9:-]*", re.IGNORECASE)
STOP = re.compile(r"=\s*[\"']|[<>]")
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: A quoted value longer than this counts as a quote that isn't closed.
VALUE = 8192
#: Elements whose content isn't text of the page, block-level elements, elements of page furniture, and void elements.
RAW = set("script style noscript template svg iframe object textarea title".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = set("nav aside footer form button select menu dialog fieldset head label input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Names in class, id and role that tell furniture from content, alone or as the last part of a name; those that also tell it as
#: the first part; parts that take the meaning away.
FURNITURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar"
    " modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe tags toolbar topbar widget widgets alert complementary contentinfo".split()
)
LEADING_WORDS = set("ad ads advert breadcrumb comment comments cookie footer menu nav newsletter promo related share sidebar social sponsored".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
NEUTRAL_PARTS = set("no has have with without not hide show layout wrapper container page grid col column main content entry article story text free open closed left right".split())
CONTENT_WORDS = set("article articlebody content entry main post story text".split())
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+")
#: How surely an element is furniture: it isn't; by a part of a name; by a whole name or a tag that often wraps more; by its tag or as comments.
NONE, PART, SOFT, HARD = range(4)


class Block(NamedTuple):
    text: str
    words: int
    linked: float
    furniture: int
    content: bool
    heading: bool


def mark_of(tag: str, names: list[str], inside_content: bool) -> int:
    """How surely an element is furniture."""
    if tag in ("html", "body"):
        return NONE
    if tag in FURNITURE:
        return SOFT if tag in ("form", "fieldset") else HARD
    found = SOFT if tag == "header" and not inside_content else NONE
    for name in names:
        parts = PARTS.findall(name)
        if name in FURNITURE_WORDS:
            found = max(found, HARD if name in COMMENT_WORDS else SOFT)
        elif len(parts) > 1 and not NEUTRAL_PARTS & set(parts):
            if parts[0] in COMMENT_WORDS or parts[-1] in COMMENT_WORDS:
                found = HARD
            elif parts[-1] in FURNITURE_WORDS or parts[0] in LEADING_WORDS:
                found = max(found, PART)
    return found


def tag_end(page: str, at: int) -> tuple[int, int]:
    """Where the inside of a tag ends that goes on at `at`, and where reading goes on. A quote that isn't closed, or whose value looks like
    markup up to the next attribute, doesn't count; a tag ends before the next one at the latest."""
    loose = at
    while m := STOP.search(page, at):
        sign = page[m.end() - 1]
        if sign == ">":
            return m.start(), m.end()
        if sign == "<":
            return m.start(), m.start()
        close = page.find(sign, m.end(), m.end() + VALUE)
        if close < 0 or page.find(">", m.end(), close) >= 0 and page[close - 1] == "=":
            loose = m.end()
            end = page.find(">", loose)
            return (len(page), len(page)) if end < 0 else (end, end + 1)
        at = close + 1
    return len(page), len(page)


class Reader:
    """Collects the text blocks of one page. Only the outermost furniture element counts, and an article inside one that isn't surely
    furniture is content again."""

    def __init__(self) -> None:
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, mark, content, heading
        self.open: dict[str, int] = defaultdict(int)
        self.marks: list[list[int]] = [[NONE, 0]]  # strength, words
        self.inside_link = False

    def text(self, run: str) -> None:
        self.parts.append(run)
        if self.inside_link:
            self.linked += len(run)

    def close(self) -> None:
        text = SPACE.sub(" ", html_lib.unescape("".join(self.parts))).strip()
        if text:
            _, mark, content, heading = self.stack[-1] if self.stack else ("", 0, False, False)
            words = len(text.split())
            self.marks[mark][1] += words
            self.blocks.append([text, words, min(1.0, self.linked / max(1, sum(map(len, self.parts)))), mark, content, heading])
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def begin(self, tag: str, inside: str) -> None:
        self.close()
        if tag in VOID or inside.rstrip().endswith("/"):
            return
        while self.stack and (self.stack[-1][0] == tag and tag in ("p", "li", "option", "dt", "dd") or self.stack[-1][0] == "p"):  # their end tags may be missing
            self.pop()
        _, mark, content, heading = self.stack[-1] if self.stack else ("", 0, False, False)
        names = [n for m in ATTRIBUTE.finditer(inside) for n in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in inside else []
        own = mark_of(tag, names, content)
        names_content = tag in ("article", "main") or tag in ("div", "section", "td") and bool(CONTENT_WORDS & set(names))
        if own and not self.marks[mark][0]:
            mark = len(self.marks)
            self.marks.append([own, 0])
        elif own > self.marks[mark][0]:
            mark = len(self.marks)
            self.marks.append([own, 0])
        elif not own and tag in ("article", "main") and self.marks[mark][0] < HARD:
            mark = 0
        self.open[tag] += 1
        self.stack.append((tag, mark, content or names_content and not own, heading or tag in HEADINGS))

    def end(self, tag: str) -> None:
        self.close()
        self.inside_link = False
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def found(self) -> list[Block]:
        """The blocks. Where nothing else on the page reads like text, an element that holds most of its words isn't furniture."""
        self.close()
        said = sum(words for _, words in self.marks)
        if not any(words >= 15 and linked < 0.5 and not self.marks[mark][0] for _, words, linked, mark, *_ in self.blocks):
            for mark in self.marks:
                if mark[0] < HARD and 2 * mark[1] > said:
                    mark[0] = NONE
        return [Block(text, words, linked, self.marks[mark][0], content, heading) for text, words, linked, mark, content, heading in self.blocks]


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order; character references decoded, white space inside a block one space."""
    page = page or ""
    reader, at, unclosed = Reader(), 0, set()
    while (start := page.find("<", at)) >= 0:
        if start > at:
            reader.text(page[at:start])
        ends, name = page.startswith("/", start + 1), NAME.match(page, start + 1 + page.startswith("/", start + 1))
        if name is None:
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = len(page) if close < 0 else close + 3
            elif page.startswith(("<!", "<?", "</"), start):
                close = page.find(">", start)
                at = len(page) if close < 0 else close + 1
            else:
                reader.text("<")
                at = start + 1
            continue
        tag = name[0].lower()
        stop, at = tag_end(page, name.end())
        inside = page[name.end() : stop]
        if tag in RAW and not ends and not inside.endswith("/") and tag not in unclosed:
            if close := re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at):
                at = tag_end(page, close.end())[1]
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(tag)
        elif tag == "a":
            reader.inside_link = not ends
        elif tag == "br":
            reader.text(" ")
        elif tag in BLOCK or tag in FURNITURE:
            if ends:
                reader.end(tag)
            else:
                reader.begin(tag, inside)
    if at < len(page):
        reader.text(page[at:])
    return reader.found()


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words and link density of the one before, itself and the next; the words of the longer neighbour two blocks off; how
    surely it is furniture; whether it is content, whether the page marks content at all; whether it is a heading."""
    marked = float(any(b.content and not b.furniture for b in blocks))
    none = Block("", 0, 0.0, NONE, False, False)
    far = [none, none, *blocks, none, none]
    rows = []
    for k, b in enumerate(blocks, 2):
        before, after = far[k - 1], far[k + 1]
        rows.append((b.words, b.linked, before.words, before.linked, after.words, after.linked, max(far[k - 2].words, far[k + 2].words), float(b.furniture), float(b.content), marked, float(b.heading)))
    return rows


#: Marks main text in labelled pages; it is taken out before blocks are measured.
MAIN = "\ue000"
WORDS = (
    "the of a and in to was it on that for with as they by at from were had their his not but which one all when there been into more than out up over after then two time long many water house town river road year old little"
    " great came went saw made took found under between before children people winter summer morning evening harvest village bridge market bread stone field garden boat letter window night"
).split()


def labelled_pages(seed: int = 11) -> list[str]:
    """The labelled table: pages of all layouts below, in which each block of main text begins with MAIN."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."

    def main(tag: str, text: str) -> str:
        return f"<{tag}>{MAIN}{text}</{tag}>"

    def menu() -> str:
        links = [f'<a href="/{i}">{rng.choice(WORDS).capitalize()} {rng.choice(WORDS) if rng.random() < 0.5 else ""}</a>' for i in range(rng.randint(3, 8))]
        return rng.choice(
            [
                "<nav><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></nav>",
                "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>",
                "<div>" + " | ".join(links) + "</div>",
                "<div class='main-menu'>" + "".join(f"<div>{x}</div>" for x in links) + "</div>",
                "".join(f"<div>{x}</div>" for x in links),
            ]
        )

    def notice() -> str:
        return rng.choice(["<div class='ad'><p>{}</p></div>", "<div class='advert'>{}</div>", "<div id='cookie-notice'><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div class='widget'><p>{}</p></div>", "<form><p>{}</p></form>"]).format(words(4, 40))

    def inside() -> str:
        return rng.choice(["<div class='share'><a href='#'>Share</a> <a href='#'>Print</a></div>", "<div class='advert'>{}</div>", "<div class='related'><a href='/r'>{}</a></div>", "<aside>{}</aside>", "<div class='newsletter-box'><p>{}</p></div>"]).format(words(3, 25))

    def comments() -> str:
        said = "".join(f"<{t}>{words(3, 60)}</{t}>" for t in rng.choices(["p", "li", "div"], k=rng.randint(1, 6)))
        return rng.choice(["<section class='comments'>{}</section>", "<div id='comments'>{}</div>", "<div class='comment-list'>{}</div>", "<ol class='commentlist'>{}</ol>"]).format(said)

    def foot(plain: bool) -> str:
        text = words(2, 9)
        return rng.choice(["<div>{}</div>", "<p>{}</p>"] if plain else ["<footer><p>{}</p></footer>", "<div class='footer'>{}</div>", "<div id='site-footer'>{}</div>"]).format(text)

    def article(kind: int, loose: bool) -> str:
        if not loose and rng.random() < 0.25:  # articles of a few short blocks
            return "".join(main(rng.choice(["p", "h1"]), words(1, 14)) for _ in range(rng.randint(1, 3)))
        parts = [main("h1" if rng.random() < 0.7 else "h2", words(2, 9))]
        for i in range(rng.randint(3, 9)):
            # without a marked article the first and the last block are long ones: nothing else tells where it begins
            short = rng.random() < 0.25 and not (loose and i == 0)
            parts.append(main("p", words(1, 6) if short else words(14, 70)))
            if kind == 1 and rng.random() < 0.3:
                parts.append("<ul>" + "".join(main("li", words(2, 12)) for _ in range(3)) + "</ul>")
            if kind == 2 and rng.random() < 0.3 and not loose:
                parts.append(f"<p><a href='/l'>{MAIN}{words(2, 9)}</a></p>")
            if kind == 3 and rng.random() < 0.4:
                parts.append(inside())
            if kind == 4 and rng.random() < 0.5:
                parts.append(main("p", words(8, 20) + f" <a href='/x'>{words(2, 5)}</a> " + words(5, 20)))
        return "".join([*parts, main("p", words(16, 50))])

    marked = ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<main><article>{}</article></main>", "<div class='no-sidebar'><article>{}</article></div>", "<section class='entry'>{}</section>"]
    plain = ["<div>{}</div>", "{}", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>", "<div class='page has-sidebar'>{}</div>", "<div class='box-widget'>{}</div>"]
    pages = []
    for turn in range(10):
        for shell in [*marked, *plain]:
            loose = shell in plain
            before = [menu(), *([notice()] if rng.random() < 0.6 else []), *([f"<div>{words(3, 9 if loose else 25)}</div>"] if rng.random() < 0.5 else [])]
            after = [*([comments()] if rng.random() < 0.5 else []), *([notice()] if rng.random() < 0.5 else []), *([menu()] if rng.random() < 0.5 else []), *(foot(loose and rng.random() < 0.5) for _ in range(rng.randint(0, 2)))]
            if not loose and rng.random() < 0.5:
                after.insert(0, f"<p>{words(4, 30)}</p>")
            if rng.random() < 0.15:
                before, after = [], []
            pages.append("<html><body>" + "".join(before) + shell.format(article(turn % 5, loose)) + "".join(after) + "</body></html>")
    return pages


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 9, least: int = 4) -> tuple:
    """A decision tree by Gini impurity: ("leaf", label) or (feature, threshold, low, high). Ties go to the first feature and threshold."""
    n, yes = len(labels), int(labels.sum())
    best = None
    if depth and yes not in (0, n):
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            value, ones = rows[order, f], np.cumsum(labels[order])
            size = np.arange(1, n)
            k = ones[:-1]
            cost = 2 * k * (size - k) / size + 2 * (yes - k) * (n - size - yes + k) / (n - size)
            cost = np.where((value[1:] > value[:-1]) & (size >= least) & (n - size >= least), cost, np.inf)
            at = int(np.argmin(cost)) if n > 1 else 0
            if n > 1 and np.isfinite(cost[at]) and (best is None or cost[at] < best[0] - 1e-9):
                best = (float(cost[at]), f, float(value[at] + value[at + 1]) / 2)
    if best is None:
        return ("leaf", 2 * yes > n)
    _, f, cut = best
    low = rows[:, f] <= cut
    return (f, cut, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def decide(tree: tuple, row: tuple[float, ...]) -> bool:
    while tree[0] != "leaf":
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1]


@lru_cache(maxsize=1)
def trained() -> tuple:
    rows, labels = [], []
    for page in labelled_pages():
        rows += features(blocks_of(page.replace(MAIN, "")))
        labels += [MAIN in b.text for b in blocks_of(page)]
    return grow(np.array(rows), np.array(labels))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks_of(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html); n_chars counts code points.

    A null, empty or unmarked-up html without main text gives an empty text. Ids and addresses may be null, and repeated rows give a row
    each. Cut-off markup ends with the page. An empty table gives none; other columns aren't read.
    """
    small_batches(pages.sparkSession)
    tree = tree or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract of all pages: a row for each."""
    return extract(table(spark, sf_dir, "pages"))
