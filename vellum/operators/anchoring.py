"""Numbers of a reading anchored in the numbers of its source, each of which is used once."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import NUMBER
from vellum.operators.grouped import map_groups

#: Tokens to join stand at most so many places apart; punctuation that numbers don't end with.
NEIGHBOURS, ENDS = 2, ".,/:%-"


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Pool:
    """The source's number tokens (region, token) in order of the page."""

    def __init__(self, tokens: list[tuple[int, str]]) -> None:
        self.left = dict(enumerate(tokens))

    def own_first(self, region: int) -> list[list[int]]:
        return [[k for k, (r, _) in self.left.items() if r == region], list(self.left)]

    def exact(self, token: str, region: int) -> bool:
        for scope in self.own_first(region):
            for k in scope:
                if self.left[k][1] == token:
                    del self.left[k]
                    return True
        return False

    def split(self, token: str, region: int) -> tuple[str, str] | None:
        """Two neighbouring tokens of the region that make up the token, with at most one sign between."""
        scope = self.own_first(region)[0]
        for k, m in zip(scope, scope[1:], strict=False):
            a, b = self.left[k][1], self.left[m][1]
            if m - k <= NEIGHBOURS and (a + b == token or token.startswith(a) and token.endswith(b) and len(token) == len(a) + len(b) + 1):
                del self.left[k], self.left[m]
                return a, b
        return None

    def near(self, token: str, region: int) -> tuple[str | None, bool]:
        """The one value within an edit of the token, taken; or whether there are several."""
        for scope in self.own_first(region):
            found = [k for k in scope if within_one_edit(self.left[k][1], token)]
            values = {self.left[k][1] for k in found}
            if len(values) == 1:
                del self.left[found[0]]
                return values.pop(), False
            if values:
                return None, True
        return None, False


class Event(NamedTuple):
    """What happened to a number: its kind, the reading's token, the source's (null: none or several), severity, and its place in the text."""

    kind: str
    token: str
    source: str | None
    severity: str
    start: int
    end: int


def anchor(text: str, region: int, pool: Pool, policy: str = "replace") -> tuple[str, list[Event], Counter]:
    """The text with its numbers anchored, an event for each number that isn't as the source has it, and counts by what happened.

    Policies: replace, flag, off. Places of events are offsets into the new text before its spaces are tidied, cut at its end; those of
    dropped numbers are empty.
    """
    if policy == "off":
        return text, [], Counter()
    out, last, events, counts = "", 0, [], Counter()
    for m in re.finditer(NUMBER, text, flags=re.ASCII):
        token = m[0].rstrip(ENDS)
        counts["total"] += 1
        out += text[last : m.start()]
        last = m.start() + len(token)
        start, new = len(out), token
        if pool.exact(token, region):
            counts["exact"] += 1
            out += token
            continue
        if parts := pool.split(token, region):
            kind, source, severity = "split-joined", " ".join(parts), "low"
            if policy == "replace" and token == "-".join(parts):
                new = " - ".join(parts)
        else:
            source, several = pool.near(token, region)
            severity = "high"
            if policy == "replace":
                kind, new = "replaced" if source else "ambiguous" if several else "dropped", source or ""
            else:
                kind = "ambiguous" if several else "flagged"
        counts[kind] += 1
        out += new
        events.append(Event(kind, token, source, severity, start, len(out)))
    out += text[last:]
    for pattern, new in ((r"[ \t]{2,}", " "), (r" ([.,;:)\]])", r"\1"), (r"\( ", "(")):
        out = re.sub(pattern, new, out)
    out = out.strip()
    return out, [e._replace(start=min(e.start, len(out)), end=min(e.end, len(out))) for e in events], counts


def anchor_pages(readings: DataFrame, source: DataFrame, policy: str = "replace") -> DataFrame:
    """(page_id, ord, text, kinds) of readings(page_id, region, ord, text) anchored in source(page_id, region, ord, text), page by page in
    order; kinds lists what happened to its numbers."""

    def run(page: list) -> list[tuple]:
        pool = Pool([(int(r.region), x.rstrip(ENDS)) for r in page if not r.reads for x in re.findall(NUMBER, r.text, flags=re.ASCII)])
        rows = []
        for r in page:
            if r.reads:
                text, events, _ = anchor(r.text, int(r.region), pool, policy)
                rows.append((r.page_id, r.ord, text, ",".join(e.kind for e in events)))
        return rows

    columns = ["page_id", "region", "ord", "text"]
    both = source.select(*columns, F.lit(False).alias("reads")).union(readings.select(*columns, F.lit(True).alias("reads")))
    return map_groups(both, "page_id", ["reads", "ord"], run, "page_id long, ord long, text string, kinds string")
