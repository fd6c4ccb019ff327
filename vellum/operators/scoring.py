"""Pairing evaluation of one page: predicted label-value pairs against true ones, each miss in its bucket."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import DASHES, DOUBLE_QUOTES, NUMBER, SINGLE_QUOTES
from vellum.operators.anchoring import within_one_edit
from vellum.operators.grouped import map_groups
from vellum.operators.markup import document_text


FOLDS = str.maketrans(dict.fromkeys(DASHES, "-") | dict.fromkeys(SINGLE_QUOTES, "'") | dict.fromkeys(DOUBLE_QUOTES, '"'))


class Page(NamedTuple):
    """Pairs (label, value): true ones, neutral ones, predicted ones, two-cell table rows and list leads; fields (value, kind); all text."""

    true: list[tuple[str, str]]
    neutral: list[tuple[str, str]]
    predicted: list[tuple[str, str]]
    rows: list[tuple[str, str]]
    leads: list[tuple[str, str]]
    fields: list[tuple[str, str]]
    text: str


def field_form(value: str, kind: str) -> str:
    low = " ".join(unicodedata.normalize("NFKC", value).translate(FOLDS).lower().split())
    if kind == "id":
        return re.sub(r"[\s.\-/]", "", low)
    return " ".join(re.sub("[.,]", "", low).split()) if kind == "date" else low


def tokens(text: str, kind: str) -> list[str]:
    return [w for x in text.split() if (w := re.sub("^[^a-z0-9]+|[^a-z0-9]+$", "", field_form(x, kind)))]


def alike(a: list[str], b: list[str]) -> bool:
    return bool(a) and len(a) == len(b) and all(x == y if min(len(x), len(y)) <= 2 else within_one_edit(x, y) for x, y in zip(a, b, strict=True))


def same_label(a: str, b: str) -> bool:
    bare = lambda s: re.sub(r"[:.]\s*$", "", s.strip())
    return alike(tokens(bare(a), "text"), tokens(bare(b), "text"))


def same_value(a: str, b: str, kind: str) -> bool:
    return field_form(a, kind) == field_form(b, kind) or alike(tokens(a, kind), tokens(b, kind))


def kind_of(value: str, fields: list[tuple[str, str]]) -> tuple[str, bool]:
    """The kind of the first field with this value, and whether there is one."""
    return next(((kind, True) for v, kind in fields if field_form(v, kind) == field_form(value, kind)), ("text", False))


def outcomes(page: Page) -> tuple[list[tuple[str, str, bool]], int]:
    """(label, outcome, critical) of each true pair, and the number of false pairs.

    True pairs take predictions in order, one each. Others are mispaired (the value stands under another label), in a table, in a list,
    unpaired (all tokens of the value are in the text) or missed by the source.
    """
    free = dict(enumerate(page.predicted))
    kinds = [kind_of(v, page.fields) for _, v in page.true]
    match = lambda a, b, kind: same_label(a[0], b[0]) and same_value(a[1], b[1], kind)
    hit: dict[int, int] = {}
    for i, gt in enumerate(page.true):
        if (k := next((k for k, p in free.items() if match(gt, p, kinds[i][0])), None)) is not None:
            hit[i] = k
            del free[k]
    pools = {kind: set(tokens(page.text, kind)) for kind in {k for k, _ in kinds}}
    found = []
    for i, gt in enumerate(page.true):
        kind, critical = kinds[i]
        if i in hit:
            what = "paired"
        elif any(same_value(gt[1], p[1], kind) and not same_label(gt[0], p[0]) for p in free.values()):
            what = "mispaired"
        elif any(match(gt, r, kind) for r in page.rows):
            what = "in_table"
        elif any(match(gt, r, kind) for r in page.leads):
            what = "in_list"
        else:
            own = tokens(gt[1], kind)
            what = "unpaired" if own and all(w in pools[kind] or any(within_one_edit(w, p) for p in pools[kind]) for w in own) else "ocr_miss"
        found.append((gt[0], what, critical))
    false = sum(not any(match(gt, p, kinds[i][0]) for i, gt in enumerate(page.true)) and not any(match(n, p, "text") for n in page.neutral) for p in free.values())
    return found, false


ROLES = ("true", "neutral", "predicted", "rows", "leads", "fields", "text")
SCORED = "page_id long, gt_pairs long, tp long, fp long, emitted long, mispaired long, in_table long, in_list long, unpaired long, ocr_miss long, critical_total long, critical_found long"


def score_pages(items: DataFrame) -> DataFrame:
    """The counts of each page (see evaluation.COUNTS) from items(page_id, role, ord, label, value); role is one of ROLES. A field has its
    kind as label; a text has its text as value."""

    def run(page: list) -> list[tuple]:
        of = lambda role: [(r.label or "", r.value or "") for r in page if r.role == role]
        own = Page(of("true"), of("neutral"), of("predicted"), of("rows"), of("leads"), [(v, k) for k, v in of("fields")], "\n".join(v for _, v in of("text")))
        found, false = outcomes(own)
        count = lambda what: sum(x == what for _, x, _ in found)
        return [(page[0].page_id, len(found), count("paired"), false, len(own.predicted), *(count(b) for b in ("mispaired", "in_table", "in_list", "unpaired", "ocr_miss")), sum(c for *_, c in found), sum(c and x == "paired" for _, x, c in found))]

    return map_groups(items.where(F.col("role").isin(*ROLES)), "page_id", ["ord"], run, SCORED)


RECALLED = "page_id long, field_found long, field_total long, number_found long, number_total long, word_found long, word_total long, n_lines long, mean_conf double"


def recalls(items: DataFrame) -> DataFrame:
    """How much of each page's truth its source has: a row (page_id, found and total of fields, numbers and words, n_lines, mean_conf).

    items(page_id, role, ord, label, value, conf): role is line (value: its text), truth (value: Markdown) or field (label: its kind). A field
    is found if each of its tokens is in the source within one edit; so is a number or word.
    """

    def near(token: str, pool: set[str]) -> bool:
        return token in pool or any(within_one_edit(token, p) for p in pool)

    def found(own: list[str], pool: set[str]) -> tuple[int, int]:
        return sum(near(x, pool) for x in own), len(own)

    def run(page: list) -> list[tuple]:
        text = "\n".join(r.value or "" for r in page if r.role == "line")
        conf = [r.conf for r in page if r.role == "line" and r.conf is not None]
        truth = "\n".join(document_text(r.value) for r in page if r.role == "truth")
        fields = [(r.label, r.value or "") for r in page if r.role == "field"]
        pools = {k: set(tokens(text, k)) for k in {k for k, _ in fields}}
        hits = sum(bool(own := tokens(v, k)) and all(near(x, pools[k]) for x in own) for k, v in fields)
        numbers = lambda x: [n.rstrip(".,/:%-") for n in re.findall(NUMBER, x, flags=re.ASCII)]
        words = lambda x: [w for w in re.findall("[a-z]+", x.lower()) if len(w) >= 4]
        parts = [*found(numbers(truth), set(numbers(text))), *found(words(truth), set(words(text)))]
        return [(page[0].page_id, hits, len(fields), *parts, sum(r.role == "line" for r in page), sum(conf) / len(conf) if conf else 0.0)]

    return map_groups(items.select("page_id", "role", "ord", "label", "value", "conf"), "page_id", ["role", "ord"], run, RECALLED)


def recall_rates(found: DataFrame) -> DataFrame:
    """(field, number, word, mean_conf) over all pages of `recalls`: shares found, null where nothing was to find."""
    share = lambda k: (F.sum(f"{k}_found") / F.nullif(F.sum(f"{k}_total"), F.lit(0))).alias(k)
    return found.agg(share("field"), share("number"), share("word"), F.coalesce(F.avg("mean_conf"), F.lit(0.0)).alias("mean_conf"))
