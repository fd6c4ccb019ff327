"""Scalar text functions: normal forms, token extraction, shape tests, votes and label-value lines, all as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions.stats import sigma

# White space, dashes and quotes that count alike, and the shape patterns.
WS = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DASHES, SINGLE_QUOTES, DOUBLE_QUOTES = "‐‑‒–—―−", "‘’‚‛′", "“”„‟″"
NUMBER = r"\d[\d.,/:%-]*\d|\d"
DATE_SHAPES = (r"^\d{1,2}[ \-/.](?:[A-Za-z]{3,9}\.?|\d{1,2})[ \-/.,]\s?\d{2,4}$", r"^[A-Za-z]{3,9}\.?\s\d{1,2},?\s\d{2,4}$", r"^\d{4}-\d{2}-\d{2}$")
MEASURE_SHAPES = (r"^[<>~≈]?\d+(?:[.,]\d+)?\s*[A-Za-zµ%°]{1,7}(?:/[A-Za-zµ]{1,7})?$", r"^[<>~≈]?\d+(?:[.,:/+=×x-]\d+)*\s*%?$")
TITLED, LAST_FIRST = r"^(?i:Dr|Mr|Mrs|Ms|Prof)\.?\s+\S", r"^[A-Z][A-Za-z'’ .-]{0,30},\s+[A-Z]"
MARKER = r"^[A-Za-z]{1,7}-?\d{1,3}[a-z]?$"
PROSE = r"[a-z]{3,}[.?!]\s+[A-Z]"
PLAIN_BULLET, SET_OFF_BULLET = r"^[•◦·▪‣*+–—]$", r"^(?i:[a-z0]|[^\w\s]{1,2})$"
SPECIAL_HEADING = r"(?i)^(?:specimen\s+\d+|follow[- ]?up)"
#: Fixed value: how steeply a vote becomes a plausibility, and the score that plain lines have.
SIGMA_K, LINES_SCORE = 3.0, 0.5


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{WS}+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; plain ASCII passes through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column, compatibility: bool = True) -> Column:
    """Compatibility form, dashes and quotes folded, white space collapsed. Without `compatibility` it stays in the JVM."""
    c = nfkc(c) if compatibility else c
    c = F.translate(c, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return collapsed(c)


def normalize_fold(c: Column, compatibility: bool = True) -> Column:
    return F.lower(normalize_text(c, compatibility))


def normalize_field(c: Column, kind: str, compatibility: bool = True) -> Column:
    """The comparable form of a value of kind id, date, name or text."""
    low = normalize_fold(c, compatibility)
    if kind == "id":
        return F.regexp_replace(low, r"[\s.\-/]", "")
    if kind == "date":
        return collapsed(F.regexp_replace(low, "[.,]", ""))
    return low


def extract_numbers(c: Column) -> Column:
    """Number tokens of normalized text, without punctuation at their end."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda t: F.regexp_replace(t, "[.,/:%-]+$", ""))


def extract_words(c: Column, least: int = 4) -> Column:
    """Runs of at least `least` letters a-z of folded text; accents end a run."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= least)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return out


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole == 0, 1).otherwise(whole))


def is_date_shaped(c: Column) -> Column:
    return any_of(c, DATE_SHAPES)


def is_id_shaped(c: Column) -> Column:
    compact = F.regexp_replace(c, r"[\s\-/.+()]", "")
    return (F.length(compact) >= 5) & compact.rlike("^[A-Za-z0-9]+$") & (share(F.length(F.regexp_replace(compact, r"\D", "")), F.length(compact)) >= 0.6)


def is_measurement_shaped(c: Column) -> Column:
    return any_of(c, MEASURE_SHAPES)


def is_name_shaped(c: Column) -> Column:
    parts = F.filter(F.split(c, rf"(?:{WS}|,)+"), lambda w: w != "")
    return c.rlike(TITLED) | (c.rlike(LAST_FIRST) & (F.size(parts) <= 6) & F.forall(parts, lambda w: w.rlike("^[A-Z]")))


def is_sentence_shaped(c: Column) -> Column:
    parts = words_of(c)
    return (F.size(parts) >= 8) & (share(F.size(F.filter(parts, lambda w: w.rlike("^[a-z]"))), F.size(parts)) >= 0.4)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a name for an expression that body uses several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lexicon_key(c: Column) -> Column:
    """The form in which labels are listed: folded, without a colon at the end."""
    return collapsed(F.regexp_replace(F.lower(trimmed(c)), ":$", ""))


def cell_vote(c: Column, in_lexicon: Column | None = None) -> Column:
    """struct(v, strong): how much a text looks like a label (1) or a value (-1), and whether its form alone says so.

    A colon at the end and value shapes are strong and average; else length, case, markers, digits, punctuation and the lexicon add up."""

    def scored(t: Column, body: Column, parts: Column, compact: Column) -> Column:
        colon = t.rlike(r":\z") & (F.length(t) > 1)
        value = is_date_shaped(body) | is_id_shaped(body) | is_measurement_shaped(body) | is_name_shaped(body) | is_sentence_shaped(body)
        n = F.size(parts)
        markers = F.size(F.filter(parts, lambda w: w.rlike(MARKER)))
        alnum, digit = F.length(compact), F.length(F.regexp_replace(body, r"\D", ""))
        last = F.coalesce(F.get(parts, n - 1), F.lit(""))
        lone = (markers == n) & (n == 1)
        v = (
            F.when(n <= 2, 0.4).when(n <= 4, 0.15).when(n <= 7, -0.3).otherwise(-0.6)
            + F.when(body.rlike("^[a-z]"), -0.25).when(F.forall(parts, lambda w: w.rlike("^[A-Z0-9(]")), 0.3).otherwise(0.0)
            + F.when((markers == n) & (n >= 2), -0.3).when(lone | (alnum == 0), 0.0).otherwise(-0.8 * F.least(F.lit(1.0), share(2.0 * digit, alnum)))
            + F.when(body.rlike(r"[.,;]\z") & ~(body.rlike(r"\.\z") & (F.length(last) <= 4)), -0.3).otherwise(0.0)
            + (F.when(in_lexicon, 0.5).otherwise(0.0) if in_lexicon is not None else F.lit(0.0))
        )
        told = F.when(colon & value, 0.0).when(colon, 1.0).otherwise(-1.0)
        strong = F.coalesce(colon | value, F.lit(False))
        return let(strong, lambda sure: F.struct(F.when(t == "", 0.0).when(sure, told).otherwise(clamp(v, -1.0, 1.0)).alias("v"), ((t != "") & sure).alias("strong")))

    whole = F.coalesce(trimmed(c), F.lit(""))
    return let(whole, lambda t: let(trimmed(F.regexp_replace(t, r":\z", "")), lambda body: let(words_of(body), lambda parts: scored(t, body, parts, F.regexp_replace(body, "[^A-Za-z0-9]", "")))))


def vote_weight(vote: Column) -> Column:
    return F.when(vote["strong"], 1.0).otherwise(0.5)


def group_vote(vote: Column) -> Column:
    """Aggregate: the weighted mean of votes."""
    return F.coalesce(F.sum(vote_weight(vote) * vote["v"]) / F.sum(vote_weight(vote)), F.lit(0.0))


def sign_alignment(vote: Column) -> Column:
    """Aggregate: how far typed votes agree in sign; 0.5 with fewer than two."""
    typed = F.abs(vote["v"]) >= 0.05
    w = F.when(typed, vote_weight(vote))
    return F.when(F.count(w) < 2, 0.5).otherwise(F.abs(F.sum(w * vote["v"])) / F.sum(w * F.abs(vote["v"])))


def blend_context(vote: Column, context: Column) -> Column:
    return F.when(vote["strong"], vote["v"]).otherwise((vote["v"] + 2 * context) / 3)


def type_plausibility(label: Column, value: Column) -> Column:
    return F.sqrt(sigma(label, SIGMA_K) * sigma(-value, SIGMA_K))


def brackets_balanced(c: Column) -> Column:
    """Round and square brackets each close what they open, never before."""

    def depth(opens: str, closes: str) -> Column:
        start = F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok"))

        def step(a: Column, ch: Column) -> Column:
            d = a["d"] + F.when(ch == opens, 1).when(ch == closes, -1).otherwise(0)
            return F.struct(d.alias("d"), (a["ok"] & (d >= 0)).alias("ok"))

        return F.aggregate(F.split(c, ""), start, step, lambda a: a["ok"] & (a["d"] == 0))

    return depth("(", ")") & depth("[", "]")


def valid_kv_shape(label: Column, value: Column) -> Column:
    parts = words_of(label)
    return (
        (label != "") & (value != "") & label.rlike("[A-Za-z]") & (F.size(parts) <= 7) & brackets_balanced(label) & brackets_balanced(value)
        & ~label.rlike(r"[,;]\z") & ~(label.rlike(r"\.\z") & (F.length(F.element_at(parts, -1)) > 4))
    )


def is_clock_split(label: Column, value: Column) -> Column:
    return label.rlike(r"(^|[^\d])\d{1,2}\z") & value.rlike(r"^\d{2}([^\d]|\z)")


def kv_semantic_score(label: Column, value: Column) -> Column:
    right = cell_vote(value)
    return type_plausibility(cell_vote(label)["v"], F.when(right["strong"], right["v"]).otherwise(0.0))


def parse_kv_line(c: Column, lenient: bool = False) -> Column:
    """struct(label, value) of the first ": " that makes a label and a value, null where none does."""
    t = collapsed(c)
    pieces = F.split(t, ": ")

    def at(i: Column) -> Column:
        label = trimmed(F.array_join(F.slice(pieces, F.lit(1), i), ": "))
        value = trimmed(F.array_join(F.slice(pieces, i + 1, F.size(pieces) - i), ": "))
        good = ~is_clock_split(label, value) & valid_kv_shape(label, value)
        if not lenient:
            good = good & ~value.rlike(PROSE) & (kv_semantic_score(label, value) > LINES_SCORE)
        return F.struct(good.alias("good"), label.alias("label"), value.alias("value"))

    tries = F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - 1)), at))
    first = F.get(F.filter(tries, lambda x: x["good"]), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["label"].alias("label"), first["value"].alias("value")))


def is_rule(text: Column, width: Column, page_width: Column) -> Column:
    return (width > page_width * 0.5) & F.regexp_replace(text, f"{WS}+", "").rlike(r"^[-–—_=.]+\z")


def is_bullet(text: Column, gap: Column, line_height: Column) -> Column:
    """A bullet glyph first, or a letter or sign set off by a gap of over half a line."""
    parts = words_of(text)
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return first.rlike(PLAIN_BULLET) | (first.rlike(SET_OFF_BULLET) & (F.size(parts) > 1) & F.coalesce(gap > line_height * 0.5, F.lit(False)))


def looks_like_heading(text: Column, width: Column, page_width: Column) -> Column:
    t = trimmed(text)
    n = F.size(words_of(t))
    return (
        (t != "") & (n <= 8) & (width <= page_width * 0.62) & ~t.rlike(r"[.,;]\z")
        & F.when(t.endswith(":"), n <= 5).otherwise(t.rlike(SPECIAL_HEADING) | (t.rlike("^[A-Z0-9(]") & t.rlike("[a-z]")))
    )


def heading_depth(text: Column, x0: Column, x1: Column, y0: Column, page_width: Column, line_height: Column) -> Column:
    centred = (y0 < line_height * 8) & (F.abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.12)
    return F.when(trimmed(text).rlike(SPECIAL_HEADING), 3).when(centred, 1).otherwise(2)


def join_value_texts(parts: Column) -> Column:
    """Values in a row: a comma between them, unless one already ends with punctuation."""
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = F.aggregate(rest, F.coalesce(F.get(parts, F.lit(0)), F.lit("")), lambda a, x: F.concat(a, F.when(F.rtrim(a).rlike(r"[,;:-]\z"), " ").otherwise(", "), x))
    return collapsed(joined)


def confidence_band(c: Column) -> Column:
    return F.when(c < 0.5, "low").when(c < 0.8, "caution").otherwise("ok")


def shortened(c: Column, most: int = 48) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


# Kinds of layout regions, and token caps of their tasks.
REGION_KINDS = {"doc_title": "title", "paragraph_title": "heading", "table": "table", "image": "imageish", "seal": "imageish", "chart": "imageish", "header_image": "imageish", "footer_image": "imageish"}
TOKEN_CAPS = {"table": 2048, "formula": 512, "heading": 160, "title": 160, "text": 1024, "page": 4096}


def region_kind(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REGION_KINDS.items() for x in pair]), label), F.lit("text"))


def mapped(c: Column, known: dict) -> Column:
    """known[c], null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), c)


def token_cap(task: Column) -> Column:
    return F.coalesce(mapped(task, TOKEN_CAPS), F.lit(TOKEN_CAPS["text"]))


#: Prompts of the tasks by model, and the revision that outputs are keyed by.
PROMPTS = {
    "glm-ocr": {"rev": "glm-g1", "text": "Text Recognition:", "table": "Table Recognition:", "formula": "Formula Recognition:"},
    "paddleocr-vl": {"rev": "paddle-g1", "text": "OCR:", "table": "Table Recognition:", "formula": "Formula Recognition:"},
}


def task_of(label: Column) -> Column:
    """The reading task of a layout label: table, formula or text."""
    return F.when(label == "table", "table").when(label.startswith("formula"), "formula").otherwise("text")


def prompt_for(model: Column, label: Column) -> Column:
    """The prompt of a model, known by the beginning of its name before a dash; null for unknown models."""
    out = F.lit(None).cast("string")
    for name, own in PROMPTS.items():
        out = F.when((model == name) | model.startswith(f"{name}-"), mapped(task_of(label), {k: own[k] for k in ("text", "table", "formula")})).otherwise(out)
    return out


def token_budget(kind: Column, task: Column, lines: Column, area: Column, most: Column | None = None) -> Column:
    """Tokens that a region's reading may take: estimated from its lines, or its area in pixels where it has none, from 96 up to the cap of
    its task or kind; `most` lowers the cap where it isn't null or 0."""
    cap = token_cap(F.when(task.isin("table", "formula", "page"), task).otherwise(kind))
    cap = cap if most is None else F.when(F.coalesce(most, F.lit(0)) > 0, F.least(cap, most)).otherwise(cap)
    wanted = F.when(lines > 0, 64 + 48 * lines.cast("double")).otherwise(64 + area / 2500.0)
    return F.floor(F.greatest(F.lit(96.0), F.least(wanted, cap))).cast("long")


def block_text(kind: Column, text: Column, lead: Column, label: Column, value: Column, cells: Column) -> Column:
    """All text of a block, a lead or label before it, cells row by row; a rule has none."""
    flat = F.array_join(F.flatten(cells), " ")
    return F.when(kind == "table", flat).when(kind == "kv", F.concat_ws(" ", label, value)).when(kind == "rule", "").when(kind == "listItem", F.concat(F.coalesce(lead, F.lit("")), F.lit(" "), text)).otherwise(text)


def colon_label(c: Column) -> Column:
    """The key of a label that ends with a colon and has up to seven words, null for other texts."""
    bare = trimmed(c)
    return F.when(bare.endswith(":") & (F.length(bare) > 1) & (F.size(words_of(bare)) <= 7), lexicon_key(bare))


def region_key(label: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A region's key: 32-bit FNV-1a, as eight hexadecimal digits, of its label and rounded box."""
    whole = [F.floor(v + 0.5).cast("long").cast("string") for v in (x0, y0, x1, y1)]
    text = F.concat(label, F.lit("@"), F.concat_ws(",", *whole))
    start = F.lit(2166136261).cast("long")
    hashed = F.aggregate(F.transform(F.split(text, ""), F.ascii), start, lambda h, c: F.when(c == 0, h).otherwise(F.pmod(h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long"), F.lit(1 << 32))))
    return F.lower(F.lpad(F.hex(hashed), 8, "0"))
