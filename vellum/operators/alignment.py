"""Character labels for calibration: which predicted characters stand in a longest common subsequence with the truth."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from vellum.functions.text import DASHES, DOUBLE_QUOTES, SINGLE_QUOTES
from vellum.operators.grouped import map_groups

FOLD = str.maketrans({**dict.fromkeys(DASHES, "-"), **dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"')})


def folded(text: str) -> str:
    """A form of equal length: each character's one-character compatibility form in lower case, dashes and quotes alike."""
    out = []
    for c in text.translate(FOLD):
        f = unicodedata.normalize("NFKC", c).lower()
        out.append(f if len(f) == 1 else c)
    return "".join(out)


def common(truth: str, predicted: str) -> list[bool]:
    """For each predicted character whether it is part of a longest common subsequence; of equal ones the leftmost in the prediction."""
    a, b = folded(truth), folded(predicted)
    length = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    codes = np.array([ord(c) for c in b], dtype=np.int64)
    for i in range(len(a) - 1, -1, -1):
        hit = np.where(codes == ord(a[i]), length[i + 1, 1:] + 1, length[i + 1, :-1])
        length[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    out = [False] * len(b)
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[j] = True
            i, j = i + 1, j + 1
        elif length[i + 1, j] >= length[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def char_labels(lines: DataFrame) -> DataFrame:
    """(line_id, ord, ch, conf, correct) of lines(line_id, text, truth, char_conf). Lines whose confidences aren't one a character give none."""

    def run(rows: list) -> list[tuple]:
        return [(r.line_id, i, c, float(p), ok) for r in rows if r.text and r.char_conf is not None and len(r.char_conf) == len(r.text) for i, (c, p, ok) in enumerate(zip(r.text, r.char_conf, common(r.truth or "", r.text), strict=True))]

    return map_groups(lines.select("line_id", "text", "truth", "char_conf"), "line_id", [], run, "line_id long, ord long, ch string, conf double, correct boolean")


def page_labels(lines: DataFrame, truth: DataFrame) -> DataFrame:
    """(page_id, ord, ch, conf, correct): the characters of a page against its plain text.

    lines(page_id, ord, text, char_conf) are joined by line breaks of confidence 1; those whose confidences aren't one a character are left
    out. truth(page_id, truth); pages without truth give none.
    """

    def run(page: list) -> list[tuple]:
        text, conf = "", []
        for r in page:
            if r.text and r.char_conf is not None and len(r.char_conf) == len(r.text):
                conf += [1.0] * bool(text) + [float(p) for p in r.char_conf]
                text += "\n" * bool(text) + r.text
        return [(page[0].page_id, i, c, p, ok) for i, (c, p, ok) in enumerate(zip(text, conf, common(page[0].truth, text), strict=True))]

    both = lines.select("page_id", "ord", "text", "char_conf").join(truth.where("truth IS NOT NULL").select("page_id", "truth"), "page_id")
    return map_groups(both, "page_id", ["ord"], run, "page_id long, ord long, ch string, conf double, correct boolean")
