"""Page layout kernels: words to segments, reading order, label-free blocks. One page's rows go through one pure function."""

from __future__ import annotations

import re
from itertools import pairwise
from statistics import fmean, median

from pyspark.sql import DataFrame

from vellum.functions.text import PLAIN_BULLET, SET_OFF_BULLET
from vellum.operators.grouped import map_groups

#: Lowest confidence of a word, row share and gutter in word heights, smallest gap of a cut in line heights.
LEAST_CONF, ROW_SHARE, GUTTER, CUT_GAP, NO_HEIGHT = 0.2, 0.6, 1.6, 1.2, 12.0
#: Suppression of layout regions; labels of regions with running text, those that hold other regions, and pictures.
SAME_LABEL, CONTAINED, ANY_LABEL, LEAST_SCORE = 0.6, 0.8, 0.7, 0.5
TEXT_LABELS = set(
    "abstract algorithm aside_text content display_formula doc_title figure_title footer footnote formula_number header inline_formula number paragraph_title reference reference_content text vertical_text"
    " vision_footnote".split()
)
HOLDERS, PICTURES = {"table", "image", "chart", "seal"}, {"image", "seal", "chart", "header_image", "footer_image"}

Box = tuple[float, float, float, float]


def running_rows(centers: list[float], reach: float) -> list[int]:
    """The row of each center, given in ascending order: one joins while it is within reach of the row's running median."""
    rows, own, at = [], [], -1
    for c in centers:
        if not own or abs(c - median(own)) > reach:
            own, at = [], at + 1
        own.append(c)
        rows.append(at)
    return rows


def around(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def segments_of(words: list[tuple[str, Box, float]]) -> list[tuple[str, Box, float]]:
    """(text, box, confidence) of the segments of a page's words (text, box, confidence): rows, parted at gutters; a bullet alone joins what
    follows it. Blank and doubtful words are left out."""
    words = [w for w in words if w[0].strip() and w[2] >= LEAST_CONF]
    if not words:
        return []
    height = median(b[3] - b[1] for _, b, _ in words) or NO_HEIGHT
    words.sort(key=lambda w: (w[1][1] + w[1][3]) / 2)
    rows = running_rows([(b[1] + b[3]) / 2 for _, b, _ in words], height * ROW_SHARE)
    out = []
    for r in range(rows[-1] + 1):
        row = sorted((w for w, at in zip(words, rows, strict=True) if at == r), key=lambda w: w[1][0])
        groups = [[row[0]]]
        for a, b in pairwise(row):
            bullet = len(groups[-1]) == 1 and re.search(f"{PLAIN_BULLET}|{SET_OFF_BULLET}", groups[-1][0][0])
            if b[1][0] - a[1][2] > height * GUTTER and not bullet:
                groups.append([])
            groups[-1].append(b)
        out += [(" ".join(" ".join(w[0] for w in g).split()), around([w[1] for w in g]), fmean(w[2] for w in g)) for g in groups]
    return sorted(out, key=lambda s: (s[1][1], s[1][0]))


def line_segments(words: DataFrame) -> DataFrame:
    """(page_id, seg, text, x0, y0, x1, y1, conf) from words(page_id, text, x0, y0, x1, y1, conf, ord)."""

    def run(page: list) -> list[tuple]:
        found = segments_of([(w.text, (w.x0, w.y0, w.x1, w.y1), w.conf) for w in page])
        return [(page[0].page_id, i, s, *b, c) for i, (s, b, c) in enumerate(found)]

    return map_groups(words, "page_id", ["ord"], run, "page_id long, seg long, text string, x0 double, y0 double, x1 double, y1 double, conf double")


def widest_gap(spans: list[tuple[float, float, int]]) -> tuple[float, list[int]]:
    """The widest gap between the unions of spans (low, high, index), and the indices before it; the first of equals."""
    spans = sorted(spans)
    best, before, reach = 0.0, [], spans[0][1]
    for k in range(1, len(spans)):
        if spans[k][0] - reach > best:
            best, before = spans[k][0] - reach, [i for *_, i in spans[:k]]
        reach = max(reach, spans[k][1])
    return best, before


def cut_order(boxes: list[Box], least: float) -> list[int]:
    """Reading order by recursive cuts: a page is parted at its widest white gap, a vertical one if it is as wide as any horizontal one."""

    def order(own: list[int]) -> list[int]:
        if len(own) < 2:
            return own
        across, left = widest_gap([(boxes[i][0], boxes[i][2], i) for i in own])
        down, top = widest_gap([(boxes[i][1], boxes[i][3], i) for i in own])
        if max(across, down) < least:
            return sorted(own, key=lambda i: (boxes[i][1], boxes[i][0], i))
        first = set(left if across >= least and across >= down else top)
        return order([i for i in own if i in first]) + order([i for i in own if i not in first])

    return order(list(range(len(boxes))))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, place) from boxes(page_id, box_id, x0, y0, x1, y1, line_height)."""

    def run(page: list) -> list[tuple]:
        order = cut_order([(r.x0, r.y0, r.x1, r.y1) for r in page], CUT_GAP * page[0].line_height)
        return [(page[0].page_id, page[i].box_id, place) for place, i in enumerate(order)]

    return map_groups(boxes, "page_id", ["box_id"], run, "page_id long, box_id long, place long")


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def suppressed(regions: list[tuple[str, float, Box]]) -> list[int]:
    """The indices of regions (label, score, box) that stay, best score first: one goes if a kept one of its label overlaps it by more than
    60 %, if it has running text and a kept holder covers more than 80 % of it, or if a kept one overlaps it by more than 70 % and neither
    is a picture."""
    kept: list[int] = []
    for i in sorted((i for i, r in enumerate(regions) if r[1] >= LEAST_SCORE), key=lambda i: (-regions[i][1], i)):
        label, _, box = regions[i]

        def hides(k: int, label=label, box=box) -> bool:
            other, _, b = regions[k]
            both = shared(box, b)
            union = area(box) + area(b) - both
            overlap = both / union if union else 0.0
            held = label in TEXT_LABELS and other in HOLDERS and both / max(1e-6, area(box)) > CONTAINED
            return held or other == label and overlap > SAME_LABEL or overlap > ANY_LABEL and label not in PICTURES and other not in PICTURES

        if not any(hides(k) for k in kept):
            kept.append(i)
    return kept


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """(page_id, region_id) of the regions that stay, from regions(page_id, region_id, label, score, x0, y0, x1, y1)."""

    def run(page: list) -> list[tuple]:
        return [(page[0].page_id, page[i].region_id) for i in suppressed([(r.label, r.score, (r.x0, r.y0, r.x1, r.y1)) for r in page])]

    return map_groups(regions, "page_id", ["region_id"], run, "page_id long, region_id long")
