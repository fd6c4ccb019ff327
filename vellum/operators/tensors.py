"""Decoding of model outputs that are given as arrays: layout regions, table structure and text masks."""

from __future__ import annotations

from itertools import pairwise
from math import atan2, cos, hypot, sin

import numpy as np
from pyspark.sql import DataFrame

from vellum.operators.grouped import map_groups

#: Thresholds of the text mask and how far its boxes are let out.
MASK, MASK_SCORE, LET_OUT, LEAST_SIDE = 0.3, 0.6, 1.5, 3
CELL_TOKENS = ("<td>", "<td", "<td></td>")


def greedy_text(probs: np.ndarray, charset: list[str]) -> tuple[str, float, list[float]]:
    """Text, mean confidence and confidences of steps x classes: best classes without repeats and blanks (class 0)."""
    best = probs.argmax(axis=1)
    kept = [i for i, c in enumerate(best) if c and (i == 0 or best[i - 1] != c)]
    conf = [float(probs[i, best[i]]) for i in kept]
    return "".join(charset[best[i]] for i in kept), float(np.mean(conf)) if conf else 0.0, conf


def later_votes(logits: np.ndarray) -> np.ndarray:
    """How many regions each region is read after: every pair above the diagonal votes for its second one, else its first."""
    p = np.triu(1 / (1 + np.exp(-logits)), 1)
    return p.sum(axis=0) + (np.triu(np.ones_like(p), 1) - p).sum(axis=1)


def layout_regions(logits: np.ndarray, boxes: np.ndarray, labels: list[str], votes: np.ndarray, size: tuple[float, float], least: float = 0.5) -> list[tuple[str, float, tuple[float, float, float, float]]]:
    """(label, score, box) in reading order: best class of each query if sure enough; boxes from center form, clamped, 2 pixels at least."""
    scores = 1 / (1 + np.exp(-logits))
    out = []
    for q in np.argsort(votes, kind="stable"):
        c = int(scores[q].argmax())
        cx, cy, w, h = boxes[q]
        x0, x1 = np.clip([(cx - w / 2) * size[0], (cx + w / 2) * size[0]], 0, size[0])
        y0, y1 = np.clip([(cy - h / 2) * size[1], (cy + h / 2) * size[1]], 0, size[1])
        if scores[q, c] >= least and x1 - x0 >= 2 and y1 - y0 >= 2:
            out.append((labels[c], float(scores[q, c]), (float(x0), float(y0), float(x1), float(y1))))
    return out


def table_cells(tokens: list[str], boxes: list[tuple[float, float, float, float]]) -> list[dict]:
    """Cells {row, col, row_span, col_span, in_head, box} of a structure sequence; a cell takes the first free slot of its row."""
    taken: set[tuple[int, int]] = set()
    cells: list[dict] = []
    row, head, own = -1, False, iter(boxes)
    span = {"rowspan": 1, "colspan": 1}
    for token in tokens:
        if token in ("<thead>", "</thead>"):
            head = token == "<thead>"
        elif token == "<tr>":
            row += 1
        elif "span=" in token:
            name, _, value = token.strip().partition("=")
            span[name] = max(1, int(value.strip("\"'")))
        elif token in ("<td></td>", "<td>", ">"):
            col = next(c for c in range(len(taken) + 1) if (row, c) not in taken)
            taken |= {(row + i, col + j) for i in range(span["rowspan"]) for j in range(span["colspan"])}
            cells.append({"row": row, "col": col, "row_span": span["rowspan"], "col_span": span["colspan"], "in_head": head, "box": next(own, None)})
            span = {"rowspan": 1, "colspan": 1}
    return cells


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise."""
    order = sorted(map(tuple, points))

    def half(side) -> list:
        out: list = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(order) + half(reversed(order))) if len(order) > 2 else np.array(order)


def least_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Center, sides and angle of the smallest rectangle around points; one of its sides lies on the hull."""
    h = hull(points)
    best = None
    for a, b in pairwise([*h, h[0]]):
        angle = atan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[cos(angle), sin(angle)], [-sin(angle), cos(angle)]])
        p = h @ turn.T
        low, high = p.min(axis=0), p.max(axis=0)
        if best is None or np.prod(high - low) < best[0]:
            center = turn.T @ ((low + high) / 2)
            best = (np.prod(high - low), (*center, *(high - low), angle))
    return tuple(map(float, best[1]))


def parts(on: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each connected part (eight neighbours) of a mask, in order of their first pixels.

    Runs of pixels are joined with the runs they touch in the row above, so the work is in proportion to the runs.
    """
    edges = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(on.shape[0] + 1))
    for r in range(1, on.shape[0]):
        above, own = first[r - 1], first[r]
        for i in range(first[r], first[r + 1]):
            while above < own and end[above] < start[i]:
                above += 1
            k = above
            while k < own and start[k] <= end[i]:
                x, y = sorted((root(k), root(i)))
                up[y] = x
                k += 1
    groups: dict[int, list[int]] = {}
    for i in range(len(row)):
        groups.setdefault(root(i), []).append(i)
    return [(np.concatenate([np.full(end[i] - start[i], row[i]) for i in g]), np.concatenate([np.arange(start[i], end[i]) for i in g])) for g in groups.values()]


def text_boxes(mask: np.ndarray) -> list[tuple[float, tuple[float, float, float, float, float]]]:
    """(mean score, rectangle) of the mask's connected parts, let out in proportion to area by outline."""
    out = []
    for y, x in parts(mask > MASK):
        points = np.stack([x, y], axis=1).astype(float)
        # a row's first and last pixel are enough for the hull
        order = np.lexsort((x, y))
        ends = np.flatnonzero(np.r_[True, np.diff(y[order]) != 0, True])
        rim = points[order[np.r_[ends[:-1], ends[1:] - 1]]]
        if len(points) < 3 or len(hull(rim)) < 3:
            continue
        cx, cy, w, h, angle = least_rectangle(rim)
        score = float(mask[y, x].mean())
        if score >= MASK_SCORE and min(w, h) >= LEAST_SIDE:
            grow = 2 * w * h * LET_OUT / (2 * (w + h))
            out.append((score, (cx, cy, w + grow, h + grow, angle)))
    return out


def mask_boxes(masks: DataFrame) -> DataFrame:
    """(page_id, box_id, score, cx, cy, width, height, angle) of masks(page_id, rows, columns, scores array<float>, row by row)."""

    def run(rows: list) -> list[tuple]:
        return [(r.page_id, i, s, *box) for r in rows for i, (s, box) in enumerate(text_boxes(np.array(r.scores, dtype=float).reshape(r.rows, r.columns)))]

    return map_groups(masks.select("page_id", "rows", "columns", "scores"), "page_id", [], run, "page_id long, box_id long, score double, cx double, cy double, width double, height double, angle double")


def page_regions(outputs: DataFrame, labels: list[str]) -> DataFrame:
    """(page_id, region_id, label, score, x0, y0, x1, y1) in reading order, from outputs(page_id, width, height, logits, boxes, order_logits):
    queries x classes, queries x 4 in center form, and queries x queries."""

    def run(rows: list) -> list[tuple]:
        out = []
        for r in rows:
            logits = np.array([list(x) for x in r.logits], dtype=float).reshape(-1, len(labels))
            boxes, order = (np.array([list(x) for x in c], dtype=float).reshape(len(logits), -1) for c in (r.boxes, r.order_logits))
            out += [(r.page_id, i, label, score, *box) for i, (label, score, box) in enumerate(layout_regions(logits, boxes, labels, later_votes(order), (r.width, r.height)))]
        return out

    return map_groups(outputs, "page_id", [], run, "page_id long, region_id long, label string, score double, x0 double, y0 double, x1 double, y1 double")


def table_structures(sequences: DataFrame) -> DataFrame:
    """(region_id, cell_id, row, col, row_span, col_span, in_head, x0, y0, x1, y1) of sequences(region_id, tokens, boxes): structure tokens, and
    a box (four numbers) for each cell in their order; cells beyond the boxes have none."""

    def run(rows: list) -> list[tuple]:
        return [(r.region_id, i, c["row"], c["col"], c["row_span"], c["col_span"], c["in_head"], *(c["box"] if c["box"] is not None else [None] * 4)) for r in rows for i, c in enumerate(table_cells(list(r.tokens), [tuple(map(float, b)) for b in r.boxes]))]

    return map_groups(sequences, "region_id", [], run, "region_id long, cell_id long, row int, col int, row_span int, col_span int, in_head boolean, x0 double, y0 double, x1 double, y1 double")


def side_lengths(quad: np.ndarray) -> list[float]:
    return [hypot(*(b - a)) for a, b in pairwise([*quad, quad[0]])]
