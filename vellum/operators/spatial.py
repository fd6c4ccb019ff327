"""Joins and orders of boxes. Every join has the page as its equality key, so it never meets boxes of other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import geometry as g
from vellum.functions import text as t

PAGE = "page_id"
#: Shares and gaps of the rules below.
HALF, ORPHAN_GAP, BAND_WIDTH, COLUMN_GAP, GT_SHARE = 0.5, 2.5, 0.7, 0.12, 0.3


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def assign_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, line_id, region_id): each line's region, null for orphans.

    A region takes a line with half of the line's area inside it or the line's center; the largest share wins, then the smaller region, then
    the first. lines(page_id, line_id, box), regions(page_id, region_id, region_box).
    """
    share = F.when(g.area(F.col("box")) > 0, g.inter_area(F.col("box"), F.col("region_box")) / g.area(F.col("box"))).otherwise(0.0)
    inside = g.contains(F.col("region_box"), g.center_x(F.col("box")), g.center_y(F.col("box")))
    pairs = lines.join(regions, PAGE).withColumn("share", F.round(share, 9)).where((F.col("share") >= HALF) | inside)
    best = best_of(pairs, [PAGE, "line_id"], [F.desc("share"), g.area(F.col("region_box")), F.col("region_id")])
    return lines.select(PAGE, "line_id").join(best.select(PAGE, "line_id", "region_id"), [PAGE, "line_id"], "left")


def orphan_clusters(lines: DataFrame, line_height: Column) -> DataFrame:
    """(page_id, line_id, cluster int from 0): lines from top to bottom; a gap of over 2.5 lines below all lines so far starts anew."""
    w = Window.partitionBy(PAGE).orderBy(F.col("box.y0"), F.col("box.x0"), "line_id")
    low = F.max("box.y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("box.y0") - low > line_height * ORPHAN_GAP, 1).otherwise(0)
    return lines.withColumn("__fresh", fresh).select(PAGE, "line_id", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


def provenance(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, block_id, line_ids, worst): the lines with half of their area in a block and the lowest confidence among them, at most 1."""
    inside = g.inter_area(F.col("box"), F.col("block_box")) >= HALF * g.area(F.col("box"))
    hits = blocks.join(lines, PAGE).where(inside & (g.area(F.col("box")) > 0)).groupBy(PAGE, "block_id").agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"), F.least(F.lit(1.0), F.min("conf")).alias("worst"))
    return blocks.select(PAGE, "block_id").join(hits, [PAGE, "block_id"], "left").select(PAGE, "block_id", F.coalesce("line_ids", F.array().cast("array<bigint>")).alias("line_ids"), F.coalesce("worst", F.lit(1.0)).alias("worst"))


def fill_table(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """(page_id, line_id, cell_id): each line's nearest cell, by overlap and then distance; no line is dropped."""
    pairs = lines.join(cells, PAGE)
    overlap, distance = F.round(1 - g.iou(F.col("box"), F.col("cell_box")), 12), F.round(g.match_distance(F.col("box"), F.col("cell_box")), 9)
    return best_of(pairs, [PAGE, "line_id"], [overlap, distance, F.col("cell_id")]).select(PAGE, "line_id", "cell_id")


def slot_cover(cells: DataFrame) -> DataFrame:
    """(page_id, row, col, cell_id): the cell of each grid slot; of cells that span the same slot, the last."""
    slots = cells.select(PAGE, "cell_id", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), "col", "col_span").select(PAGE, "cell_id", "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    return slots.groupBy(PAGE, "row", "col").agg(F.max("cell_id").alias("cell_id"))


def ground_truth_lines(lines: DataFrame, truth: DataFrame) -> DataFrame:
    """(page_id, line_id, truth_text): from left to right, the true lines that share 30 % of the smaller box. Lines without any are absent."""
    least = F.least(g.area(F.col("box")), g.area(F.col("truth_box")))
    pairs = lines.join(truth, PAGE).where((least > 0) & (g.inter_area(F.col("box"), F.col("truth_box")) >= GT_SHARE * least))
    parts = F.array_sort(F.collect_list(F.struct(F.col("truth_box.x0").alias("x"), F.col("truth_id").alias("i"), F.col("text").alias("t"))))
    return pairs.groupBy(PAGE, "line_id").agg(F.concat_ws(" ", parts["t"]).alias("truth_text"))


def column_order(boxes: DataFrame, page_width: Column) -> DataFrame:
    """(page_id, box_id, place from 0): reading order by columns. Boxes wider than 70 % of the page part it into bands; in a band, columns
    are runs of left edges without a gap of over 12 % of the page, read one after the other."""
    w = Window.partitionBy(PAGE).orderBy(F.col("box.y0"), "box_id")
    wide = boxes.withColumn("wide", g.width(F.col("box")) > page_width * BAND_WIDTH)
    bands = wide.withColumn("band", F.sum(F.col("wide").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_x = Window.partitionBy(PAGE, "band", "wide").orderBy(F.col("box.x0"), "box_id")
    step = F.when(F.col("box.x0") - F.lag("box.x0").over(by_x) > page_width * COLUMN_GAP, 1).otherwise(0)
    columns = bands.withColumn("__s", step).withColumn("column", F.sum("__s").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    final = Window.partitionBy(PAGE).orderBy("band", F.desc("wide"), "column", F.col("box.y0"), "box_id")
    return columns.select(PAGE, "box_id", (F.row_number().over(final) - 1).alias("place"))


def order_above(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """(page_id, mark_id, block_id): the last block in block order that begins no lower than the mark; the first block if none does."""
    pairs = marks.join(blocks, PAGE)
    last = F.max(F.when(F.col("block_box.y0") <= F.col("mark_y"), F.col("block_id")))
    return pairs.groupBy(PAGE, "mark_id").agg(F.coalesce(last, F.min("block_id")).alias("block_id"))


def smallest_at(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """(page_id, point_id, block_id): the smallest block around each point, the first of equals; points outside all are absent."""
    pairs = points.join(blocks, PAGE).where(g.contains(F.col("block_box"), F.col("x"), F.col("y")))
    return best_of(pairs, [PAGE, "point_id"], [g.area(F.col("block_box")), F.col("block_id")]).select(PAGE, "point_id", "block_id")


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with `value` of right's last row of the same keys at or before `at`: one pass over the ordered union, no range join."""
    both = left.withColumn("__left", F.lit(True)).unionByName(right.select(*keys, at, value).withColumn("__left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__left").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(~F.col("__left"), F.col(value)), ignorenulls=True).over(w)).where("__left").drop("__left")


def export_regions(regions: DataFrame, assigned: DataFrame, pages: DataFrame, pad: float, least: int) -> DataFrame:
    """(page_id, region_id, region_key, kind, score, box, crop, skipped, n_lines): what is cut out of a page's image for reading.

    regions(page_id, region_id, label, score, region_box), assigned(page_id, line_id, region_id), pages(page_id, width, height). The crop is
    the padded box in whole pixels inside the page. Skipped are pictures without a line and crops of fewer than `least` pixels either way.
    """
    lines = assigned.where("region_id IS NOT NULL").groupBy(PAGE, "region_id").agg(F.count(F.lit(1)).alias("n_lines"))
    own = regions.join(pages, PAGE).join(lines, [PAGE, "region_id"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)).cast("long")).withColumn("kind", t.region_kind(F.col("label")))
    b = F.col("region_box")
    x0, y0 = F.greatest(F.lit(0), F.floor(b["x0"] - pad)), F.greatest(F.lit(0), F.floor(b["y0"] - pad))
    w, h = F.greatest(F.lit(1), F.least(F.col("width"), F.ceil(b["x1"] + pad)) - x0), F.greatest(F.lit(1), F.least(F.col("height"), F.ceil(b["y1"] + pad)) - y0)
    skipped = F.when((F.col("kind") == "imageish") & (F.col("n_lines") == 0), "imageish-no-text").when((w < least) | (h < least), "too-small")
    crop = F.struct(*[v.cast("long").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x0 + w), ("y1", y0 + h))])
    key = t.region_key(F.col("label"), b["x0"], b["y0"], b["x1"], b["y1"])
    return own.select(PAGE, "region_id", key.alias("region_key"), "kind", (F.floor(F.col("score") * 1e4 + 0.5) / 1e4).alias("score"), b.alias("box"), F.when(skipped.isNull(), crop).alias("crop"), skipped.alias("skipped"), "n_lines")


def cells_on_page(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """cells(page_id, region_id, cell_id, box in the region's crop) with box on the page; regions(page_id, region_id, region_box). The crop has
    the region's size in whole pixels, one at least."""
    b = F.col("region_box")
    sx, sy = ((b[f"{a}1"] - b[f"{a}0"]) / F.greatest(F.lit(1.0), F.floor(b[f"{a}1"] - b[f"{a}0"] + 0.5)) for a in "xy")
    box = F.struct(*[(b[f"{n[0]}0"] + F.col(f"box.{n}") * (sx if n[0] == "x" else sy)).alias(n) for n in ("x0", "y0", "x1", "y1")])
    kept = [c for c in cells.columns if c != "box"]
    return cells.join(regions, [PAGE, "region_id"]).select(*kept, box.alias("box"))
