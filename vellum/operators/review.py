"""The review side: a ranked worklist, event-sourced corrections, and Markdown from blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.grouped import map_groups

#: Item categories in order of urgency, those that the threshold filters, and the threshold's bounds.
RANKS = {"fabricated-number": 0, "omitted-number": 1, "conflict": 2, "advisory-word": 3, "uncertain-pair": 4, "low-block": 5, "low-line": 6, "coverage-gap": 7}
FILTERED = ("uncertain-pair", "low-block", "low-line")
TAU_LOW, TAU_HIGH, TAU = 0.3, 0.95, 0.5


def worklist(sources: list[DataFrame], dismissed: DataFrame, tau: float = TAU) -> DataFrame:
    """(page_id, place from 1, item_id, category, score): items of all sources but those dismissed or above the threshold, by rank, score and
    order. A source has page_id, item_id, category, score and ord; only the categories in FILTERED heed the threshold."""
    items = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), F.col("category"))
    kept = items.join(dismissed.select("page_id", "item_id").distinct(), ["page_id", "item_id"], "left_anti").where(~F.col("category").isin(*FILTERED) | (F.col("score") < max(TAU_LOW, min(TAU_HIGH, tau))))
    w = Window.partitionBy("page_id").orderBy(rank, "score", "source", "ord", "item_id")
    return kept.select("page_id", F.row_number().over(w).alias("place"), "item_id", "category", "score")


def replayed(rows: list) -> list[tuple]:
    """(page_id, uid, place, markdown) of one page's rows (page_id, phase, seq, kind, uid, after_uid, markdown): its blocks, then its events.

    An added block stands right after the block it names, before earlier additions there; without a name it opens the page, and after a name
    that isn't known yet it ends the page. Edits change the block that has the name at that time; removed blocks go last, so others can
    still be added after them.
    """
    opening, body, ending, after, text, gone = [], [], [], {}, {}, set()
    for r in rows:
        if r.kind == "block":
            body.append(r.uid)
            text[r.uid] = r.markdown
        elif r.kind == "text-edit" and r.uid in text:
            text[r.uid] = r.markdown
        elif r.kind == "block-remove":
            gone.add(r.uid)
        elif r.kind == "region-add":
            (opening if r.after_uid is None else after.setdefault(r.after_uid, []) if r.after_uid in text else ending).append(r.uid)
            text[r.uid] = r.markdown
    todo, order = [*opening[::-1], *body, *ending][::-1], []
    while todo:
        uid = todo.pop()
        order.append(uid)
        todo += after.get(uid, [])
    return [(rows[0].page_id, uid, place, text[uid]) for place, uid in enumerate(u for u in order if u not in gone)]


def replay(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, uid, place, markdown): the blocks of each page after its corrections, see `replayed`.

    blocks(page_id, uid, place, markdown); events(page_id, seq, kind, uid, after_uid, markdown), uid being the block that an event changes,
    removes or adds. Pages without blocks have their added ones.
    """
    base = blocks.select("page_id", F.lit(0).alias("phase"), F.col("place").cast("long").alias("seq"), F.lit("block").alias("kind"), "uid", F.lit(None).cast("string").alias("after_uid"), "markdown")
    log = events.where(F.col("kind").isin("text-edit", "block-remove", "region-add")).select("page_id", F.lit(1).alias("phase"), F.col("seq").cast("long").alias("seq"), "kind", "uid", "after_uid", "markdown")
    return map_groups(base.union(log), "page_id", ["phase", "seq"], replayed, "page_id long, uid string, place int, markdown string")


def dismissed_ids(events: DataFrame) -> DataFrame:
    return events.where("kind = 'dismiss'").select("page_id", F.col("uid").alias("item_id")).distinct()


def fragment(kind: Column, depth: Column, text: Column, lead: Column, label: Column, value: Column) -> Column:
    """The Markdown of one block, tables excepted."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text))
        .when(kind == "listItem", F.concat(F.lit("- "), F.when(lead.isNotNull() & (lead != ""), F.concat(F.lit("**"), lead, F.lit(":** "))).otherwise(""), text))
        .when(kind == "kv", F.concat(F.lit("**"), label, F.lit(":** "), value)).when(kind == "rule", "---").otherwise(text)
    )


def render(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, markdown) of blocks(keys, order, kind, fragment): runs of list items or of label lines stand tight, others a blank line apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("kind").over(w)
    gap = F.when(before.isNull(), "").when((before == F.col("kind")) & F.col("kind").isin("listItem", "kv"), "\n").otherwise("\n\n")
    parts = blocks.withColumn("__part", F.concat(gap, F.col("fragment")))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__part").alias("p"))))["p"], "")
    return parts.groupBy(*keys).agg(F.concat(joined, F.lit("\n")).alias("markdown"))


def grid_to_gfm(cells: Column) -> Column:
    """A pipe table from rows of cells: bars become slashes, short rows are filled, and the first row is the header."""
    most = F.array_max(F.transform(cells, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))), lambda c: F.trim(F.translate(c, "|", "/"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), most), " | "), F.lit(" |"))
    rows = F.transform(cells, line)
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def page_status(items: Column) -> Column:
    return F.when(items > 0, "needs-review").otherwise("done")


def annotations(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, number, item_id, uid): worklist items with their place as number and the block they are shown at.

    items(page_id, place, item_id, own_uid, y); blocks(page_id, uid, block_idx, y0). An item whose own block is gone is shown at the last
    block in order that begins no lower than it, or at the first block; items of pages without blocks are absent, their numbers stay used.
    """
    pairs = items.join(blocks, "page_id")
    own = F.max(F.when(F.col("uid") == F.col("own_uid"), F.col("uid")))
    above = F.max_by("uid", F.when(F.col("y0") <= F.col("y"), F.col("block_idx")))
    first = F.min_by("uid", "block_idx")
    return pairs.groupBy("page_id", "place", "item_id").agg(F.coalesce(own, above, first).alias("uid")).select("page_id", F.col("place").alias("number"), "item_id", "uid")


def session_events(events: DataFrame, sessions: DataFrame, hashes: DataFrame) -> DataFrame:
    """The events that still hold: those of pages whose blocks have the hash that the session began with, after the last reset, without
    what was undone.

    sessions(page_id, base_hash, undone: how many last events are taken back); hashes(page_id, hash) of the blocks as they are now. A reset
    is an event of kind reset, where events have kinds; a page's threshold isn't part of its log and outlives a reset.
    """
    if "kind" in events.columns:
        since = events.where("kind = 'reset'").groupBy("page_id").agg(F.max("seq").alias("__since"))
        events = events.join(since, "page_id", "left").where(F.col("__since").isNull() | (F.col("seq") > F.col("__since"))).drop("__since")
    live = sessions.join(hashes, "page_id").where(F.col("base_hash") == F.col("hash")).select("page_id", "undone")
    w = Window.partitionBy("page_id").orderBy(F.desc("seq"))
    own = events.join(live, "page_id").withColumn("__back", F.row_number().over(w))
    return own.where(F.col("__back") > F.col("undone")).drop("__back", "undone")


def block_hashes(blocks: DataFrame) -> DataFrame:
    """(page_id, hash) over a page's blocks in order: whether corrections still meet the blocks they were made for."""
    rows = F.array_sort(F.collect_list(F.struct("place", "uid", "markdown")))
    return blocks.groupBy("page_id").agg(F.sha2(F.to_json(rows), 256).alias("hash"))


def tau_in_bounds(tau: Column) -> Column:
    return F.greatest(F.lit(TAU_LOW), F.least(F.lit(TAU_HIGH), tau))


def swapped_reading(markdown: Column, own: Column, other: Column) -> Column:
    """The text with one reading instead of the other, null unless the first stands there once and not inside a longer number."""
    parts = F.split(markdown, F.concat(F.lit(r"\Q"), own, F.lit(r"\E")), -1)
    before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    inside = before.rlike(r"\d\z") & own.rlike(r"^\d") | after.rlike(r"^\d") & own.rlike(r"\d\z")
    return F.when((F.size(parts) == 2) & (own != "") & ~inside, F.concat(before, other, after))


def counts_sentence(fab_numbers: Column, omit_numbers: Column, fab_words: Column, omit_words: Column) -> Column:
    """A sentence on the flagged tokens of a page."""
    many = lambda n, one, more: F.when(n > 1, more).otherwise(one)
    parts = [
        F.when(fab_numbers > 0, F.concat(fab_numbers.cast("string"), many(fab_numbers, " number in the result wasn’t found in the scan", " numbers in the result weren’t found in the scan"))),
        F.when(omit_numbers > 0, F.concat(omit_numbers.cast("string"), many(omit_numbers, " number from the scan may be missing", " numbers from the scan may be missing"))),
        F.when(fab_words > 0, F.concat(fab_words.cast("string"), many(fab_words, " word couldn’t be matched to the scan", " words couldn’t be matched to the scan"))),
        F.when(omit_words > 0, F.concat(omit_words.cast("string"), many(omit_words, " word from the scan may be missing", " words from the scan may be missing"))),
    ]
    told = F.concat_ws("; ", *parts)
    return F.when(told == "", "Everything matched the scan.").otherwise(F.concat(told, F.lit(".")))


def verdict_view(verdict: Column, fell_back: Column, sentence: Column) -> Column:
    """struct(tone, title, detail) for a page's verdict; a page that fell back to the source's reading says so first."""

    def view(tone: str, title: str, detail: Column) -> Column:
        return F.struct(F.lit(tone).alias("tone"), F.lit(title).alias("title"), detail.alias("detail"))

    passed = view("ok", "Checks passed", F.lit("Every number in the result was found in the scan."))
    kept = view("caution", "Switched to the exact transcription here", F.lit("The model's reading failed a check, so the text copied from the page was kept instead."))
    return F.when(fell_back, kept).when(verdict == "review", view("caution", "A few things to skim", sentence)).when(verdict == "fallback", view("attention", "Worth your eyes", sentence)).otherwise(passed)


def attention_summary(items: Column) -> Column:
    return F.when(items <= 0, "Nothing looks out of place.").otherwise(F.concat(items.cast("string"), F.when(items == 1, " spot").otherwise(" spots"), F.lit(" flagged for a look")))


def redrawn(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Events that add what was read in drawn regions: (page_id, seq, kind, uid, after_uid, markdown, box).

    found(region_id, block_idx, markdown, box) are blocks in the crop's own coordinates; regions(region_id, page_id, x0, y0, seq, after_uid)
    say where the crop was taken, after which event, and after which block its first one stands. Each other follows the one before.
    """
    w = Window.partitionBy("region_id").orderBy("block_idx")
    uid = lambda k: F.concat(F.lit("r"), F.col("region_id").cast("string"), F.lit("-"), k.cast("string"))
    own = found.join(regions, "region_id").withColumn("__k", F.row_number().over(w) - 1)
    box = F.struct(*[(F.col(f"box.{c}") + F.col(c[0] + "0")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    after = F.when(F.col("__k") == 0, F.col("after_uid")).otherwise(uid(F.col("__k") - 1))
    return own.select("page_id", (F.col("seq") + F.col("__k")).cast("long").alias("seq"), F.lit("region-add").alias("kind"), uid(F.col("__k")).alias("uid"), after.alias("after_uid"), "markdown", box.alias("box"))


def uncertainty_layer(pages: DataFrame, lines: DataFrame, gaps: DataFrame, blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, width, height, calibration, lines, gaps, blocks, items): one row for each page, its parts as arrays in order.

    pages(page_id, width, height, calibration); lines(page_id, line_id, …), gaps(page_id, cluster, …), blocks(page_id, block_id, …) and
    items(page_id, ord, …) with any other columns. Parts that a page lacks are empty.
    """
    out = pages
    for name, df, first in (("lines", lines, "line_id"), ("gaps", gaps, "cluster"), ("blocks", blocks, "block_id"), ("items", items, "ord")):
        rest = [c for c in df.columns if c not in ("page_id", first)]
        own = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(first, *rest))).alias(name))
        kind = own.schema[name].dataType.simpleString()
        out = out.join(own, "page_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out
