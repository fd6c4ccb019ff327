"""Queries of the sequential kernels, with SQL where their input lets SQL tell the result; tests compare the others with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators import alignment, anchoring, assembly, document, layout, markup, pairing, scoring

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def with_sql(sql: str):
    def add(f):
        ORACLE_SQL[f.__name__] = sql
        return query(f)

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark, sf_dir) -> DataFrame:
    """Words on pages: an order's lines, in rows of four."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    x, y = (n % 4) * 280 + k % 40, F.floor(n / 4) * 30 + (k * n) % 5 + 150
    text = F.when(n % 4 == 1, "Status:").when(n % 4 == 2, F.col("o_orderstatus")).when(n % 4 == 3, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.col("l_quantity").cast("string"))
    return rows.select(F.floor(F.col("o_custkey")).cast("long").alias("page_id"), text.alias("text"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 90).cast("double").alias("x1"), (y + 14).cast("double").alias("y1"), (F.lit(1.0) - F.col("l_discount")).alias("conf"), (k * 10 + n).alias("ord"))


@query
def line_segments(spark, sf_dir):
    return layout.line_segments(words(spark, sf_dir))


@query
def reading_order(spark, sf_dir):
    own = words(spark, sf_dir).select("page_id", F.col("ord").alias("box_id"), "x0", "y0", "x1", "y1", F.lit(14.0).alias("line_height"))
    return layout.reading_order(own)


#: One region after the other, best score first; each is kept unless one of those kept before it hides it.
DEDUPE_SQL = """WITH RECURSIVE w AS (SELECT o_custkey AS page_id, l_orderkey * 10 + l_linenumber AS region_id, CASE (l_orderkey * 10 + l_linenumber) % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'footnote' WHEN 3 THEN 'image' ELSE 'header_image' END AS label, 1.0 - l_discount AS score,
      ((l_linenumber % 4) * 280 + l_orderkey % 40)::DOUBLE AS x0, (l_linenumber // 4 * 30 + (l_orderkey * l_linenumber) % 5 + 150)::DOUBLE AS y0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    b AS (SELECT *, x0 + 150 + 40 * (region_id % 3) AS x1, y0 + 24 + 8 * (region_id % 4) AS y1, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, region_id) AS k FROM w WHERE score >= 0.5),
    r AS (SELECT page_id, 0::BIGINT AS k, []::STRUCT(id BIGINT, label VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM (SELECT DISTINCT page_id FROM b) p
      UNION ALL SELECT r.page_id, b.k, CASE WHEN len(list_filter(list_transform(kept, lambda q: {'q': q, 'i': greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0)), 'a': (b.x1 - b.x0) * (b.y1 - b.y0), 'u': (q.x1 - q.x0) * (q.y1 - q.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)}),
        lambda t: (t.q.label = b.label AND t.i / (t.u - t.i) > 0.6) OR (t.q.label IN ('table', 'image') AND b.label IN ('text', 'footnote') AND t.i / t.a > 0.8) OR (t.i / (t.u - t.i) > 0.7 AND t.q.label NOT IN ('image', 'header_image') AND b.label NOT IN ('image', 'header_image')))) = 0
        THEN list_append(kept, {'id': b.region_id, 'label': b.label, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) ELSE kept END FROM r JOIN b ON b.page_id = r.page_id AND b.k = r.k + 1),
    l AS (SELECT page_id, arg_max(kept, k) AS kept FROM r GROUP BY 1) SELECT page_id, CAST(unnest(list_transform(kept, lambda q: q.id)) AS BIGINT) AS region_id FROM l"""


@with_sql(DEDUPE_SQL)
def dedupe_regions(spark, sf_dir):
    """Regions of five labels that overlap on orders' pages."""
    k = F.col("ord")
    label = F.when(k % 5 == 0, "table").when(k % 5 == 1, "text").when(k % 5 == 2, "footnote").when(k % 5 == 3, "image").otherwise("header_image")
    own = words(spark, sf_dir).select("page_id", k.alias("region_id"), label.alias("label"), F.col("conf").alias("score"), "x0", "y0", (F.col("x0") + 150 + 40 * (k % 3)).alias("x1"), (F.col("y0") + 24 + 8 * (k % 4)).alias("y1"))
    return layout.dedupe_regions(own)


@query
def interpret_regions(spark, sf_dir):
    """Regions of three customers each: labels in one column, values in the next."""
    c = table(spark, sf_dir, "customer")
    region, row = F.floor(F.col("c_custkey") / 3), F.col("c_custkey") % 3
    cell = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("Segment:").alias("text")), F.struct(F.lit(1).alias("k"), F.col("c_name").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("Balance:").alias("text")), F.struct(F.lit(3).alias("k"), F.concat(F.round("c_acctbal", 1).cast("string"), F.lit(" EUR")).alias("text"))))
    s = c.select(region.alias("region_id"), row.alias("row"), cell.alias("c"))
    x, y = (F.col("c.k") * 260 + 84).cast("double"), (F.col("row") * 40 + 150).cast("double")
    segs = s.select("region_id", (F.col("row") * 10 + F.col("c.k")).alias("seg"), F.col("c.text").alias("text"), x.alias("x0"), y.alias("y0"), (x + F.length("c.text") * 8).alias("x1"), (y + 16).alias("y1"), F.lit(16.0).alias("line_height"), F.lit(40.0).alias("pitch"), F.lit(1275.0).alias("page_width"))
    return pairing.interpret_regions(segs)


@query
def anchor_numbers(spark, sf_dir):
    """Order lines read with an error every few lines, anchored in the true ones."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    wrong = F.when(key % 5 == 0, F.concat(price, F.lit("1"))).when(key % 7 == 0, F.lit("77777")).otherwise(price)
    line = lambda p: F.concat(F.lit("Qty "), F.col("l_quantity").cast("int").cast("string"), F.lit(", price "), p, F.lit("."))
    source = rows.select(key.alias("page_id"), F.lit(0).alias("region"), F.col("l_linenumber").cast("long").alias("ord"), line(price).alias("text"))
    reading = rows.select(key.alias("page_id"), F.lit(0).alias("region"), F.col("l_linenumber").cast("long").alias("ord"), line(wrong).alias("text"))
    return anchoring.anchor_pages(reading, source)


@query
def markdown_blocks(spark, sf_dir):
    md = F.concat(F.lit("# Document\n\n"), F.col("text"), F.lit("\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n---\n"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(markup.blocks_udf()(md)).alias("place", "b"))
    return own.select("conv_id", "turn", "place", "b.kind", "b.depth", "b.text", F.size("b.cells").alias("n_rows"))


@with_sql(
    """SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY r) - 1 AS INTEGER) AS row, cells FROM (SELECT DISTINCT n_regionkey, '' AS r, 'Nations Name|Nations Key' AS cells FROM nation
    UNION ALL SELECT n_regionkey, '<tr><td>' || n_name || '</td><td>' || CAST(n_nationkey AS VARCHAR), n_name || '|' || CAST(n_nationkey AS VARCHAR) FROM nation) x"""
)
def html_table_grids(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>")))), "")
    pages = n.groupBy("n_regionkey").agg(F.concat(F.lit("<table><thead><tr><th colspan=2>Nations</th></tr><tr><th>Name</th><th>Key</th></tr></thead>"), rows, F.lit("</table>")).alias("html"))
    return pages.select("n_regionkey", F.posexplode(markup.html_grid_udf()(F.col("html"))).alias("row", "cells")).select("n_regionkey", "row", F.array_join("cells", "|").alias("cells"))


@with_sql("SELECT n_nationkey, unnest([0, 1])::INTEGER AS row, unnest([n_name || '|', CAST(n_nationkey AS VARCHAR) || '||x y']) AS cells FROM nation")
def cell_dialect_grids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("<fcel>"), F.col("n_name"), F.lit("<ecel><nl><fcel>"), F.col("n_nationkey").cast("string"), F.lit("<lcel>more<fcel> x \n y<nl>")).alias("s"))
    return n.select("n_nationkey", F.posexplode(markup.cell_dialect_grid(F.col("s"))).alias("row", "cells")).select("n_nationkey", "row", F.array_join("cells", "|").alias("cells"))


@with_sql(
    """WITH d AS (SELECT doc_id, text || repeat(' again ' || CAST(doc_id % 10 AS VARCHAR), CAST(doc_id % 7 AS INTEGER)) AS s FROM documents), u AS (SELECT doc_id, s, list_min(list_filter(range(8, least(120, length(s) // 4) + 1), lambda k: right(s, 4 * k) = repeat(right(s, k), 4))) AS k FROM d),
    n AS (SELECT *, CASE WHEN k IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(4, least(1000, length(s) // k)), lambda c: right(s, (c + 1) * k) <> repeat(right(s, k), c + 1))), least(1000, length(s) // k)) END AS reps FROM u)
    SELECT doc_id, CAST(CASE WHEN s IS NULL THEN NULL WHEN reps = 0 THEN length(s) ELSE length(regexp_replace(left(s, length(s) - k * (reps - 1)), '\\s+$', '')) END AS INTEGER) AS n_left, reps > 0 AS repetition FROM n"""
)
def repeats_cut(spark, sf_dir):
    """Documents with a tail that repeats up to six times."""
    tail = F.expr("repeat(concat(' again ', cast(doc_id % 10 as string)), cast(doc_id % 7 as int))")
    cut = table(spark, sf_dir, "documents").select("doc_id", markup.without_repeats_udf()(F.concat("text", tail)).alias("r"))
    return cut.select("doc_id", F.length("r.text").alias("n_left"), "r.repetition")


@query
def assembled_blocks(spark, sf_dir):
    """Blocks of the pages that line_segments builds."""
    return assembly.assemble_pages(layout.line_segments(words(spark, sf_dir)).withColumn("page_width", F.lit(1275.0)))


@with_sql(
    """WITH k AS (SELECT c_custkey AS page_id, c_custkey % 3 = 0 AS swapped, c_custkey % 5 = 0 AS other FROM customer)
    SELECT page_id, 2::BIGINT AS gt_pairs, CASE WHEN swapped THEN 0 WHEN other THEN 1 ELSE 2 END::BIGINT AS tp, CASE WHEN swapped THEN 2 WHEN other THEN 1 ELSE 0 END::BIGINT AS fp, 2::BIGINT AS emitted, CASE WHEN swapped THEN 2 WHEN other THEN 1 ELSE 0 END::BIGINT AS mispaired,
    0::BIGINT AS in_table, 0::BIGINT AS in_list, 0::BIGINT AS unpaired, 0::BIGINT AS ocr_miss, 1::BIGINT AS critical_total, CASE WHEN swapped THEN 0 ELSE 1 END::BIGINT AS critical_found FROM k"""
)
def pair_outcomes(spark, sf_dir):
    """Customers as pages of two true pairs; every third prediction has its values exchanged, every fifth lacks one."""
    c = table(spark, sf_dir, "customer")
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")

    def item(role: str, n: int, label, value):
        return F.struct(F.lit(role).alias("role"), F.lit(n).alias("ord"), label.alias("label"), value.alias("value"))

    swapped = key % 3 == 0
    items = F.array(
        item("true", 0, F.lit("Name"), name), item("true", 1, F.lit("Segment"), segment), item("fields", 2, F.lit("id"), name), item("text", 3, F.lit(""), F.concat_ws(" ", name, segment)),
        item("predicted", 4, F.lit("Name:"), F.when(swapped, segment).otherwise(name)), item("predicted", 5, F.when(key % 5 == 0, "Other").otherwise("Segment"), F.when(swapped, name).otherwise(segment)),
    )
    return scoring.score_pages(c.select(key.alias("page_id"), F.explode(items).alias("i")).select("page_id", "i.role", "i.ord", "i.label", "i.value"))


@query
def deep_documents(spark, sf_dir):
    """Each order's lines as a page: a table region of its items, a text region, orphans, and a reading of the table with an error."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    n, key = F.col("l_linenumber"), F.col("o_orderkey")
    region = F.when(n <= 4, "items").when(n <= 6, "note")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    x, y = ((n - 1) % 2 * 400 + 84).cast("double"), (F.floor((n - 1) / 2) * 40 + 150).cast("double")
    items = F.concat(F.lit("| Price | Status |\n| --- | --- |\n| "), F.max(F.when(n == 1, price)).over(Window.partitionBy(key)), F.lit("1 | open |"))
    box = [F.when(region == "items", v).otherwise(w).cast("double") for v, w in ((80, 80), (140, 220), (700, 700), (215, 320))]
    lines = rows.select(
        key.alias("page_id"), n.cast("long").alias("ord"), region.alias("region_key"), F.when(region == "items", 0).otherwise(1).alias("rank"), F.when(region == "items", "table").otherwise("text").alias("region_kind"),
        *[b.alias(c) for b, c in zip(box, ("rx0", "ry0", "rx1", "ry1"), strict=True)], price.alias("text"), x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 16).alias("y1"), F.lit(1275.0).alias("page_width"),
        F.when(region == "items", items).alias("reading"),
    )
    return document.documents(lines)


@query
def char_labels(spark, sf_dir):
    """Part names read with a letter exchanged, labelled against the true ones."""
    p = table(spark, sf_dir, "part")
    read = F.translate("p_name", "aeo", "@eo")
    return alignment.char_labels(p.select(F.col("p_partkey").alias("line_id"), read.alias("text"), F.col("p_name").alias("truth"), F.transform(F.filter(F.split(read, ""), lambda c: c != ""), lambda c, i: (F.lit(1.0) - i * 0.01)).alias("char_conf")))
