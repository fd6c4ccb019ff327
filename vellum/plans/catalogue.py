"""The query catalogue: every query of the engine over the driver's tables, and its SQL.

The tables hold no boxes and no scanned lines, so queries on geometry derive them from key columns by whole-number arithmetic, alike here and
in SQL. Doubles are rounded to 6 places, counts are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import geometry as g
from vellum.functions import stats as st
from vellum.functions import text as t
from vellum.operators import audit, calibration, evaluation, pairing, review, spatial
from vellum.plans import kernel_queries, page_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def long(c: Column) -> Column:
    return c.cast("long")


# ---- text ----


@query(
    "extract_tokens",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\d[\d.,/:%-]*\d|\d')) AS BIGINT) AS n_numbers,
    coalesce(array_to_string(list_transform(regexp_extract_all(text, '\d[\d.,/:%-]*\d|\d'), lambda x: regexp_replace(x, '[.,/:%-]+$', '')), ' '), '') AS numbers,
    CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) AS BIGINT) AS n_words FROM documents""",
)
def extract_tokens(spark, sf_dir):
    numbers = t.extract_numbers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", long(F.size(numbers)).alias("n_numbers"), F.array_join(numbers, " ").alias("numbers"), long(F.size(t.extract_words(F.col("text")))).alias("n_words"))


@query(
    "normalize_fields",
    r"""SELECT c_custkey, regexp_replace(lower(c_name), '[\s.\-/]', '', 'g') AS as_id, lower(trim(c_name)) AS as_name, trim(regexp_replace(regexp_replace(lower(c_mktsegment), '[.,]', '', 'g'), '\s+', ' ', 'g')) AS as_date FROM customer""",
)
def normalize_fields(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", t.normalize_field(F.col("c_name"), "id").alias("as_id"), t.normalize_field(F.col("c_name"), "name").alias("as_name"), t.normalize_field(F.col("c_mktsegment"), "date").alias("as_date"))


def strings(spark, sf_dir) -> DataFrame:
    """Distinct strings of the dimensions, dates and measures in words."""
    day = F.col("o_orderdate")
    parts = [
        table(spark, sf_dir, "part").select(F.col("p_name").alias("s")), table(spark, sf_dir, "part").select(F.col("p_brand").alias("s")), table(spark, sf_dir, "part").select(F.col("p_type").alias("s")),
        table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(":")).alias("s")), table(spark, sf_dir, "orders").select(F.date_format(day, "yyyy-MM-dd").alias("s")),
        table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(" cm")).alias("s")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("s")),
        table(spark, sf_dir, "orders").select(F.concat(F.lit("Order of "), F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus"), F.lit(".")).alias("s")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


STRINGS_SQL = """strings AS (SELECT DISTINCT s FROM (SELECT p_name AS s FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name || ':' FROM nation
    UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT CAST(p_size AS VARCHAR) || ' cm' FROM part UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT 'Order of ' || o_orderpriority || ', status ' || o_orderstatus || '.' FROM orders) u)"""

SHAPES_SQL = r"""
    shaped AS (SELECT s, trim(regexp_replace(s, ':$', '')) AS b FROM strings),
    flags AS (SELECT s, b,
      regexp_matches(b, '^\d{1,2}[ \-/.](?:[A-Za-z]{3,9}\.?|\d{1,2})[ \-/.,]\s?\d{2,4}$') OR regexp_matches(b, '^[A-Za-z]{3,9}\.?\s\d{1,2},?\s\d{2,4}$') OR regexp_matches(b, '^\d{4}-\d{2}-\d{2}$') AS is_date,
      length(regexp_replace(b, '[\s\-/.+()]', '', 'g')) >= 5 AND regexp_matches(regexp_replace(b, '[\s\-/.+()]', '', 'g'), '^[A-Za-z0-9]+$')
        AND length(regexp_replace(regexp_replace(b, '[\s\-/.+()]', '', 'g'), '\D', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(b, '[\s\-/.+()]', '', 'g'))) >= 0.6 AS is_id,
      regexp_matches(b, '^[<>~≈]?\d+(?:[.,]\d+)?\s*[A-Za-zµ%°]{1,7}(?:/[A-Za-zµ]{1,7})?$') OR regexp_matches(b, '^[<>~≈]?\d+(?:[.,:/+=×x-]\d+)*\s*%?$') AS is_measure,
      regexp_matches(b, '^(?i:Dr|Mr|Mrs|Ms|Prof)\.?\s+\S') OR (regexp_matches(b, '^[A-Z][A-Za-z''’ .-]{0,30},\s+[A-Z]') AND len(list_filter(regexp_split_to_array(b, '[\s,]+'), lambda w: w <> '')) <= 6
        AND len(list_filter(regexp_split_to_array(b, '[\s,]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[A-Z]'))) = 0) AS is_name,
      len(list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> '')) >= 8 AND len(list_filter(regexp_split_to_array(b, '\s+'), lambda w: regexp_matches(w, '^[a-z]')))::DOUBLE / greatest(1, len(list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> ''))) >= 0.4 AS is_sentence
      FROM shaped)"""

VOTES_SQL = (
    SHAPES_SQL
    + r""",
    parts AS (SELECT *, list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> '') AS ws, regexp_matches(s, ':$') AND length(s) > 1 AS colon, is_date OR is_id OR is_measure OR is_name OR is_sentence AS val FROM flags),
    counts AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Za-z]{1,7}-?\d{1,3}[a-z]?$'))) AS mk, length(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS al, length(regexp_replace(b, '\D', '', 'g')) AS dg FROM parts),
    votes AS (SELECT s, (colon OR val) AS strong, CASE WHEN s = '' THEN 0.0 WHEN colon AND val THEN 0.0 WHEN colon THEN 1.0 WHEN val THEN -1.0 ELSE greatest(-1.0, least(1.0,
        (CASE WHEN n <= 2 THEN 0.4 WHEN n <= 4 THEN 0.15 WHEN n <= 7 THEN -0.3 ELSE -0.6 END)::DOUBLE
      + (CASE WHEN regexp_matches(b, '^[a-z]') THEN -0.25 WHEN len(list_filter(ws, lambda w: NOT regexp_matches(w, '^[A-Z0-9(]'))) = 0 THEN 0.3 ELSE 0 END)::DOUBLE
      + CASE WHEN mk = n AND n >= 2 THEN -0.3::DOUBLE WHEN (mk = n AND n = 1) OR al = 0 THEN 0::DOUBLE ELSE -0.8::DOUBLE * least(1.0::DOUBLE, 2.0::DOUBLE * dg / al) END
      + (CASE WHEN regexp_matches(b, '[.,;]$') AND NOT (regexp_matches(b, '\.$') AND length(ws[-1]) <= 4) THEN -0.3 ELSE 0 END)::DOUBLE)) END AS v FROM counts)"""
)


@query("type_shapes", "WITH " + STRINGS_SQL + "," + SHAPES_SQL + " SELECT s, is_date, is_id, is_measure, is_name, is_sentence FROM flags")
def type_shapes(spark, sf_dir):
    b = t.trimmed(F.regexp_replace("s", r":\z", ""))
    return strings(spark, sf_dir).select("s", t.is_date_shaped(b).alias("is_date"), t.is_id_shaped(b).alias("is_id"), t.is_measurement_shaped(b).alias("is_measure"), t.is_name_shaped(b).alias("is_name"), t.is_sentence_shaped(b).alias("is_sentence"))


@query("cell_votes", "WITH " + STRINGS_SQL + "," + VOTES_SQL + " SELECT s, round(v, 6) AS v, strong FROM votes")
def cell_votes(spark, sf_dir):
    vote = t.cell_vote(F.col("s"))
    return strings(spark, sf_dir).select("s", r6(vote["v"]).alias("v"), vote["strong"].alias("strong"))


@query(
    "group_votes",
    "WITH " + STRINGS_SQL + "," + VOTES_SQL + """ SELECT CAST(length(s) % 7 AS BIGINT) AS grp, round(sum(CASE WHEN strong THEN 1.0 ELSE 0.5 END * v) / sum(CASE WHEN strong THEN 1.0 ELSE 0.5 END), 6) AS vote,
    round(CASE WHEN sum(CASE WHEN abs(v) >= 0.05 THEN 1 ELSE 0 END) < 2 THEN 0.5 ELSE abs(sum(CASE WHEN abs(v) >= 0.05 THEN CASE WHEN strong THEN 1.0 ELSE 0.5 END * v END)) / sum(CASE WHEN abs(v) >= 0.05 THEN CASE WHEN strong THEN 1.0 ELSE 0.5 END * abs(v) END) END, 6) AS alignment
    FROM votes GROUP BY 1""",
)
def group_votes(spark, sf_dir):
    votes = strings(spark, sf_dir).select(long(F.length("s") % 7).alias("grp"), t.cell_vote(F.col("s")).alias("vote"))
    return votes.groupBy("grp").agg(r6(t.group_vote(F.col("vote"))).alias("vote"), r6(t.sign_alignment(F.col("vote"))).alias("alignment"))


def kv_lines(spark, sf_dir) -> DataFrame:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return c.select(F.concat(F.col("c_mktsegment"), F.lit(": "), F.col("c_name")).alias("line")).union(p.select(F.concat(F.lit("Size ("), F.col("p_brand"), F.lit("): "), F.col("p_size").cast("string"), F.lit(" cm")).alias("line"))).union(
        p.select(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(": 30 and "), F.col("p_type")).alias("line"))
    ).distinct()


KV_SQL = r"""WITH lines AS (SELECT DISTINCT line FROM (SELECT c_mktsegment || ': ' || c_name AS line FROM customer UNION ALL SELECT 'Size (' || p_brand || '): ' || CAST(p_size AS VARCHAR) || ' cm' FROM part
    UNION ALL SELECT p_name || ' ' || CAST(p_size AS VARCHAR) || ': 30 and ' || p_type FROM part) u),
    split AS (SELECT line, trim(string_split(line, ': ')[1]) AS label, trim(substr(line, strpos(line, ': ') + 2)) AS value FROM lines),
    ok AS (SELECT *, NOT (regexp_matches(label, '(^|[^\d])\d{1,2}$') AND regexp_matches(value, '^\d{2}([^\d]|$)')) AND label <> '' AND value <> '' AND regexp_matches(label, '[A-Za-z]') AND len(string_split(label, ' ')) <= 7
      AND NOT regexp_matches(label, '[,;]$') AND NOT (regexp_matches(label, '\.$') AND length(string_split(label, ' ')[-1]) > 4) AS good FROM split)
    SELECT line, CASE WHEN good THEN label END AS label, CASE WHEN good THEN value END AS value FROM ok"""


@query("kv_lines_lenient", KV_SQL)
def kv_lines_lenient(spark, sf_dir):
    kv = t.parse_kv_line(F.col("line"), lenient=True)
    return kv_lines(spark, sf_dir).select("line", kv["label"].alias("label"), kv["value"].alias("value"))


KV_STRICT_SQL = (
    KV_SQL.replace("SELECT line, CASE WHEN good THEN label END AS label, CASE WHEN good THEN value END AS value FROM ok", "").rstrip().rstrip(",")
    + ", strings AS (SELECT label AS s FROM ok UNION SELECT value FROM ok)," + VOTES_SQL
    + r""", j AS (SELECT ok.*, NOT regexp_matches(value, '[a-z]{3,}[.?!]\s+[A-Z]') AND sqrt(1 / (1 + exp(-3 * l.v)) * (1 / (1 + exp(3 * CASE WHEN r.strong THEN r.v ELSE 0 END)))) > 0.5 AS strict FROM ok JOIN votes l ON l.s = ok.label JOIN votes r ON r.s = ok.value)
    SELECT line, CASE WHEN good AND strict THEN label END AS label, CASE WHEN good AND strict THEN value END AS value FROM j"""
)


@query("kv_lines_strict", KV_STRICT_SQL)
def kv_lines_strict(spark, sf_dir):
    return pairing.parse_kv_lines(kv_lines(spark, sf_dir), ["line"], "line")


@query(
    "line_classes",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT *, trim(line) AS s, length(line) * 7.0 AS width FROM l WHERE regexp_matches(line, '^[\x20-\x7e]*$')),
    g AS (SELECT *, len(list_filter(string_split(s, ' '), lambda w: w <> '')) AS n FROM f)
    SELECT CASE WHEN s <> '' AND n <= 8 AND width <= 1275 * 0.62 AND NOT regexp_matches(s, '[.,;]$') AND CASE WHEN ends_with(s, ':') THEN n <= 5 ELSE regexp_matches(s, '(?i)^(?:specimen\s+\d+|follow[- ]?up)') OR (regexp_matches(s, '^[A-Z0-9(]') AND regexp_matches(s, '[a-z]')) END THEN 'heading'
      WHEN width > 1275 * 0.5 AND regexp_matches(replace(s, ' ', ''), '^[-_=.]+$') THEN 'rule' ELSE 'text' END AS class, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1""",
)
def line_classes(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^[\x20-\x7e]*\z"))
    width, page = F.length("line") * 7.0, F.lit(1275.0)
    kind = F.when(t.looks_like_heading(F.col("line"), width, page), "heading").when(t.is_rule(F.col("line"), width, page), "rule").otherwise("text")
    return lines.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("token_budget", "SELECT CAST(p_size % 6 AS BIGINT) AS k, CAST(max(CASE p_size % 6 WHEN 0 THEN 2048 WHEN 1 THEN 512 WHEN 2 THEN 160 WHEN 3 THEN 160 WHEN 4 THEN 1024 ELSE 4096 END) AS BIGINT) AS cap, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def token_budget(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("table", "formula", "heading", "title", "text", "page")])
    return table(spark, sf_dir, "part").groupBy(long(F.col("p_size") % 6).alias("k")).agg(long(F.max(t.token_cap(F.get(names, F.col("p_size") % 6)))).alias("cap"), F.count(F.lit(1)).alias("n"))


@query("confidence_bands", "SELECT CASE WHEN l_discount * 10 < 0.5 THEN 'low' WHEN l_discount * 10 < 0.8 THEN 'caution' ELSE 'ok' END AS band, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(t.confidence_band(F.col("l_discount") * 10).alias("band")).agg(F.count(F.lit(1)).alias("n"))


#: 32-bit FNV-1a of a region's label and rounded box, character by character.
KEY_SQL = "lower(lpad(printf('%x', list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0'))"


@query("region_keys", "WITH l AS (SELECT p_partkey // 40 AS page_id, p_partkey AS line_id, 'text@' || concat_ws(',', (p_partkey * 37) % 900, (p_partkey * 53) % 1500, (p_partkey * 37) % 900 + 60 + p_partkey % 200, (p_partkey * 53) % 1500 + 12 + p_partkey % 9) AS s FROM part) SELECT page_id, line_id, " + KEY_SQL.format(text="s") + " AS region_key FROM l")
def region_keys(spark, sf_dir):
    return boxes(spark, sf_dir).select("page_id", "line_id", t.region_key(F.lit("text"), *[F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("region_key"))


# ---- statistics ----


@query(
    "line_statistics",
    """SELECT l_returnflag, round(median(l_quantity), 6) AS median, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(exp(avg(ln(greatest(l_discount, 1e-12)))), 6) AS geo_mean, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1""",
)
def line_statistics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(st.median(F.col("l_quantity"))).alias("median"), r6(st.quantile(F.col("l_extendedprice"), 0.1)).alias("p10"), r6(st.geo_mean(F.col("l_discount"))).alias("geo_mean"), r6(st.mean(F.col("l_tax"))).alias("mean"))


@query(
    "gap_clusters",
    """WITH e AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS x FROM events), d AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 86400 THEN 1 ELSE 0 END AS s FROM e),
    c AS (SELECT user_id, x, sum(s) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM d) SELECT user_id, CAST(k AS BIGINT) AS cluster, round(avg(x), 3) AS center, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1, 2""",
)
def gap_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").cast("double").alias("x"))
    return st.gap_clusters(rows, ["user_id"], "x", F.lit(86400.0)).select("user_id", long(F.col("cluster")).alias("cluster"), F.round("center", 3).alias("center"), "n")


@query(
    "mode_rounded",
    """WITH b AS (SELECT l_suppkey, floor(l_quantity / 5 + 0.5) * 5 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, bin AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, bin) AS k FROM b) x WHERE k = 1""",
)
def mode_rounded(spark, sf_dir):
    return st.mode_rounded(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 5.0).select("l_suppkey", F.col("mode").cast("double").alias("mode"))


@query("row_pitch", "WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS d FROM events) SELECT user_id, round(coalesce(median(d), 0), 6) AS pitch FROM d GROUP BY 1")
def row_pitch(spark, sf_dir):
    return st.row_pitch(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", r6(F.col("pitch")).alias("pitch"))


@query(
    "jump_split",
    """WITH g AS (SELECT user_id, event_id, greatest(value, 1e-9) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) AS k, lead(v) OVER (PARTITION BY user_id ORDER BY v, event_id) / v AS up FROM g),
    c AS (SELECT user_id, k AS cut, up AS margin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY up DESC, k) AS o FROM r WHERE up IS NOT NULL) x WHERE o = 1),
    s AS (SELECT r.user_id, margin, min(CASE WHEN k <= cut THEN v END) AS a, max(CASE WHEN k <= cut THEN v END) AS small_max, min(CASE WHEN k > cut THEN v END) AS big_min, max(CASE WHEN k > cut THEN v END) AS z FROM r JOIN c ON r.user_id = c.user_id GROUP BY 1, 2)
    SELECT user_id, round(margin, 6) AS margin, round(small_max, 6) AS small_max, round(big_min, 6) AS big_min FROM s WHERE margin >= 1.3 AND small_max / a <= margin AND z / big_min <= margin""",
)
def jump_split(spark, sf_dir):
    return st.jump_split(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id").select("user_id", *[r6(F.col(c)).alias(c) for c in ("margin", "small_max", "big_min")])


@query("nearest_centers", "SELECT CAST(CASE WHEN p_size <= 15 THEN 0 WHEN p_size <= 32 THEN 1 ELSE 2 END AS BIGINT) AS nearest, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def nearest_centers(spark, sf_dir):
    centers = F.array(F.lit(10), F.lit(20), F.lit(45))
    return table(spark, sf_dir, "part").groupBy(long(st.nearest_index(centers, F.col("p_size"))).alias("nearest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "plausibility",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS a, l_tax * 20 - 1 AS b FROM lineitem), q AS (SELECT *, sqrt(1 / (1 + exp(-3 * a)) * (1 / (1 + exp(3 * b)))) AS plaus FROM p)
    SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(avg(plaus), 6) AS plausibility, round(avg(least(1, greatest(0.01, cbrt(plaus * (1 - 1 / pow(greatest(1, 1 + abs(a)), 2)) * 0.5)))), 6) AS confidence FROM q GROUP BY 1""",
)
def plausibility(spark, sf_dir):
    a, b = F.col("l_discount") * 20 - 1, F.col("l_tax") * 20 - 1
    plaus = t.type_plausibility(a, b)
    return table(spark, sf_dir, "lineitem").groupBy(long(F.col("l_linenumber")).alias("l_linenumber")).agg(r6(F.avg(plaus)).alias("plausibility"), r6(F.avg(st.pair_confidence(plaus, st.map_margin(1 + F.abs(a)), F.lit(0.5)))).alias("confidence"))


@query(
    "line_uncertainty",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, least(1, abs(v)) AS p FROM e)
    SELECT vec_id, round(exp(avg(ln(greatest(p, 1e-12)))), 6) AS geo_mean, round(min(p), 6) AS least, round(quantile_cont(p, 0.1), 6) AS p10, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def line_uncertainty(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", F.least(F.lit(1.0), F.abs(F.col("v").cast("double"))).alias("p"))
    return c.groupBy("vec_id").agg(r6(st.geo_mean(F.col("p"))).alias("geo_mean"), r6(F.min("p")).alias("least"), r6(st.quantile(F.col("p"), 0.1)).alias("p10"), F.count(F.lit(1)).alias("n"))


# ---- tensors ----


@query(
    "ctc_greedy",
    """WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT vec_id, i // 8 AS step, i % 8 AS cls, v, row_number() OVER (PARTITION BY vec_id, i // 8 ORDER BY v DESC, i) AS k FROM e),
    b AS (SELECT vec_id, step, cls, v, lag(cls) OVER (PARTITION BY vec_id ORDER BY step) AS prev FROM s WHERE k = 1), kept AS (SELECT * FROM b WHERE cls <> 0 AND (prev IS NULL OR prev <> cls))
    SELECT x.vec_id, coalesce(string_agg(chr(CAST(96 + cls AS INTEGER)), '' ORDER BY step), '') AS text, round(coalesce(avg(v), 0), 6) AS conf FROM (SELECT vec_id FROM embeddings) x LEFT JOIN kept ON x.vec_id = kept.vec_id GROUP BY 1""",
)
def ctc_greedy(spark, sf_dir):
    """Eight steps of eight classes: the best class of each step, repeats and blanks (class 0) left out."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    best = F.transform(steps, lambda p: F.struct((F.array_position(p, F.array_max(p)) - 1).cast("int").alias("cls"), F.array_max(p).cast("double").alias("p")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", best.alias("best"))
    kept = F.filter(F.transform("best", lambda b, i: F.struct(b["cls"].alias("cls"), b["p"].alias("p"), F.when(i > 0, F.get(F.col("best"), i - 1)["cls"]).otherwise(-1).alias("prev"))), lambda b: (b["cls"] != 0) & (b["cls"] != b["prev"]))
    own = rows.select("vec_id", kept.alias("kept"))
    text = F.array_join(F.transform("kept", lambda b: F.substr(F.lit("abcdefg"), b["cls"], F.lit(1))), "")
    conf = F.aggregate("kept", F.lit(0.0), lambda a, b: a + b["p"]) / F.greatest(F.size("kept"), F.lit(1))
    return own.select("vec_id", text.alias("text"), r6(conf).alias("conf"))


@query(
    "order_votes",
    """WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), u AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, 1 / (1 + exp(-v)) AS p FROM e WHERE i // 8 < i % 8),
    w AS (SELECT vec_id, c AS q, p FROM u UNION ALL SELECT vec_id, r, 1 - p FROM u) SELECT vec_id, CAST(q AS BIGINT) AS region, round(sum(p), 6) AS votes FROM w GROUP BY 1, 2""",
)
def order_votes(spark, sf_dir):
    """Votes for a late place: each pair above the diagonal votes for one of its two regions."""
    pairs = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), st.sigma(F.col("v").cast("double"), 1.0).alias("p")).where("r < c")
    votes = pairs.select("vec_id", F.explode(F.array(F.struct(long(F.col("c")).alias("region"), F.col("p").alias("p")), F.struct(long(F.col("r")).alias("region"), (1 - F.col("p")).alias("p")))).alias("x"))
    return votes.groupBy("vec_id", F.col("x.region").alias("region")).agg(r6(F.sum("x.p")).alias("votes"))


# ---- boxes ----


def boxes(spark, sf_dir) -> DataFrame:
    """A text line for each part: 40 to a page."""
    k = F.col("p_partkey")
    x, y = (k * 37) % 900, (k * 53) % 1500
    return table(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("page_id"), k.alias("line_id"), g.box(x, y, x + 60 + k % 200, y + 12 + k % 9).alias("box"), ((k % 100) / 100.0).alias("conf"), F.col("p_name").alias("text"))


def regions(spark, sf_dir) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey") % 40
    x, y = (n % 3) * 300, F.floor(n / 3) * 250
    return table(spark, sf_dir, "part").where(n < 15).select(F.floor(k / 40).cast("long").alias("page_id"), long(n).alias("region_id"), g.box(x, y, x + 280 + n, y + 240 + n).alias("region_box"))


BOXES_SQL = """lines AS (SELECT p_partkey // 40 AS page_id, p_partkey AS line_id, ((p_partkey * 37) % 900)::DOUBLE AS x0, ((p_partkey * 53) % 1500)::DOUBLE AS y0, ((p_partkey * 37) % 900 + 60 + p_partkey % 200)::DOUBLE AS x1,
    ((p_partkey * 53) % 1500 + 12 + p_partkey % 9)::DOUBLE AS y1, (p_partkey % 100) / 100.0::DOUBLE AS conf, p_name AS text FROM part),
    regions AS (SELECT p_partkey // 40 AS page_id, p_partkey % 40 AS region_id, (((p_partkey % 40) % 3) * 300)::DOUBLE AS a0, (((p_partkey % 40) // 3) * 250)::DOUBLE AS b0, (((p_partkey % 40) % 3) * 300 + 280 + p_partkey % 40)::DOUBLE AS a1,
    (((p_partkey % 40) // 3) * 250 + 240 + p_partkey % 40)::DOUBLE AS b1 FROM part WHERE p_partkey % 40 < 15)"""
OVERLAP_SQL = "greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0))"


@query(
    "assign_regions",
    f"""WITH {BOXES_SQL}, p AS (SELECT l.*, r.*, round({OVERLAP_SQL} / ((x1 - x0) * (y1 - y0)), 9) AS share, (x0 + x1) / 2 BETWEEN a0 AND a1 AND (y0 + y1) / 2 BETWEEN b0 AND b1 AS inside FROM lines l JOIN regions r ON l.page_id = r.page_id),
    b AS (SELECT line_id, region_id, row_number() OVER (PARTITION BY line_id ORDER BY share DESC, (a1 - a0) * (b1 - b0), region_id) AS k FROM p WHERE share >= 0.5 OR inside)
    SELECT l.page_id, l.line_id, CAST(b.region_id AS BIGINT) AS region_id FROM lines l LEFT JOIN b ON l.line_id = b.line_id AND k = 1""",
)
def assign_regions(spark, sf_dir):
    return spatial.assign_regions(boxes(spark, sf_dir), regions(spark, sf_dir))


@query(
    "orphan_clusters",
    f"""WITH {BOXES_SQL}, d AS (SELECT *, max(y1) OVER (PARTITION BY page_id ORDER BY y0, x0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM lines)
    SELECT page_id, line_id, CAST(sum(CASE WHEN y0 - low > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y0, x0, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM d""",
)
def orphan_clusters(spark, sf_dir):
    return spatial.orphan_clusters(boxes(spark, sf_dir), F.lit(12.0)).withColumn("cluster", long(F.col("cluster")))


@query(
    "block_provenance",
    f"""WITH {BOXES_SQL} SELECT r.page_id, r.region_id AS block_id, CAST(count(line_id) AS BIGINT) AS n_lines, coalesce(sum(line_id), 0)::BIGINT AS id_sum, round(least(1, coalesce(min(conf), 1)), 6) AS worst
    FROM regions r LEFT JOIN lines l ON l.page_id = r.page_id AND {OVERLAP_SQL} >= 0.5 * (x1 - x0) * (y1 - y0) GROUP BY 1, 2""",
)
def block_provenance(spark, sf_dir):
    blocks = regions(spark, sf_dir).select("page_id", F.col("region_id").alias("block_id"), F.col("region_box").alias("block_box"))
    out = spatial.provenance(blocks, boxes(spark, sf_dir))
    return out.select("page_id", "block_id", long(F.size("line_ids")).alias("n_lines"), F.aggregate("line_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), r6(F.col("worst")).alias("worst"))


@query(
    "fill_table",
    f"""WITH {BOXES_SQL}, p AS (SELECT l.page_id, line_id, region_id, {OVERLAP_SQL} AS i, (x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) AS areas, abs(x0 - a0) + abs(y0 - b0) AS tl, abs(x1 - a1) + abs(y1 - b1) AS br FROM lines l JOIN regions r ON l.page_id = r.page_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY round(1 - i / (areas - i), 12), round(tl + br + least(tl, br), 9), region_id) AS k FROM p) SELECT page_id, line_id, CAST(region_id AS BIGINT) AS cell_id FROM k WHERE k = 1""",
)
def fill_table(spark, sf_dir):
    cells = regions(spark, sf_dir).select("page_id", F.col("region_id").alias("cell_id"), F.col("region_box").alias("cell_box"))
    return spatial.fill_table(boxes(spark, sf_dir), cells)


@query(
    "column_order",
    f"""WITH {BOXES_SQL}, w AS (SELECT page_id, line_id AS box_id, x0, y0, x1 - x0 > 240 AS wide FROM lines), b AS (SELECT *, sum(wide::INT) OVER (PARTITION BY page_id ORDER BY y0, box_id ROWS UNBOUNDED PRECEDING) AS band FROM w),
    s AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id, band, wide ORDER BY x0, box_id) > 240 / 0.7 * 0.12 THEN 1 ELSE 0 END AS s FROM b), c AS (SELECT *, sum(s) OVER (PARTITION BY page_id, band, wide ORDER BY x0, box_id ROWS UNBOUNDED PRECEDING) AS col FROM s)
    SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, wide DESC, col, y0, box_id) - 1 AS BIGINT) AS place FROM c""",
)
def column_order(spark, sf_dir):
    own = boxes(spark, sf_dir).withColumnRenamed("line_id", "box_id")
    return spatial.column_order(own, F.lit(240 / 0.7)).withColumn("place", long(F.col("place")))


@query(
    "truth_lines",
    f"""WITH {BOXES_SQL} SELECT l.page_id, line_id, string_agg(CAST(region_id AS VARCHAR), ' ' ORDER BY a0, region_id) AS truth_text FROM lines l JOIN regions r ON l.page_id = r.page_id
    AND {OVERLAP_SQL} >= 0.3 * least((x1 - x0) * (y1 - y0), (a1 - a0) * (b1 - b0)) GROUP BY 1, 2""",
)
def truth_lines(spark, sf_dir):
    truth = regions(spark, sf_dir).select("page_id", F.col("region_id").alias("truth_id"), F.col("region_box").alias("truth_box"), F.col("region_id").cast("string").alias("text"))
    return spatial.ground_truth_lines(boxes(spark, sf_dir).drop("text"), truth)


@query(
    "anchor_blocks",
    f"""WITH {BOXES_SQL} SELECT l.page_id, line_id AS mark_id, CAST(coalesce(max(CASE WHEN b0 <= y0 THEN region_id END), min(region_id)) AS BIGINT) AS block_id FROM lines l JOIN regions r ON l.page_id = r.page_id GROUP BY 1, 2""",
)
def anchor_blocks(spark, sf_dir):
    blocks = regions(spark, sf_dir).select("page_id", F.col("region_id").alias("block_id"), F.col("region_box").alias("block_box"))
    marks = boxes(spark, sf_dir).select("page_id", F.col("line_id").alias("mark_id"), F.col("box.y0").alias("mark_y"))
    return spatial.order_above(blocks, marks)


@query(
    "hover_blocks",
    f"""WITH {BOXES_SQL}, p AS (SELECT l.page_id, line_id AS point_id, region_id, row_number() OVER (PARTITION BY line_id ORDER BY (a1 - a0) * (b1 - b0), region_id) AS k FROM lines l JOIN regions r ON l.page_id = r.page_id AND x0 BETWEEN a0 AND a1 AND y0 BETWEEN b0 AND b1)
    SELECT page_id, point_id, CAST(region_id AS BIGINT) AS block_id FROM p WHERE k = 1""",
)
def hover_blocks(spark, sf_dir):
    blocks = regions(spark, sf_dir).select("page_id", F.col("region_id").alias("block_id"), F.col("region_box").alias("block_box"))
    return spatial.smallest_at(blocks, boxes(spark, sf_dir).select("page_id", F.col("line_id").alias("point_id"), F.col("box.x0").alias("x"), F.col("box.y0").alias("y")))


@query("asof_continuation", "WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), j AS (SELECT p.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS k FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts) SELECT event_id, view_id FROM j WHERE k = 1")
def asof_continuation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return spatial.backward_asof(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", "view_id").select("event_id", "view_id")


# ---- audit ----


def conversation_tokens(spark, sf_dir, role: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return tokens_of(own.select("conv_id", "text", F.col("turn").alias("block"), F.col("turn").alias("line"), F.lit(1.0).alias("conf")))


def tokens_of(rows: DataFrame) -> DataFrame:
    """A row for each word and number of text, with the other columns, kind and token."""
    typed = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))
    both = F.concat(typed("word", t.extract_words(F.col("text"))), typed("number", t.extract_numbers(F.col("text"))))
    kept = [c for c in rows.columns if c != "text"]
    return rows.select(*kept, F.explode(both).alias("__x")).select(*kept, "__x.kind", "__x.token")


VERIFY_SQL = r"""WITH w AS (SELECT conv_id, role, 'word' AS kind, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) AS token FROM conversations WHERE role IN ('user', 'assistant')
    UNION ALL SELECT conv_id, role, 'number', regexp_replace(unnest(regexp_extract_all(text, '\d[\d.,/:%-]*\d|\d')), '[.,/:%-]+$', '') FROM conversations WHERE role IN ('user', 'assistant')),
    d AS (SELECT conv_id, role, kind, token, count(*) AS n FROM w GROUP BY 1, 2, 3, 4),
    m AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM d b WHERE b.conv_id = a.conv_id AND b.kind = a.kind AND b.role <> a.role AND levenshtein(a.token, b.token) <= 1) AS missing FROM d a),
    c AS (SELECT conv_id, sum(CASE WHEN kind = 'word' AND role = 'assistant' THEN n ELSE 0 END) AS no, sum(CASE WHEN kind = 'word' AND role = 'assistant' AND missing THEN n ELSE 0 END) AS mo, sum(CASE WHEN kind = 'word' AND role = 'assistant' AND missing THEN 1 ELSE 0 END) AS fo,
      sum(CASE WHEN kind = 'word' AND role = 'user' THEN n ELSE 0 END) AS ni, sum(CASE WHEN kind = 'word' AND role = 'user' AND missing THEN n ELSE 0 END) AS mi, sum(CASE WHEN kind = 'word' AND role = 'user' AND missing THEN 1 ELSE 0 END) AS fi,
      sum(CASE WHEN kind = 'number' AND role = 'assistant' AND missing THEN 1 ELSE 0 END) AS gn, sum(CASE WHEN kind = 'number' AND role = 'user' AND missing THEN 1 ELSE 0 END) AS hn FROM m GROUP BY 1),
    r AS (SELECT x.conv_id, coalesce(fo, 0) AS fo, coalesce(fi, 0) AS fi, coalesce(gn, 0) AS gn, coalesce(hn, 0) AS hn, CASE WHEN coalesce(no, 0) > 0 THEN mo::DOUBLE / no ELSE 0 END AS fab, 1 - CASE WHEN coalesce(ni, 0) > 0 THEN mi::DOUBLE / ni ELSE 0 END AS rec FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON x.conv_id = c.conv_id)
    SELECT conv_id, CAST(gn AS BIGINT) AS fab_numbers, CAST(fo AS BIGINT) AS fab_words, CAST(hn AS BIGINT) AS omit_numbers, CAST(fi AS BIGINT) AS omit_words, round(fab, 6) AS word_fab_rate, round(rec, 6) AS word_recall, CASE WHEN gn > 0 OR hn > 0 THEN 'fallback' WHEN fab > 0.02 OR 1 - rec > 0.05 THEN 'review' ELSE 'pass' END AS verdict FROM r"""


@query("verify_conversations", VERIFY_SQL)
def verify_conversations(spark, sf_dir):
    """Which assistant words and numbers the user turns don't attest, what is left out, and the verdict, for each conversation."""
    told = audit.attested(conversation_tokens(spark, sf_dir, "assistant"), conversation_tokens(spark, sf_dir, "user"), "conv_id")
    out = audit.verify(told, table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id")
    return out.withColumn("word_fab_rate", r6(F.col("word_fab_rate"))).withColumn("word_recall", r6(F.col("word_recall")))


@query(
    "fuzzy_missing_tokens",
    """WITH b AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) AS token FROM benchmark), d AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) AS token FROM documents WHERE length(text) > 0)
    SELECT b.token FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.token = b.token) AND NOT EXISTS (SELECT 1 FROM d WHERE abs(length(d.token) - length(b.token)) <= 1 AND levenshtein(d.token, b.token) <= 1)""",
)
def fuzzy_missing_tokens(spark, sf_dir):
    words = lambda name: table(spark, sf_dir, name).select(F.explode(t.extract_words(F.col("text"))).alias("token")).distinct()
    return audit.missing_tokens(words("benchmark"), words("documents"), [])


@query(
    "match_numbers",
    r"""WITH e AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '\d[\d.,/:%-]*\d|\d')) AS token FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source, token ORDER BY doc_id) AS k FROM e WHERE doc_id % 2 = 0), b AS (SELECT source, token, row_number() OVER (PARTITION BY source, token ORDER BY doc_id) AS k FROM e WHERE doc_id % 2 = 1)
    SELECT a.source, CAST(count(*) AS BIGINT) AS n, CAST(count(b.k) AS BIGINT) AS matched FROM a LEFT JOIN b ON a.source = b.source AND a.token = b.token AND a.k = b.k GROUP BY 1""",
)
def match_numbers(spark, sf_dir):
    """Numbers of documents with even ids that an odd one of the same source has too, each taken once."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(t.NUMBER), F.lit(0))).alias("token"))
    out = audit.match_exact(own.where("doc_id % 2 = 0"), own.where("doc_id % 2 = 1"), ["source"], "doc_id", "doc_id")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), long(F.sum(F.col("matched").cast("int"))).alias("matched"))


@query(
    "text_disagreement",
    """SELECT s_suppkey, s_name, n_name, CASE WHEN greatest(length(s_name), length(n_name)) > 0 THEN 1 - levenshtein(s_name, n_name)::DOUBLE / greatest(length(s_name), length(n_name)) ELSE 1 END < 0.75 AS disagrees FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def text_disagreement(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select("s_suppkey", "s_name", "n_name", audit.disagreement(F.col("s_name"), F.col("n_name")).alias("disagrees"))


# ---- calibration ----


def scored(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.least(F.col("n_chars"), F.lit(20000)) / 20000.0).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.round("score", 3).alias("score"), (F.col("quality") == 1).alias("good"), F.col("doc_id").alias("ord"), "source")


SCORED_SQL = "scored AS (SELECT round(least(n_chars, 20000) / 20000.0, 3)::DOUBLE AS score, quality = 1 AS good, l.doc_id AS ord, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query("auroc", f"WITH {SCORED_SQL}, r AS (SELECT good, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored) SELECT round(CASE WHEN sum(good::INT) > 0 AND sum((NOT good)::INT) > 0 THEN (sum(CASE WHEN good THEN r END) - sum(good::INT) * (sum(good::INT) + 1) / 2.0) / (sum(good::INT)::DOUBLE * sum((NOT good)::INT)) ELSE 0.5 END, 6)::DOUBLE AS auroc FROM r")
def auroc(spark, sf_dir):
    return calibration.auroc(scored(spark, sf_dir)).select(r6(F.col("auroc")).alias("auroc"))


@query("auroc_by_source", f"WITH {SCORED_SQL}, r AS (SELECT source, good, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM scored) SELECT source, round(CASE WHEN sum(good::INT) > 0 AND sum((NOT good)::INT) > 0 THEN (sum(CASE WHEN good THEN r END) - sum(good::INT) * (sum(good::INT) + 1) / 2.0) / (sum(good::INT)::DOUBLE * sum((NOT good)::INT)) ELSE 0.5 END, 6)::DOUBLE AS auroc FROM r GROUP BY 1")
def auroc_by_source(spark, sf_dir):
    return calibration.auroc(scored(spark, sf_dir), ["source"]).select("source", r6(F.col("auroc")).alias("auroc"))


@query("auprc", f"WITH {SCORED_SQL}, c AS (SELECT (NOT good)::INT AS bad, sum((NOT good)::INT) OVER w AS tp, row_number() OVER w AS k FROM scored WINDOW w AS (ORDER BY score, ord ROWS UNBOUNDED PRECEDING)) SELECT round(coalesce(avg(CASE WHEN bad = 1 THEN tp::DOUBLE / k END), 1), 6) AS auprc FROM c")
def auprc(spark, sf_dir):
    return calibration.auprc(scored(spark, sf_dir)).select(r6(F.col("auprc")).alias("auprc"))


@query("reliability", f"WITH {SCORED_SQL}, b AS (SELECT greatest(0, least(9, floor(score * 10)))::BIGINT AS bin, count(*) AS n, avg(score) AS s, avg(good::INT) AS a FROM scored GROUP BY 1) SELECT CAST(i AS BIGINT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(s, 0), 6) AS mean_score, round(coalesce(a, 0), 6) AS mean_good FROM range(10) t(i) LEFT JOIN b ON i = bin")
def reliability(spark, sf_dir):
    return calibration.reliability(scored(spark, sf_dir)).select(long(F.col("bin")).alias("bin"), "n", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("mean_good")).alias("mean_good"))


@query("ece", f"WITH {SCORED_SQL}, b AS (SELECT greatest(0, least(9, floor(score * 10))) AS bin, count(*) AS n, avg(score) AS s, avg(good::INT) AS a FROM scored GROUP BY 1) SELECT round(sum(n * abs(s - a)) / greatest(sum(n), 1), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return calibration.ece(scored(spark, sf_dir)).select(r6(F.col("ece")).alias("ece"))


@query("brier", f"WITH {SCORED_SQL} SELECT round(avg(pow(score - good::INT, 2)), 6) AS brier FROM scored")
def brier(spark, sf_dir):
    return calibration.brier(scored(spark, sf_dir)).select(r6(F.col("brier")).alias("brier"))


BUDGET_SQL = f"WITH {SCORED_SQL}, c AS (SELECT sum((NOT good)::INT) OVER (ORDER BY score, ord ROWS UNBOUNDED PRECEDING) AS found, row_number() OVER (ORDER BY score, ord) AS place FROM scored), t AS (SELECT count(*) AS n, sum((NOT good)::INT) AS bad FROM scored), p AS (SELECT i AS step, i / 20.0::DOUBLE AS budget, CASE WHEN bad > 0 AND floor(i / 20.0::DOUBLE * n + 0.5) > 0 THEN coalesce(found, 0)::DOUBLE / bad ELSE 0 END AS caught FROM range(21) g(i) CROSS JOIN t LEFT JOIN c ON place = floor(i / 20.0::DOUBLE * n + 0.5)::BIGINT)"


@query("review_budget", BUDGET_SQL + " SELECT CAST(step AS BIGINT) AS step, round(budget, 6) AS budget, round(caught, 6) AS caught FROM p")
def review_budget(spark, sf_dir):
    return calibration.review_budget(scored(spark, sf_dir)).select(long(F.col("step")).alias("step"), r6(F.col("budget")).alias("budget"), r6(F.col("caught")).alias("caught"))


@query("budget_area", BUDGET_SQL + " SELECT round(sum(s), 6) AS auc FROM (SELECT (budget - lag(budget) OVER (ORDER BY step)) * (caught + lag(caught) OVER (ORDER BY step)) / 2 AS s FROM p) x")
def budget_area(spark, sf_dir):
    return calibration.budget_area(calibration.review_budget(scored(spark, sf_dir))).select(r6(F.col("auc")).alias("auc"))


#: Each score's isotonic value without folding: of the blocks that begin at or before it, the greatest of their least means over ends from it on.
ISOTONIC_SQL = f"""WITH {SCORED_SQL}, p AS (SELECT score, sum(good::INT)::DOUBLE AS y, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY score) AS i FROM scored GROUP BY score), c AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM p),
    m AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.i <= b.i), t AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m),
    v AS (SELECT b AS i, round(max(low), 9) AS y FROM t GROUP BY 1), g AS (SELECT v.y AS y, min(score) AS x0, max(score) AS x1 FROM v JOIN c ON v.i = c.i GROUP BY 1)
    SELECT round(y, 6) AS y, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM g"""


@query("isotonic_fit", ISOTONIC_SQL)
def isotonic_fit(spark, sf_dir):
    """The map's levels, each with the scores that it spans."""
    points = calibration.fit_isotonic(scored(spark, sf_dir)).groupBy(F.round("y", 9).alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return points.select(r6(F.col("y")).alias("y"), r6(F.col("x0")).alias("x0"), r6(F.col("x1")).alias("x1"))


@query("isotonic_apply", "SELECT CAST(p_size AS BIGINT) AS p_size, round(max(CASE WHEN p_size <= 10 THEN 0.1 WHEN p_size < 30 THEN 0.1 + 0.5 * (p_size - 10) / 20.0 WHEN p_size < 40 THEN 0.6 + 0.3 * (p_size - 30) / 10.0 ELSE 0.9 END::DOUBLE), 6) AS y FROM part GROUP BY 1")
def isotonic_apply(spark, sf_dir):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 0.1), (30.0, 0.6), (40.0, 0.9))])
    return table(spark, sf_dir, "part").select("p_size").distinct().select(long(F.col("p_size")).alias("p_size"), r6(calibration.apply_isotonic(F.col("p_size").cast("double"), points)).alias("y"))


@query("bootstrap_interval", f"WITH {SCORED_SQL}, g AS (SELECT row_number() OVER (ORDER BY source) - 1 AS grp, sum(good::INT)::DOUBLE AS value, count(*)::DOUBLE AS weight FROM scored GROUP BY source), k AS (SELECT count(*) AS n FROM g), d AS (SELECT b AS replicate, ((b * 7919 + i * 104729 + b * i * 31) % n) AS grp FROM range(200) x(b) CROSS JOIN k CROSS JOIN LATERAL (SELECT unnest(range(n)) AS i) y), s AS (SELECT replicate, sum(value) / sum(weight) AS stat FROM d JOIN g ON d.grp = g.grp GROUP BY 1), o AS (SELECT stat, row_number() OVER (ORDER BY stat) - 1 AS k FROM s) SELECT round(max(CASE WHEN k = 5 THEN stat END), 6) AS lo, round(max(CASE WHEN k = 194 THEN stat END), 6) AS hi FROM o")
def bootstrap_interval(spark, sf_dir):
    """Sources are resampled 200 times; the draws come from whole-number arithmetic, so any engine draws alike. Sources are few."""
    by = scored(spark, sf_dir).groupBy("source").agg(F.sum(F.col("good").cast("double")).alias("value"), F.count(F.lit(1)).cast("double").alias("weight"))
    groups = by.withColumn("grp", long(F.row_number().over(Window.orderBy("source")) - 1)).select("grp", "value", "weight")
    n = groups.count()
    b, i = F.floor(F.col("id") / n), F.col("id") % n
    draws = spark.range(200 * n).select(b.alias("replicate"), F.pmod(b * 7919 + i * 104729 + b * i * 31, F.lit(n)).alias("grp"))
    return calibration.bootstrap_mean(groups, draws).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query("ship_gate", "SELECT CAST(p_size AS BIGINT) AS p_size, concat_ws(', ', CASE WHEN p_size * 5 < 100 THEN 'few errors' END, CASE WHEN p_size / 50.0 < 0.65 THEN 'low auroc' END, CASE WHEN p_size / 60.0 <= 0.5 THEN 'low interval' END, CASE WHEN p_size / 500.0 > 0.05 THEN 'high error of calibration' END, CASE WHEN p_size / 500.0 > 0.04 + 1e-9 THEN 'calibration does not help' END, CASE WHEN p_size / 50.0 < 0.5 THEN 'transfer collapsed' END) AS reasons, p_size * 5 >= 100 AND p_size / 50.0 >= 0.65 AND p_size / 60.0 > 0.5 AND p_size / 500.0 <= 0.04 + 1e-9 AS ship FROM (SELECT DISTINCT p_size FROM part) x")
def ship_gate(spark, sf_dir):
    p = F.col("p_size")
    m = table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", (p * 5).alias("n_errors"), (p / 50.0).alias("auroc"), (p / 60.0).alias("ci_low"), F.lit(0.04).alias("ece_raw"), (p / 500.0).alias("ece_cal"), (p / 50.0).alias("transfer"))
    return calibration.gate(m).select(long(p).alias("p_size"), F.array_join("reasons", ", ").alias("reasons"), "ship")


# ---- evaluation ----


def fixtures(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    q, x = F.col("quality").cast("long"), F.col("toxic").cast("long")
    one = F.lit(1).cast("long")
    return d.select(F.col("source").alias("family"), one.alias("gt_pairs"), q.alias("tp"), x.alias("fp"), (q + x).alias("emitted"), (x * 0).alias("mispaired"), ((1 - q) * (F.col("doc_id") % 2)).alias("in_table"), (x * 0).alias("in_list"), ((1 - q) * (1 - F.col("doc_id") % 2)).alias("unpaired"), (x * 0).alias("ocr_miss"), (F.col("doc_id") % 3 % 2).alias("critical_total"), (F.col("doc_id") % 3 % 2 * q).alias("critical_found"))


FIXTURES_SQL = "f AS (SELECT source AS family, count(*) AS gt, sum(quality) AS tp, sum(toxic) AS fp, sum((1 - quality) * (l.doc_id % 2)) AS it, sum(l.doc_id % 3 % 2) AS ct, sum(l.doc_id % 3 % 2 * quality) AS cf FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1)"
RATES_SQL = """r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END AS p, CASE WHEN gt > 0 THEN tp::DOUBLE / gt ELSE 1 END AS rc FROM {src})
    SELECT family, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, round(CASE WHEN gt > 0 THEN (tp + it)::DOUBLE / gt ELSE 1 END, 6) AS binding_recall, round(CASE WHEN ct > 0 THEN cf::DOUBLE / ct ELSE 1 END, 6) AS critical_recall FROM r"""
RATES = ("precision", "recall", "f1", "binding_recall", "critical_recall")


@query("pairing_rates", f"WITH {FIXTURES_SQL}, " + RATES_SQL.format(src="f"))
def pairing_rates(spark, sf_dir):
    return evaluation.with_rates(evaluation.summed(fixtures(spark, sf_dir), ["family"])).select("family", *[r6(F.col(c)).alias(c) for c in RATES])


@query("leave_one_family_out", f"WITH {FIXTURES_SQL}, o AS (SELECT family, sum(gt) OVER () - gt AS gt, sum(tp) OVER () - tp AS tp, sum(fp) OVER () - fp AS fp, sum(it) OVER () - it AS it, sum(ct) OVER () - ct AS ct, sum(cf) OVER () - cf AS cf FROM f), " + RATES_SQL.format(src="o"))
def leave_one_family_out(spark, sf_dir):
    return evaluation.leave_one_family_out(fixtures(spark, sf_dir)).select("family", *[r6(F.col(c)).alias(c) for c in RATES])


@query("markdown_pairs", "SELECT c_custkey, 'Name' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment FROM customer")
def markdown_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    md = F.concat(F.lit("# Customer\n\n**Name:** "), F.col("c_name"), F.lit("\n**Segment:** "), F.col("c_mktsegment"), F.lit("\n**Heading only:**\nReported by: nobody\n"))
    return evaluation.kv_pairs(c.select("c_custkey", md.alias("md"))).select("c_custkey", "label", "value")


@query("neutral_pairs", "SELECT c_custkey, unnest(['Lead', 'Cell', 'Reported by']) AS label, unnest([c_name, c_mktsegment, 'nobody']) AS value FROM customer")
def neutral_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    md = F.concat(F.lit("- **Lead:** "), F.col("c_name"), F.lit("\n| Cell | "), F.col("c_mktsegment"), F.lit(" |\n| --- | --- |\nReported by: nobody\n**Bold:** no"))
    return evaluation.neutral_pairs(c.select("c_custkey", md.alias("md"))).select("c_custkey", "label", "value")


LABELS_SQL = r"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON a.p_partkey // 30 = b.p_partkey // 30), s AS (SELECT *, list_filter(list_transform(string_split_regex(x, '\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '') AS u,
      list_filter(list_transform(string_split_regex(y || 's', '\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '') AS v FROM p)
    SELECT a, b, len(u) > 0 AND len(u) = len(v) AND len(list_filter(list_zip(u, v), lambda z: CASE WHEN least(length(z[1]), length(z[2])) <= 2 THEN z[1] <> z[2] ELSE levenshtein(z[1], z[2]) > 1 END)) = 0 AS same FROM s"""


@query("label_matches", LABELS_SQL)
def label_matches(spark, sf_dir):
    """Part names against those of their neighbours with a letter more."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), F.floor(F.col("p_partkey") / 30).alias("k"))
    return own.join(own.select(F.col("a").alias("b"), F.col("x").alias("y"), "k"), "k").select("a", "b", evaluation.labels_match(F.col("x"), F.concat(F.upper("y"), F.lit("S :"))).alias("same"))


# ---- review ----


def event_log(spark, sf_dir) -> DataFrame:
    kinds = F.when(F.col("event_type") == "view", "text-edit").when(F.col("event_type") == "click", "dismiss").when(F.col("event_type") == "error", "block-remove").when(F.col("event_type") == "purchase", "region-add").otherwise("note")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), (F.col("event_id") % 7).cast("string").alias("uid"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("markdown"))


def with_anchors(log: DataFrame, anchor: Column) -> DataFrame:
    """The log with additions under names of their own (+seq), after the block that anchor names."""
    adds = F.col("kind") == "region-add"
    return log.withColumn("after_uid", F.when(adds, anchor)).withColumn("uid", F.when(adds, F.concat(F.lit("+"), F.col("seq").cast("string"))).otherwise(F.col("uid")))


@query("dismissed", "SELECT DISTINCT user_id AS page_id, CAST(event_id % 7 AS VARCHAR) AS item_id FROM events WHERE event_type = 'click'")
def dismissed(spark, sf_dir):
    return review.dismissed_ids(event_log(spark, sf_dir))


REPLAY_SQL = """WITH b AS (SELECT DISTINCT user_id AS page_id, CAST(i AS VARCHAR) AS uid, i::DOUBLE AS place, -1 AS seq, 'base ' || CAST(i AS VARCHAR) AS md FROM events, range(7) t(i)),
    a AS (SELECT user_id AS page_id, '+' || CAST(event_id AS VARCHAR) AS uid, (event_id % 7)::DOUBLE AS place, event_id AS seq, 'text ' || CAST(event_id AS VARCHAR) AS md FROM events WHERE event_type = 'purchase'), e AS (SELECT * FROM b UNION ALL SELECT * FROM a),
    t AS (SELECT user_id AS page_id, CAST(event_id % 7 AS VARCHAR) AS uid, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY 1, 2), g AS (SELECT DISTINCT user_id AS page_id, CAST(event_id % 7 AS VARCHAR) AS uid FROM events WHERE event_type = 'error')
    SELECT e.page_id, e.uid, CAST(row_number() OVER (PARTITION BY e.page_id ORDER BY place, CASE WHEN seq < 0 THEN 0 ELSE 1 END, seq DESC) - 1 AS BIGINT) AS place, CASE WHEN last IS NOT NULL THEN 'text ' || CAST(last AS VARCHAR) ELSE md END AS markdown
    FROM e LEFT JOIN t ON e.page_id = t.page_id AND e.uid = t.uid WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = e.page_id AND g.uid = e.uid)"""


@query("corrections_replay", REPLAY_SQL)
def corrections_replay(spark, sf_dir):
    log = event_log(spark, sf_dir)
    ids = F.explode(F.sequence(F.lit(0), F.lit(6)))
    blocks = log.select("page_id").distinct().select("page_id", ids.alias("place")).select("page_id", F.col("place").cast("string").alias("uid"), "place", F.concat(F.lit("base "), F.col("place").cast("string")).alias("markdown"))
    return review.replay(blocks, with_anchors(log, F.col("uid"))).withColumn("place", long(F.col("place")))


@query(
    "corrections_chained",
    """WITH RECURSIVE pages AS (SELECT DISTINCT user_id AS page_id FROM events), v AS (SELECT user_id AS page_id, event_id AS seq, event_type AS kind, lag(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
    a AS (SELECT page_id, seq, '+' || CAST(seq AS VARCHAR) AS uid, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(seq % 7 AS VARCHAR) WHEN 2 THEN coalesce('+' || CAST(prev AS VARCHAR), 'nowhere') ELSE 'nowhere' END AS after_uid FROM v WHERE kind = 'purchase'),
    tree AS (SELECT page_id, CAST(i AS VARCHAR) AS uid, [1, i::BIGINT] AS path, -1::BIGINT AS seq FROM pages, range(7) t(i)
      UNION ALL SELECT page_id, uid, CASE WHEN after_uid IS NULL THEN [0, -seq] ELSE [2, seq] END, seq FROM a WHERE after_uid IS NULL OR after_uid = 'nowhere'
      UNION ALL SELECT a.page_id, a.uid, list_append(t.path, -a.seq), a.seq FROM tree t JOIN a ON a.page_id = t.page_id AND a.after_uid = t.uid),
    e AS (SELECT page_id, CAST(seq % 7 AS VARCHAR) AS uid, max(seq) AS last FROM v WHERE kind = 'view' GROUP BY 1, 2), g AS (SELECT DISTINCT page_id, CAST(seq % 7 AS VARCHAR) AS uid FROM v WHERE kind = 'error')
    SELECT t.page_id, t.uid, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY path) - 1 AS BIGINT) AS place, CASE WHEN last IS NOT NULL THEN 'text ' || CAST(last AS VARCHAR) WHEN t.seq < 0 THEN 'base ' || t.uid ELSE 'text ' || CAST(t.seq AS VARCHAR) END AS markdown
    FROM tree t LEFT JOIN e ON e.page_id = t.page_id AND e.uid = t.uid WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = t.page_id AND g.uid = t.uid)""",
)
def corrections_chained(spark, sf_dir):
    """Additions at the top, after blocks, after the addition before, and after names that nothing has."""
    log = event_log(spark, sf_dir)
    before = F.last(F.when(F.col("kind") == "region-add", F.col("seq")), True).over(Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    chained = F.coalesce(F.concat(F.lit("+"), F.col("before").cast("string")), F.lit("nowhere"))
    turn = F.col("seq") % 4
    named = F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, F.col("uid")).when(turn == 2, chained).otherwise("nowhere")
    places = F.explode(F.sequence(F.lit(0), F.lit(6)))
    blocks = log.select("page_id").distinct().select("page_id", places.alias("place")).select("page_id", F.col("place").cast("string").alias("uid"), "place", F.concat(F.lit("base "), F.col("place").cast("string")).alias("markdown"))
    return review.replay(blocks, with_anchors(log.withColumn("before", before), named)).withColumn("place", long(F.col("place")))


@query(
    "attention_worklist",
    """WITH i AS (SELECT user_id AS page_id, CAST(event_id AS VARCHAR) AS item_id, CASE event_type WHEN 'error' THEN 'fabricated-number' WHEN 'purchase' THEN 'uncertain-pair' WHEN 'view' THEN 'advisory-word' END AS category, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 4 WHEN 'view' THEN 3 END AS rank,
      CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS source, round(value / (value + 50), 4) AS score, event_id AS ord FROM events WHERE event_type IN ('error', 'purchase', 'view')),
    k AS (SELECT * FROM i WHERE (category <> 'uncertain-pair' OR score < 0.5) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'click' AND e.user_id = i.page_id AND CAST(e.event_id + 1 AS VARCHAR) = i.item_id))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank, score, source, ord, item_id) AS BIGINT) AS place, item_id, category, score FROM k""",
)
def attention_worklist(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = e.select("event_type", F.col("user_id").alias("page_id"), F.col("event_id").cast("string").alias("item_id"), F.round(F.col("value") / (F.col("value") + 50), 4).alias("score"), F.col("event_id").alias("ord"))
    sources = [base.where(F.col("event_type") == k).drop("event_type").withColumn("category", F.lit(c)) for k, c in (("error", "fabricated-number"), ("purchase", "uncertain-pair"), ("view", "advisory-word"))]
    gone = e.where("event_type = 'click'").select(F.col("user_id").alias("page_id"), (F.col("event_id") + 1).cast("string").alias("item_id"))
    return review.worklist(sources, gone).select("page_id", long(F.col("place")).alias("place"), "item_id", "category", "score")


@query("status_rollup", "WITH p AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1) SELECT CASE WHEN n > 0 THEN 'needs-review' ELSE 'done' END AS status, CAST(count(*) AS BIGINT) AS pages FROM p GROUP BY 1")
def status_rollup(spark, sf_dir):
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return pages.groupBy(review.page_status(F.col("n")).alias("status")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "render_markdown",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'kv' WHEN o_orderkey % 3 = 1 THEN 'listItem' ELSE 'paragraph' END AS kind FROM orders),
    f AS (SELECT *, CASE kind WHEN 'kv' THEN '**Order:** ' || CAST(o_orderkey AS VARCHAR) WHEN 'listItem' THEN '- **Status:** ' || o_orderstatus ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) END AS frag, lag(kind) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM b)
    SELECT o_custkey, string_agg(CASE WHEN prev IS NULL THEN '' WHEN prev = kind AND kind IN ('listItem', 'kv') THEN chr(10) ELSE chr(10) || chr(10) END || frag, '' ORDER BY o_orderkey) || chr(10) AS markdown FROM f GROUP BY 1""",
)
def render_markdown(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "kv").when(F.col("o_orderkey") % 3 == 1, "listItem").otherwise("paragraph")
    text = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).otherwise(F.concat(F.lit("Order "), key))
    blocks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("kind"), review.fragment(kind, F.lit(2), text, F.lit("Status"), F.lit("Order"), key).alias("fragment"))
    return review.render(blocks, ["o_custkey"], "o_orderkey")


@query("gfm_tables", "SELECT r_regionkey, '| Nation | Key |' || chr(10) || '| --- | --- |' || coalesce(string_agg(chr(10) || '| ' || n_name || ' | ' || CAST(n_nationkey AS VARCHAR) || ' |', '' ORDER BY n_nationkey), '') AS gfm FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def gfm_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("Nation"), F.lit("Key"))), F.transform(F.coalesce("x", F.array().cast("array<struct<n_nationkey:int,n_name:string>>")), lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string"))))
    return table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", review.grid_to_gfm(cells).alias("gfm"))


for more in (kernel_queries, page_queries):
    QUERIES.update(more.QUERIES)
    ORACLE_SQL.update(more.ORACLE_SQL)
