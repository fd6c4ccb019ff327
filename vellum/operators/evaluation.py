"""Pairing evaluation: label-value pairs from Markdown, matchers, rates and leave-one-family-out sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as t

# Lines that hold a pair, and the counts of an evaluation.
BOLD_PAIR = r"^\*\*([^*]+?):\*\*\s+(\S.*)$"
BULLET_PAIR, TABLE_PAIR, PLAIN_PAIR = r"^-\s+\*\*([^*]+?):\*\*\s+(\S.*)$", r"^\|([^|]+)\|([^|]+)\|$", r"^([A-Za-z][^:*|]{0,60}?):\s+(\S.*)$"
COUNTS = ("gt_pairs", "tp", "fp", "emitted", "mispaired", "in_table", "in_list", "unpaired", "ocr_miss", "critical_total", "critical_found")


def lines_of(df: DataFrame, md: str) -> DataFrame:
    return df.select("*", F.posexplode(F.split(md, "\n")).alias("line_no", "__raw")).withColumn("line", t.trimmed(F.col("__raw"))).drop("__raw")


def kv_pairs(df: DataFrame, md: str = "md") -> DataFrame:
    """Rows (…, line_no, label, value) of bold label lines with a value on the line."""
    rows = lines_of(df, md).where(F.col("line").rlike(BOLD_PAIR))
    return rows.select(*[c for c in rows.columns if c not in (md, "line")], t.trimmed(F.regexp_extract("line", BOLD_PAIR, 1)).alias("label"), t.trimmed(F.regexp_extract("line", BOLD_PAIR, 2)).alias("value"))


def neutral_pairs(df: DataFrame, md: str = "md") -> DataFrame:
    """Rows (…, line_no, label, value) that neither count for nor against: bullet leads, two-cell table rows, plain label lines."""
    line = F.col("line")
    kind = F.when(line.rlike(BULLET_PAIR), 1).when(line.rlike(TABLE_PAIR) & ~F.regexp_extract(line, TABLE_PAIR, 1).rlike(r"^\s*:?-{3,}"), 2).when(line.rlike(PLAIN_PAIR) & (F.size(t.words_of(F.regexp_extract(line, PLAIN_PAIR, 1))) <= 7), 3)
    rows = lines_of(df, md).withColumn("__kind", kind).where("__kind is not null")

    def part(i: int) -> Column:
        return t.trimmed(F.when(F.col("__kind") == 1, F.regexp_extract(line, BULLET_PAIR, i)).when(F.col("__kind") == 2, F.regexp_extract(line, TABLE_PAIR, i)).otherwise(F.regexp_extract(line, PLAIN_PAIR, i)))

    return rows.select(*[c for c in rows.columns if c not in (md, "line", "__kind")], part(1).alias("label"), part(2).alias("value"))


def tokens(c: Column, kind: str = "text") -> Column:
    parts = F.transform(t.words_of(c), lambda w: F.regexp_replace(F.lower(w) if kind in ("text", "name") else t.normalize_field(w, kind, False), "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(parts, lambda w: w != "")


def tokens_match(a: Column, b: Column) -> Column:
    """Equal numbers of tokens, each within one edit; tokens of up to two characters must be equal."""
    near = F.zip_with(a, b, lambda x, y: F.when((F.length(x) <= 2) | (F.length(y) <= 2), x == y).otherwise(F.levenshtein(x, y, 1) >= 0))
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def labels_match(a: Column, b: Column) -> Column:
    bare = lambda c: F.regexp_replace(t.trimmed(c), r"[:.]\s*$", "")
    return tokens_match(tokens(bare(a)), tokens(bare(b)))


def values_match(a: Column, b: Column, kind: str = "text") -> Column:
    return (t.normalize_field(a, kind, False) == t.normalize_field(b, kind, False)) | tokens_match(tokens(a, kind), tokens(b, kind))


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b).otherwise(1)).otherwise(empty)


def with_rates(df: DataFrame) -> DataFrame:
    """Counts with precision, recall, f1, binding_recall and critical_recall."""
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("gt_pairs")))
    both = F.col("precision") + F.col("recall")
    return df.withColumns({
        "f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0),
        "binding_recall": ratio(F.col("tp") + F.col("in_table") + F.col("in_list"), F.col("gt_pairs")),
        "critical_recall": ratio(F.col("critical_found"), F.col("critical_total")),
    })


def summed(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])


def leave_one_family_out(df: DataFrame) -> DataFrame:
    """(family, counts, rates) of all fixtures but the family's: sums are additive, so nothing is scanned again. Families are few."""
    by = summed(df, ["family"])
    rest = by.select("family", *[(F.sum(c).over(Window.partitionBy()) - F.col(c)).alias(c) for c in COUNTS])
    return with_rates(rest)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(page_id, role, ord, label, value): the pairs that blocks(page_id, block_id, kind, text, label, value, cells) bind, as roles of
    scoring.score_pages: label lines are predicted, leads of list items are leads, rows of two filled cells of two-column tables are rows."""
    full = lambda *cs: F.forall(F.array(*cs), lambda c: t.trimmed(F.coalesce(c, F.lit(""))) != "")
    pairs = blocks.where((F.col("kind") == "kv") & full("label", "value")).select("page_id", F.lit("predicted").alias("role"), F.col("block_id").cast("long").alias("ord"), "label", "value")
    leads = blocks.where((F.col("kind") == "listItem") & full("label", "text")).select("page_id", F.lit("leads").alias("role"), F.col("block_id").cast("long").alias("ord"), "label", F.col("text").alias("value"))
    rows = blocks.where(F.col("kind") == "table").select("page_id", F.col("block_id").cast("long").alias("ord"), F.explode("cells").alias("r"))
    rows = rows.where((F.size("r") == 2) & full(F.get("r", F.lit(0)), F.get("r", F.lit(1)))).select("page_id", F.lit("rows").alias("role"), "ord", F.get("r", F.lit(0)).alias("label"), F.get("r", F.lit(1)).alias("value"))
    return pairs.unionByName(leads).unionByName(rows)
