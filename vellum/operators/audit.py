"""Audit of an output against its source: fuzzy anti-joins of tokens, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lowest confidence of lines whose tokens must not be lost, and the limits of the verdict.
LEAST_CONF, MOST_FAB_NUMBERS, MOST_OMITTED, REVIEW_FAB, REVIEW_OMIT, DISAGREE = 0.5, 0, 0, 0.02, 0.05, 0.75


def deletions(token: Column) -> Column:
    """A token and all that remains of it when one character goes: tokens within one edit of each other share one of these."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1)))
    return F.array_distinct(F.array_append(shorter, token))


def missing_tokens(tokens: DataFrame, pool: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """The distinct rows (keys, token) of tokens that aren't within one edit of any token of the pool with the same keys.

    Both sides are made distinct and meet on shared deletions, an equality join; one Levenshtein distance verifies each meeting.
    """
    own = tokens.select(*keys, token).distinct()
    have = pool.select(*keys, F.col(token).alias("__pool")).distinct()
    exact = own.join(have.withColumnRenamed("__pool", token), [*keys, token], "left_anti")
    left = exact.select(*keys, token, F.explode(deletions(F.col(token))).alias("__sig"))
    right = have.select(*keys, "__pool", F.explode(deletions(F.col("__pool"))).alias("__sig"))
    near = left.join(right, [*keys, "__sig"]).where(F.levenshtein(token, "__pool", 1) >= 0).select(*keys, token).distinct()
    return exact.join(near, [*keys, token], "left_anti")


def attested(out: DataFrame, source: DataFrame, key: str, surfaced: DataFrame | None = None) -> DataFrame:
    """(key, kind, token, n_out, n_sure, block, lines, invented, omitted): a row for each distinct token of a key, on either side.

    out(key, kind, token, block), source(key, kind, token, line, conf); kind is word or number. All of the source attests an output token,
    only its tokens of confidence LEAST_CONF or more must appear; within one edit counts. block is the first that has the token, lines those
    of sure source tokens. Tokens of surfaced(key, token) don't count as invented numbers: they are reported elsewhere. One aggregate and one
    join on shared deletions serve both directions.
    """
    sure = F.col("conf") >= LEAST_CONF
    none = lambda kind: F.lit(None).cast(kind)
    left = out.select(key, "kind", "token", F.lit(1).alias("o"), F.lit(0).alias("s"), F.lit(0).alias("u"), F.col("block").cast("long").alias("block"), none("long").alias("line"))
    right = source.select(key, "kind", "token", F.lit(0).alias("o"), F.lit(1).alias("s"), sure.cast("int").alias("u"), none("long").alias("block"), F.when(sure, F.col("line")).cast("long").alias("line"))
    sums = [F.sum("o").alias("n_out"), F.sum("s").alias("n_src"), F.sum("u").alias("n_sure"), F.min("block").alias("block"), F.array_sort(F.collect_list("line")).alias("lines")]
    base = left.union(right).groupBy(key, "kind", "token").agg(*sums)
    lost = (F.col("n_src") == 0) | (F.col("n_out") == 0) & (F.col("n_sure") > 0)
    open_ones = base.where(lost).select(key, "kind", "token", (F.col("n_src") == 0).alias("from_out"), F.explode(deletions(F.col("token"))).alias("__sig"))
    pool = base.select(key, "kind", F.col("token").alias("__pool"), "n_out", "n_src", F.explode(deletions(F.col("token"))).alias("__sig"))
    meets = F.when(F.col("from_out"), F.col("n_src") > 0).otherwise(F.col("n_out") > 0) & (F.levenshtein("token", "__pool", 1) >= 0)
    near = open_ones.join(pool, [key, "kind", "__sig"]).where(meets).select(key, "kind", "token").distinct().withColumn("__near", F.lit(True))
    told = base.join(near, [key, "kind", "token"], "left")
    alone = lost & F.col("__near").isNull()
    invented = alone & (F.col("n_src") == 0)
    if surfaced is not None:
        told = told.join(surfaced.select(key, "token").distinct().withColumn("__known", F.lit(True)), [key, "token"], "left")
        invented = invented & ~((F.col("kind") == "number") & F.coalesce("__known", F.lit(False)))
    return told.select(key, "kind", "token", "n_out", "n_sure", "block", "lines", invented.alias("invented"), (alone & (F.col("n_src") > 0)).alias("omitted"))


def flags(told: DataFrame, key: str) -> DataFrame:
    """(key, side, kind, token, block, lines) of `attested`: output tokens that nothing attests, with the first block that has them, and sure
    source tokens that were left out, with their lines."""
    rows = told.where("invented OR omitted")
    return rows.select(key, F.when(F.col("invented"), "fabrication").otherwise("omission").alias("side"), "kind", "token", F.when(F.col("invented"), F.col("block")).otherwise(-1).alias("block"), F.when(F.col("omitted"), F.col("lines")).otherwise(F.array().cast("array<bigint>")).alias("lines"))


def verdict(fab_numbers: Column, omitted_numbers: Column, word_fab_rate: Column, word_recall: Column) -> Column:
    return F.when((fab_numbers > MOST_FAB_NUMBERS) | (omitted_numbers > MOST_OMITTED), "fallback").when((word_fab_rate > REVIEW_FAB) | (1 - word_recall > REVIEW_OMIT), "review").otherwise("pass")


def verify(told: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """One row for each key of groups: how many distinct tokens are invented or omitted, the rates of words, and the verdict; told: see
    `attested`. Keys without tokens pass."""
    of = lambda kind, flag: F.col(flag) & (F.col("kind") == kind)
    count = lambda kind, flag: F.count_if(of(kind, flag))
    total = lambda name, flag=None: F.sum(F.when((F.col("kind") == "word") & (F.col(flag) if flag else F.lit(True)), F.col(name)).otherwise(0))
    sums = told.groupBy(key).agg(
        count("number", "invented").alias("fab_numbers"), count("word", "invented").alias("fab_words"), count("number", "omitted").alias("omit_numbers"), count("word", "omitted").alias("omit_words"),
        total("n_out", "invented").alias("bad"), total("n_out").alias("all_out"), total("n_sure", "omitted").alias("lost"), total("n_sure").alias("all_sure"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rate = lambda a, b: F.when(zero(b) > 0, zero(a) / zero(b)).otherwise(F.lit(0.0))
    named = [zero(c).alias(c) for c in ("fab_numbers", "fab_words", "omit_numbers", "omit_words")]
    out = groups.join(sums, key, "left").select(key, *named, rate("bad", "all_out").alias("word_fab_rate"), (1 - rate("lost", "all_sure")).alias("word_recall"))
    return out.withColumn("verdict", verdict(F.col("fab_numbers"), F.col("omit_numbers"), F.col("word_fab_rate"), F.col("word_recall")))


def summary(fab_numbers: Column, omit_numbers: Column, fab_words: Column, omit_words: Column, result: Column) -> Column:
    """One line on a verdict and what it rests on."""
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"))) for n, what in ((fab_numbers, "unverified number(s)"), (omit_numbers, "omitted number(s)"), (fab_words, "unverified word(s)"), (omit_words, "omitted word(s)"))]
    told = F.concat_ws(", ", *parts)
    return F.concat(F.lit("verify["), result, F.lit("]: "), F.when(told == "", "all tokens OCR-attested").otherwise(told))


def disagreement(a: Column, b: Column) -> Column:
    """Whether two readings differ by over a quarter of the longer one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0) < DISAGREE


def match_exact(tokens: DataFrame, pool: DataFrame, keys: list[str], order: str, pool_order: str) -> DataFrame:
    """tokens with `matched`: the n-th occurrence of a token takes the n-th one of the pool, each once."""
    from pyspark.sql.window import Window

    nth = F.row_number()
    left = tokens.withColumn("__n", nth.over(Window.partitionBy(*keys, "token").orderBy(order)))
    right = pool.withColumn("__n", nth.over(Window.partitionBy(*keys, "token").orderBy(pool_order))).select(*keys, "token", "__n", F.lit(True).alias("matched"))
    return left.join(right, [*keys, "token", "__n"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("__n")
