"""Readers of the ingestion contracts and of evaluation corpora, and writers. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.markup import document_text

# Schema tags of the contracts, the largest file, and known kinds of files.
EXPORT_TAG, REPLAY_TAG = "g-regions/1", "g-vlm-replay/1"
MOST_BYTES = 500 << 20
PDF_TYPES, IMAGE_TYPES = ("pdf",), ("png", "jpg", "jpeg", "webp", "bmp", "gif", "avif", "tif", "tiff")

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE = f"struct<text:string,conf:double,box:{BOX}>"
EXPORT_SCHEMA = f"schema string, tag string, page_id long, width double, height double, regions array<struct<regionKey:string,index:int,label:string,kind:string,box:{BOX},lines:array<{LINE}>>>, orphans array<{LINE}>"
REPLAY_SCHEMA = "schema string, tag string, page_id long, opts map<string,string>, regions array<struct<regionKey:string,text:string,truncated:boolean,repetitive:boolean>>"


def tagged(df: DataFrame, tag: str) -> DataFrame:
    """df, failing at the first row whose schema tag isn't the expected one."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {tag}, found "), F.coalesce("schema", F.lit("none"))))
    return df.withColumn("schema", F.when(F.col("schema") == tag, F.col("schema")).otherwise(wrong))


def export_pages(spark: SparkSession, path: str) -> DataFrame:
    return tagged(spark.read.schema(EXPORT_SCHEMA).option("mode", "FAILFAST").json(path), EXPORT_TAG)


def replay_files(spark: SparkSession, path: str) -> DataFrame:
    return tagged(spark.read.schema(REPLAY_SCHEMA).option("mode", "FAILFAST").json(path), REPLAY_TAG)


def named(df: DataFrame) -> DataFrame:
    """df, failing at the first row whose tag isn't the name of its file: <tag>.json, whatever stands before it after a dash or a dot. Rows
    without a tag pass."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    wrong = F.raise_error(F.concat(F.lit("file "), name, F.lit(" has tag "), F.col("tag")))
    return df.withColumn("tag", F.when(F.col("tag").isNull() | (F.col("tag") == name) | name.endswith(F.concat(F.lit("-"), F.col("tag"))) | name.endswith(F.concat(F.lit("."), F.col("tag"))), F.col("tag")).otherwise(wrong))


def joined_regions(exports: DataFrame, replays: DataFrame) -> DataFrame:
    """(page_id, region_key, index, label, kind, box, lines, reading): each exported region with its reading. Fails where a page's keys
    or tags differ between the two contracts, or where only one has the page."""
    keys = lambda c: F.transform(c, lambda r: r["regionKey"])
    both = exports.alias("e").join(replays.alias("r"), "page_id", "full")
    lone = F.col("e.schema").isNull() | F.col("r.schema").isNull()
    drift = F.coalesce(F.col("e.tag") != F.col("r.tag"), F.lit(False))
    extra = F.concat(F.array_except(keys(F.col("e.regions")), keys(F.col("r.regions"))), F.array_except(keys(F.col("r.regions")), keys(F.col("e.regions"))))
    checked = both.select("page_id", F.when(lone, F.raise_error(F.concat(F.lit("only one contract has page "), F.col("page_id").cast("string")))).when(drift, F.raise_error(F.concat(F.lit("tags differ: "), F.col("e.tag"), F.lit(", "), F.col("r.tag")))).when(F.size(extra) == 0, F.col("e.regions")).otherwise(F.raise_error(F.concat(F.lit("region keys differ: "), F.array_join(extra, ", ")))).alias("regions"), F.col("r.regions").alias("readings"))
    own = checked.select("page_id", F.explode("regions").alias("x"), "readings")
    reading = F.get(F.filter("readings", lambda r: r["regionKey"] == F.col("x.regionKey")), F.lit(0))
    return own.select("page_id", F.col("x.regionKey").alias("region_key"), "x.index", "x.label", "x.kind", "x.box", "x.lines", reading.alias("reading"))


def classified_files(files: DataFrame) -> DataFrame:
    """files(path, length, …) with kind pdf, image or null and reason: why a file isn't taken, null if it is. Where files have a column mime,
    it is believed before the ending of an image's name; a PDF is one by either."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lower(F.coalesce("mime", F.lit(""))) if "mime" in files.columns else F.lit("")
    kind = F.when((mime == "application/pdf") | ending.isin(*PDF_TYPES), "pdf").when(mime.startswith("image/") | (mime == "") & ending.isin(*IMAGE_TYPES), "image")
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(kind.isNull(), "unknown type")
    return files.withColumn("kind", kind).withColumn("reason", reason)


def ingest(files: DataFrame, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Accepted files with `ord` from start on, and skipped ones with their reason; a bad file never fails the others."""
    known = classified_files(files)
    taken = known.where("reason is null").withColumn("ord", F.row_number().over(Window.orderBy("path")) - 1 + start)
    return taken, known.where("reason is not null")


def raster_scale(width: Column, height: Column) -> Column:
    """The scale at which a page of this size in points is rasterised: 2000 pixels on the long edge, from 1 to 3, 25 megapixels at most."""
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.lit(2000.0) / F.greatest(width, height)))
    return F.least(wanted, F.sqrt(F.lit(25e6) / (width * height)))


def form_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc, ord, text, box) of word annotations in JSON files {"form": [{"words": [{"box": [x0, y0, x1, y1], "text": …}]}]}."""
    schema = "form array<struct<words:array<struct<box:array<double>,text:string>>>>"
    pages = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    own = pages.select("doc", F.posexplode(F.flatten(F.transform("form", lambda f: f["words"]))).alias("ord", "w"))
    return own.select("doc", "ord", "w.text", F.struct(*[F.col("w.box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("box"))


def receipt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text, box) of lines x1,y1,…,x4,y4,text; the text may hold commas."""
    raw = spark.read.text(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1))
    parts = F.split("value", ",", 9)
    xs, ys = F.array(*[parts[i].cast("double") for i in (0, 2, 4, 6)]), F.array(*[parts[i].cast("double") for i in (1, 3, 5, 7)])
    return raw.where(F.size(parts) == 9).select("doc", parts[8].alias("text"), F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).alias("box"))


def truth_fields(spark: SparkSession, path: str) -> DataFrame:
    """(doc, ord, name, value, normalize, page) of files <doc>.fields.json {"fields": [{name, value, normalize, page}]}; a file that can't be
    read as such gives no rows."""
    schema = "fields array<struct<name:string,value:string,normalize:string,page:int>>"
    own = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.fields\.json$", 1))
    return own.select("doc", F.posexplode("fields").alias("ord", "f")).select("doc", "ord", "f.name", "f.value", "f.normalize", "f.page")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, split, doc, ord, text, box) of all datasets that <folder>/manifest.json declares as {"datasets": [{dir, format, split, domain,
    limit}]}: forms (funsd) and receipts (sroie), of each the first `limit` documents by name. Without a manifest there are no rows."""
    empty = "domain string, split string, doc string, ord int, text string, box struct<x0:double,y0:double,x1:double,y1:double>"
    out = spark.createDataFrame([], empty)
    try:
        declared = spark.read.schema("datasets array<struct<dir:string,format:string,split:string,domain:string,limit:int>>").option("multiLine", True).json(f"{folder}/manifest.json").first()
    except AnalysisException:
        return out
    for d in (declared.datasets or []) if declared else []:
        place = f"{folder}/{d['dir']}"
        rows = form_words(spark, f"{place}/annotations") if d["format"] == "funsd" else receipt_lines(spark, f"{place}/box").withColumn("ord", F.lit(None).cast("int")) if d["format"] == "sroie" else None
        if rows is None:
            continue
        if d["limit"]:
            rows = rows.join(rows.select("doc").distinct().orderBy("doc").limit(d["limit"]), "doc", "left_semi")
        out = out.unionByName(rows.select(F.lit(d["domain"] or d["format"]).alias("domain"), F.lit(d["split"]).alias("split"), "doc", F.col("ord").cast("int").alias("ord"), "text", "box"))
    return out


def transfer_pages(spark: SparkSession, images: DataFrame, truth_path: str) -> DataFrame:
    """(id, domain, split, path, truth): pages of images(path) named <doc>.<page>.png that have a Markdown truth, with its plain text."""
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    text = F.pandas_udf(lambda s: s.map(document_text), "string")
    truth = truth_pages(spark, truth_path).select(F.concat_ws(".", "doc", F.lpad(F.col("page").cast("string"), 3, "0")).alias("tag"), text("md").alias("truth"))
    return images.withColumn("tag", name).join(truth, "tag").select(F.concat(F.lit("medical/"), F.col("tag")).alias("id"), F.lit("medical").alias("domain"), F.lit("transfer").alias("split"), "path", "truth")


def truth_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, md) of files <doc>.<page>.gt.md."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"([^/]+)\.(\d+)\.gt\.md$", 1).alias("doc"), F.regexp_extract(name, r"([^/]+)\.(\d+)\.gt\.md$", 2).cast("int").alias("page"), F.col("value").alias("md"))


def delete_document(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents (doc_id)."""
    return {name: df.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for name, df in tables.items()}


def exported_markdown(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's pages in order, a corrected page instead of its result, a blank line between."""
    own = results.join(corrections.select("doc_id", "page", F.col("markdown").alias("corrected")), ["doc_id", "page"], "left")
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("corrected", "markdown").alias("md"))))
    return own.groupBy("doc_id").agg(F.concat_ws("\n\n", F.transform(parts["md"], lambda m: F.regexp_replace(m, r"\n+\z", ""))).alias("markdown"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """One text folder a document."""
    documents.select("doc_id", "markdown").write.partitionBy("doc_id").text(path)
