"""Reading, store, calibration and markup operators on small cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators import alignment, audit, calibration, images, lookups, markup, review, scoring, tensors
from vellum.sources import contracts


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("Title\n=====\n\nSub\n---\n\n---", [("heading", 1, "Title"), ("heading", 2, "Sub"), ("rule", 0, "")]),
        ("> quoted **text**\n\n```\ncode\n```\nafter", [("paragraph", 0, "quoted text"), ("paragraph", 0, "after")]),
        ("- one\n  goes on\n  - two\n\n  second of two\n\nout", [("listItem", 0, "one goes on"), ("listItem", 1, "two second of two"), ("paragraph", 0, "out")]),
        ("a | b\n--- | ---\n1 | 2 | 3\n4\n\nx", [("table", 0, ""), ("paragraph", 0, "x")]),
        ("[link](u) ![alt](i) `co_de` *em* \\*star\\* “q” – ﬁ", [("paragraph", 0, 'link alt co_de em *star* "q" - fi')]),
        ("### Head ###\n1. first\n2) second", [("heading", 3, "Head"), ("listItem", 0, "first"), ("listItem", 0, "second")]),
        ("<div>\nhtml\n</div>\n\ntext", [("paragraph", 0, "text")]),
    ],
)
def test_markdown_blocks(md, want):
    assert [b[:3] for b in markup.parse_blocks(md)] == want


def test_tables_and_texts():
    ((_, _, _, cells),) = markup.parse_blocks("| a\\|b | c |\n| --- | --- |\n| 1 |")
    assert cells == [["a|b", "c"], ["1", ""]]
    assert markup.document_text("# A\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n---\n- b") == "A\nx y 1 2\nb"
    assert markup.with_pipe_tables("a <table><tr><td>1</td></tr></table> b") == "a \n\n| 1 |\n| --- |\n\n b" and markup.with_pipe_tables("x<table></table>") == "x\n\n"
    assert markup.cell_dialect("<fcel>a  b<ecel><nl><lcel>no<nl>") == [["a b", ""], [""]] and markup.cell_dialect("plain") == []
    assert markup.without_repeats("ab" * 3000)[1] and len(markup.without_repeats("abcdefgh" * 3000)[0]) == 8 * 2001
    assert markup.without_repeats(None) == (None, False) and markup.without_repeats("x " + "end of it " * 5) == ("x end of it", True)


def test_audit_of_numbers(spark):
    out = spark.createDataFrame([(1, "number", "12", 0), (1, "number", "999", 1), (1, "word", "alpha", 0), (1, "number", "999", 2), (2, "number", "5", 0)], "page long, kind string, token string, block long")
    source = spark.createDataFrame([(1, "number", "13", 0, 0.9), (1, "number", "777", 1, 0.9), (1, "number", "777", 3, 0.9), (1, "number", "888", 2, 0.1), (1, "word", "alpha", 0, 0.2), (3, "number", "5", 0, 1.0)], "page long, kind string, token string, line long, conf double")
    told = audit.attested(out, source, "page")
    rows = sorted(tuple(r) for r in audit.flags(told, "page").collect())
    assert rows == [(1, "fabrication", "number", "999", 1, []), (1, "omission", "number", "777", -1, [1, 3]), (2, "fabrication", "number", "5", 0, []), (3, "omission", "number", "5", -1, [0])]
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page long")
    found = {r.page: r for r in audit.verify(told, pages, "page").collect()}
    assert [found[p].verdict for p in (1, 2, 3, 4)] == ["fallback", "fallback", "fallback", "pass"] and (found[1].fab_numbers, found[1].omit_numbers, found[4].word_recall) == (1, 1, 1.0)
    known = spark.createDataFrame([(1, "999")], "page long, token string")
    assert not [r for r in audit.flags(audit.attested(out, source, "page", known), "page").collect() if r.token == "999"]


def test_artifact_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([("d", "fit", c, p, ok) for c, p, ok in (("a", 0.2, False), ("b", 0.8, True), ("1", 0.4, False), ("2", 0.9, True), (" ", 0.1, True))], "domain string, split string, ch string, conf double, correct boolean")
    overall, digit = calibration.fit_maps(labels)
    made = calibration.artifact(overall, digit, ["d/fit"])
    path = f"file://{tmp_path}/artifact"
    calibration.write_text(spark, made, path)
    mode, points, digits = calibration.read_artifact(spark, path)
    assert mode == "isotonic" and points[0] == (0.2, 0.0) and points[-1][1] == 1.0 and digits == [(0.4, 0.0), (0.9, 1.0)]
    assert calibration.read_artifact(spark, f"file://{tmp_path}/missing")[0] == "identity"
    calibration.write_text(spark, '{"signals": {}}', path)
    assert calibration.read_artifact(spark, path) == ("identity", [], [])
    row = spark.createDataFrame([(0.3, "a")], "p double, ch string").select(calibration.calibrated(F.col("p"), F.col("ch"), [], []).alias("x")).first()
    assert row.x == 0.3
    assert calibration.deployed("old", made, True, False, True) == "old" and calibration.deployed("old", made, True, True, True) == made
    assert json.loads(calibration.deployed("old", made, True, True, False))["signals"] == {}
    bins = calibration.reliability(spark.createDataFrame([(0.95, True), (0.05, False)], "score double, good boolean"))
    assert "| 9 | 1 | 0.950 | 1.000 | #################### |" in calibration.reliability_report(bins, "T")


def test_page_labels(spark):
    lines = spark.createDataFrame([(1, 0, "ab", [0.9, 0.8]), (1, 1, "skip", [0.5]), (1, 2, "cd", [0.7, 0.6]), (2, 0, "x", [0.1])], "page_id long, ord long, text string, char_conf array<double>")
    truth = spark.createDataFrame([(1, "ab\ncX"), (2, None)], "page_id long, truth string")
    rows = [(r.page_id, r.ch, r.conf, r.correct) for r in alignment.page_labels(lines, truth).orderBy("ord").collect()]
    assert rows == [(1, "a", 0.9, True), (1, "b", 0.8, True), (1, "\n", 1.0, True), (1, "c", 0.7, True), (1, "d", 0.6, False)]


def test_lookups(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "page_id long, at long, status string")
    assert sorted(tuple(r) for r in lookups.latest(log, ["page_id"], "at").collect()) == [(1, 3, "b"), (2, 2, "c")]
    assert [r.page_id for r in lookups.pages_in(log, "c", "a").orderBy("page_id").collect()] == [1, 2]


def test_scoring_folds_forms():
    assert scoring.field_form("12–34", "text") == "12-34" and scoring.field_form("ﬁne “x”", "text") == 'fine "x"' and scoring.field_form("A-1 / 2", "id") == "a12"


def test_text_forms(spark):
    row = spark.createDataFrame([("formula_number", "glm-ocr", "Name: ")], "label string, model string, s string").select(
        t.task_of(F.col("label")).alias("task"), t.prompt_for(F.col("model"), F.col("label")).alias("prompt"), t.colon_label(F.col("s")).alias("key"), t.prompt_for(F.lit("other"), F.col("label")).alias("none"),
        t.region_kind(F.lit("formula")).alias("formula"), t.region_kind(F.lit("header_image")).alias("picture"), t.region_kind(F.lit("figure")).alias("figure"),
    ).first()
    assert tuple(row) == ("formula", "Formula Recognition:", "name", None, "text", "imageish", "text")


def test_uncertainty_layer_of_an_empty_page(spark):
    pages = spark.createDataFrame([(1, 10, 20, "identity")], "page_id long, width int, height int, calibration string")
    none = spark.createDataFrame([], "page_id long, line_id long, min double")
    out = review.uncertainty_layer(pages, none, none.withColumnRenamed("line_id", "cluster"), none.withColumnRenamed("line_id", "block_id"), none.withColumnRenamed("line_id", "ord")).first()
    assert out.lines == out.gaps == out.blocks == out["items"] == []


def picture(h, w):
    rng = np.random.default_rng(h * w)
    out = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    out[..., 3] = 255
    return out


def test_image_operations():
    image = picture(6, 8)
    assert (images.resized(image, 8, 6) == image).all() and images.resized(image, 16, 12).shape == (12, 16, 4)
    half = images.resized(image, 4, 3)
    assert half[1, 2].tolist() == np.rint(image[2:4, 4:6].astype(float).mean(axis=(0, 1))).astype(int).tolist()
    assert (images.warped(image, [(0, 0), (8, 0), (8, 6), (0, 6)], 8, 6) == image).all()
    assert images.warped(image, [(-9, -9), (-5, -9), (-5, -6), (-9, -6)], 4, 3)[0, 0].tolist() == [0, 0, 0, 255]
    assert (images.turned(image)[0] == image[:, -1]).all() and images.turned(image).shape == (8, 6, 4)
    p = images.planes(image, (0.5, 0.4, 0.3), (0.2, 0.2, 0.2), bgr=True)
    assert p.shape == (3, 6, 8) and abs(p[0, 2, 3] - (image[2, 3, 2] / 255 - 0.5) / 0.2) < 1e-5
    crop, box = images.cropped(image, (-1.5, 1.2, 3.1, 99))
    assert box == (0, 1, 4, 6) and (crop == image[1:6, 0:4]).all()


def test_prepared_crops(spark):
    clear = picture(60, 60)
    clear[0, 0] = (10, 20, 30, 0)
    out, changed = images.prepared(clear)
    assert changed and out[0, 0].tolist() == [255, 255, 255, 255] and images.prepared(picture(60, 60))[1] is False
    assert images.prepared(picture(20, 30))[0].shape == (120, 180, 4) and images.prepared(picture(60, 6000))[0].shape == (120, 6000, 4)
    small = picture(20, 30)
    rows = spark.createDataFrame([(1, 30, 20, bytearray(small.tobytes()))], "crop_id long, width int, height int, pixels binary")
    (row,) = images.prepared_crops(rows).collect()
    assert (row.width, row.height, row.changed) == (180, 120, True) and bytes(row.pixels) == images.prepared(small)[0].tobytes()


def test_connected_parts_equal_a_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(20):
        on = rng.random((14, 17)) < 0.35
        left, want = {(int(a), int(b)) for a, b in zip(*np.nonzero(on), strict=True)}, set()
        while left:
            todo, part = [left.pop()], set()
            while todo:
                a, b = todo.pop()
                part.add((a, b))
                near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            want.add(frozenset(part))
        assert {frozenset(zip(y.tolist(), x.tolist(), strict=True)) for y, x in tensors.parts(on)} == want


def test_page_regions(spark):
    rows = spark.createDataFrame([(1, 100.0, 200.0, [[3.0, -3.0], [-3.0, 2.0], [-9.0, -9.0]], [[0.5, 0.5, 0.2, 0.2], [0.1, 0.1, 0.4, 0.1], [0.5, 0.5, 1.0, 1.0]], [[0.0, -5.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])], "page_id long, width double, height double, logits array<array<double>>, boxes array<array<double>>, order_logits array<array<double>>")
    got = [(r.region_id, r.label, round(r.x0, 6), round(r.y1, 6)) for r in tensors.page_regions(rows, ["text", "table"]).orderBy("region_id").collect()]
    assert got == [(0, "table", 0.0, 30.0), (1, "text", 40.0, 120.0)]


def test_reset_sessions(spark):
    events = spark.createDataFrame([(1, 1, "text-edit"), (1, 2, "reset"), (1, 3, "dismiss"), (1, 4, "text-edit")], "page_id long, seq long, kind string")
    sessions = spark.createDataFrame([(1, "h", 1)], "page_id long, base_hash string, undone int")
    hashes = spark.createDataFrame([(1, "h")], "page_id long, hash string")
    assert [r.seq for r in review.session_events(events, sessions, hashes).collect()] == [3]


def test_corpus_loaders(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"datasets": [{"dir": "f", "format": "funsd", "split": "fit", "limit": 1}, {"dir": "s", "format": "sroie", "split": "held-out"}, {"dir": "x", "format": "other", "split": "fit"}]}))
    for doc in ("a", "b"):
        (tmp_path / "f" / "annotations").mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / "annotations" / f"{doc}.json").write_text(json.dumps({"form": [{"words": [{"box": [0, 1, 2, 3], "text": f"w{doc}"}]}]}))
    (tmp_path / "s" / "box").mkdir(parents=True)
    (tmp_path / "s" / "box" / "r.txt").write_text("1,2,3,2,3,4,1,4,TOTAL, 5\n")
    rows = sorted((r.domain, r.split, r.doc, r.text) for r in contracts.corpus(spark, f"file://{tmp_path}").collect())
    assert rows == [("funsd", "fit", "a", "wa"), ("sroie", "held-out", "r", "TOTAL, 5")]
    assert contracts.corpus(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "p.fields.json").write_text(json.dumps({"fields": [{"name": "n", "value": "v", "normalize": "id", "page": 2}]}))
    assert [tuple(r) for r in contracts.truth_fields(spark, f"file://{tmp_path}/p.fields.json").collect()] == [("p", 0, "n", "v", "id", 2)]
    (tmp_path / "p.001.gt.md").write_text("# Title\n\ntext **bold**\n")
    images = spark.createDataFrame([("/x/p.001.png",), ("/x/q.001.png",)], "path string")
    assert [(r.id, r.truth) for r in contracts.transfer_pages(spark, images, f"file://{tmp_path}/*.gt.md").collect()] == [("medical/p.001", "Title\ntext bold")]


def test_files_by_type_and_tags(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", 5, "application/pdf"), ("b.png", 5, "text/plain"), ("c", 5, "image/heic"), ("d.gif", 5, None), ("e.pdf", 5, "")], "path string, length long, mime string")
    assert [(r.path, r.kind) for r in contracts.classified_files(files).orderBy("path").collect()] == [("a.bin", "pdf"), ("b.png", None), ("c", "image"), ("d.gif", "image"), ("e.pdf", "pdf")]
    (tmp_path / "run-p1.json").write_text('{"schema": "g-regions/1", "tag": "p1", "page_id": 1, "regions": []}\n')
    (tmp_path / "q.json").write_text('{"schema": "g-regions/1", "tag": "p2", "page_id": 1, "regions": []}\n')
    assert contracts.named(contracts.export_pages(spark, f"file://{tmp_path}/run-p1.json")).first().tag == "p1"
    with pytest.raises(Exception, match="has tag p2"):
        contracts.named(contracts.export_pages(spark, f"file://{tmp_path}/q.json")).collect()
    one = spark.createDataFrame([("g-vlm-replay/1", "p9", 1)], "schema string, tag string, page_id long").withColumn("opts", F.lit(None).cast("map<string,string>")).withColumn("regions", F.array().cast("array<struct<regionKey:string,text:string,truncated:boolean,repetitive:boolean>>"))
    with pytest.raises(Exception, match="tags differ"):
        contracts.joined_regions(contracts.export_pages(spark, f"file://{tmp_path}/run-p1.json"), one).collect()
    with pytest.raises(Exception, match="only one contract has page"):
        contracts.joined_regions(contracts.export_pages(spark, f"file://{tmp_path}/run-p1.json"), one.withColumn("page_id", F.lit(7).cast("long"))).collect()
