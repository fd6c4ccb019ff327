"""Kernels on small cases and against other versions of themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import geometry as g
from vellum.functions import stats as st
from vellum.functions import text as t
from vellum.operators import alignment, anchoring, assembly, audit, calibration, document, evaluation, layout, markup, pairing, readings, review, scoring, spatial, tensors
from vellum.sources import contracts


def seg(i, text, x, y, w=100.0, h=16.0):
    return pairing.Seg(i, text, x, y, x + w, y + h, *pairing.plain_vote(text))


@pytest.mark.parametrize("scale", [0.5, 1.0, 4.0])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_stacked_grids_pair_labels_with_values_below(n, scale):
    labels, values = ["Name:", "Birth date:", "Case no:", "Status:"][:n], ["Smith, Jane", "12/01/2014", "A-123456", "open"][:n]
    segs = [seg(i, x, (84 + 300 * i) * scale, 150 * scale, 100 * scale, 16 * scale) for i, x in enumerate(labels)]
    segs += [seg(n + i, x, (84 + 300 * i) * scale, 180 * scale, 100 * scale, 16 * scale) for i, x in enumerate(values)]
    best, _, pairs = pairing.interpret(segs, 16 * scale, 30 * scale, 1275 * scale, pairing.plain_vote)
    assert best.kind == "kv" and {(p.label, p.value) for p, _ in pairs} == {(a.removesuffix(":"), b) for a, b in zip(labels, values, strict=True)}
    assert all(0 < c <= 1 for _, c in pairs)


def test_inline_columns_pair_rows():
    rows = [("Name:", "Smith, Jane"), ("Date:", "12/01/2014"), ("Case no:", "A-123456")]
    segs = [s for r, (a, b) in enumerate(rows) for s in (seg(2 * r, a, 84, 150 + 40 * r), seg(2 * r + 1, b, 400, 150 + 40 * r))]
    best, _, pairs = pairing.interpret(segs, 16, 40, 1275, pairing.plain_vote)
    assert best.layout == "inline" and [(p.label, p.value) for p, _ in pairs] == [(a[:-1], b) for a, b in rows]


def test_prose_stays_lines():
    lines = ["the patient was seen on the ward and was well for most of the day", "there was no sign of any further change in the state of the wound", "and so the plan is to go on with the present care as it is now"]
    best, *_ = pairing.interpret([seg(i, x, 84, 150 + 30 * i, 900) for i, x in enumerate(lines)], 16, 30, 1275, pairing.plain_vote)
    assert best.kind == "lines"


def test_votes_in_spark_and_plain_python_agree(spark):
    texts = ["Name:", "12/01/2014", "A-123456", "Smith, Jane", "open", "", " ", "S100 ER", "two words", "4.5 mg/ml", "a sentence that has a good many words in lower case", "Dr. Who", "ends here.", "Fig. 3 no.", ":", "Date: ", "x1 y2 z3"]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select("s", t.cell_vote(F.col("s")).alias("v")).collect()
    for r in rows:
        assert (round(r.v.v, 9), r.v.strong) == pytest.approx((round(pairing.plain_vote(r.s)[0], 9), pairing.plain_vote(r.s)[1])), r.s


KV = [("Name: Smith, Jane", ("Name", "Smith, Jane")), ("Case no: A-123456", ("Case no", "A-123456")), ("At 12: 30 the", None), ("no colon here", None), ("Note: the end. Then more came", None), ("Size (cm): 4.5 mm", ("Size (cm)", "4.5 mm")), ("Bad (open: 12345", None)]


@pytest.mark.parametrize(("line", "want"), KV)
def test_kv_lines_in_plain_python(line, want):
    assert assembly.kv_line(line) == want


def test_kv_lines_in_spark(spark):
    df = spark.createDataFrame([(x,) for x, _ in KV], "line string")
    one = {r.line: (r.kv.label, r.kv.value) if r.kv else None for r in df.select("line", t.parse_kv_line(F.col("line")).alias("kv")).collect()}
    many = {r.line: (r.label, r.value) if r.label else None for r in pairing.parse_kv_lines(df, ["line"], "line").collect()}
    assert one == many == dict(KV)


def test_assembly_of_a_page():
    segs = [("Pathology Report", 300, 20, 780, 40), ("Name: Smith, Jane", 84, 100, 400, 116), ("• first item", 84, 140, 300, 156), ("The sample was received in good state and was cut", 84, 260, 900, 276), ("into four parts.", 84, 285, 300, 301), ("-----", 84, 360, 1200, 376)]
    lines = [assembly.Line(x, tuple(map(float, b))) for x, *b in segs]
    # the label line on the list's edge is its first item, whose bullet is lost
    want = [("heading", "Pathology Report"), ("listItem", "Smith, Jane"), ("listItem", "first item"), ("paragraph", "The sample was received in good state and was cut into four parts."), ("rule", "")]
    assert [(b.kind, b.text or b.label) for b in assembly.assemble(lines, assembly.page_scales([x.box for x in lines], 1275))] == want


def test_segments_and_orders_ignore_the_order_of_rows(spark):
    rng = random.Random(2)
    words = [(p, f"w{i}", float(x), float(y), float(x + 60), float(y + 14), 0.9, i) for p in range(3) for i, (x, y) in enumerate([(c * 70 + (c > 3) * 200, r * 30) for r in range(5) for c in range(7)])]
    schema = "page_id long, text string, x0 double, y0 double, x1 double, y1 double, conf double, ord long"
    a = layout.line_segments(spark.createDataFrame(words, schema)).collect()
    rng.shuffle(words)
    b = layout.line_segments(spark.createDataFrame(words, schema).repartition(7)).collect()
    assert sorted(a) == sorted(b) and len(a) == 3 * 5 * 2
    assert layout.cut_order([(0, 0, 40, 10), (60, 0, 100, 10), (0, 20, 40, 30), (60, 20, 100, 30)], 5) == [0, 2, 1, 3]
    assert layout.suppressed([("text", 0.9, (0, 0, 10, 10)), ("text", 0.8, (0, 0, 10, 9)), ("table", 0.95, (20, 20, 90, 90)), ("text", 0.7, (30, 30, 40, 40)), ("title", 0.4, (0, 90, 10, 99))]) == [2, 0]


def test_anchoring_uses_each_number_once():
    pool = anchoring.Pool([(0, "12"), (0, "34"), (1, "12"), (0, "567")])
    assert pool.exact("12", 1) and pool.exact("12", 0) and not pool.exact("12", 0)
    assert anchoring.Pool([(0, "12"), (0, "34")]).split("12-34", 0) == ("12", "34")
    assert anchoring.Pool([(0, "567"), (1, "568")]).near("56", 0) == ("567", False)
    assert anchoring.Pool([(0, "567"), (0, "568")]).near("569", 0) == (None, True)
    text, events, counts = anchoring.anchor("Got 568, not 99999 (of 12-34).", 0, anchoring.Pool([(0, "567"), (0, "12"), (0, "34")]))
    assert text == "Got 567, not (of 12 - 34)." and [e[0] for e in events] == ["replaced", "dropped", "split-joined"]
    assert counts == {"total": 3, "replaced": 1, "dropped": 1, "split-joined": 1} and [(e.start, e.end, e.severity) for e in events] == [(4, 7, "high"), (13, 13, "high"), (18, 25, "low")]


def test_fuzzy_antijoin_equals_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(n)]
    left, pool = make(60), make(6)
    got = {r.token for r in audit.missing_tokens(spark.createDataFrame([(x,) for x in left], "token string"), spark.createDataFrame([(x,) for x in pool], "token string"), []).collect()}
    assert got == {x for x in left if not any(anchoring.within_one_edit(x, p) for p in pool)}


def test_scoring_buckets(spark):
    page = scoring.Page([("Name", "Jane"), ("Date", "12/01/2014"), ("Ward", "7 North"), ("Room", "12a"), ("Bed", "lost")], [("Neutral", "pair")], [("Name:", "Jane"), ("Other", "12/01/2014"), ("Neutral", "pair"), ("Wrong", "thing")], [("Ward", "7 North")], [("Room", "12a")], [("Jane", "name")], "Jane 12/01/2014")
    found, false = scoring.outcomes(page)
    assert [w for _, w, _ in found] == ["paired", "mispaired", "in_table", "in_list", "ocr_miss"] and [c for *_, c in found] == [True, False, False, False, False]
    assert false == 2


def test_baseline_rates(spark):
    one = dict(zip(evaluation.COUNTS, (69, 53, 3, 57, 0, 0, 9, 7, 0, 44, 43), strict=True))
    r = evaluation.with_rates(spark.createDataFrame([tuple(one.values())], ", ".join(f"{c} long" for c in evaluation.COUNTS))).first()
    assert [round(r[c], 4) for c in ("precision", "recall", "f1", "binding_recall", "critical_recall")] == [0.9464, 0.7681, 0.848, 0.8986, 0.9773]


def test_isotonic_is_monotone_and_pools_ties(spark):
    rows = spark.createDataFrame([(0.5, False, 1), (0.5, True, 2), (0.6, False, 3), (0.6, True, 4), (0.6, True, 5), (0.9, False, 6)], "score double, good boolean, ord long")
    points = [(r.x, r.y) for r in calibration.fit_isotonic(rows).collect()]
    assert [x for x, _ in points] == sorted(x for x, _ in points) and [y for _, y in points] == sorted(y for _, y in points)
    assert calibration.auroc(rows.limit(0)).first().auroc == 0.5
    assert calibration.auroc(spark.createDataFrame([(0.1, False, 1), (0.9, True, 2), (0.9, False, 3)], "score double, good boolean, ord long")).first().auroc == 0.75


def test_corrections(spark):
    blocks = spark.createDataFrame([(1, "a", 0, "A"), (1, "b", 1, "B")], "page_id long, uid string, place int, markdown string")
    log = "page_id long, seq long, kind string, uid string, after_uid string, markdown string"
    events = [("text-edit", "+2", None, "too early"), ("text-edit", "a", None, "A1"), ("region-add", "+2", "a", "new"), ("text-edit", "a", None, "A2"), ("block-remove", "a", None, None), ("region-add", "+5", "nowhere", "end"), ("text-edit", "+2", None, "new1")]
    rows = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], log)
    assert [r.markdown for r in review.replay(blocks, rows).orderBy("place").collect()] == ["new1", "B", "end"]


def spliced_list(base, events):
    """The blocks after a log, by inserting into a list event by event."""
    out, gone = [[uid, md] for uid, md in base], set()
    for kind, uid, after, md in events:
        if kind == "text-edit":
            for x in [x for x in out if x[0] == uid][:1]:
                x[1] = md
        elif kind == "block-remove":
            gone.add(uid)
        elif kind == "region-add":
            at = 0 if after is None else next((i + 1 for i, x in enumerate(out) if x[0] == after), len(out))
            out.insert(at, [uid, md])
    return [tuple(x) for x in out if x[0] not in gone]


def test_replay_equals_list_insertion(spark):
    rng = random.Random(3)
    blocks, events, want = [], [], {}
    for page in range(40):
        base, log, known = [(f"b{i}", f"B{i}") for i in range(rng.randint(0, 4))], [], [f"b{i}" for i in range(4)]
        for seq in range(rng.randint(0, 14)):
            kind = rng.choice(["region-add", "region-add", "text-edit", "block-remove", "dismiss"])
            uid = f"r{seq}" if kind == "region-add" else rng.choice(known)
            log.append((kind, uid, rng.choice([None, "unknown", *known]), f"{kind} {seq}"))
            known += [uid] if kind == "region-add" else []
        blocks += [(page, uid, i, md) for i, (uid, md) in enumerate(base)]
        events += [(page, i, *e) for i, e in enumerate(log)]
        want[page] = spliced_list(base, log)
    got = review.replay(spark.createDataFrame(blocks, "page_id long, uid string, place int, markdown string"), spark.createDataFrame(events, "page_id long, seq long, kind string, uid string, after_uid string, markdown string")).orderBy("page_id", "place").collect()
    assert {p: [(r.uid, r.markdown) for r in got if r.page_id == p] for p in want} == want


def test_groups_stay_whole_where_both_sides_are_dealt_already(spark):
    """Corrections of many pages: the side of the blocks is small and regrouped to fewer partitions than the log's."""
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        log = spark.range(20_000).select((F.col("id") % 50).alias("page_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "block-remove").otherwise("text-edit").alias("kind"), F.lit("a").alias("uid"), F.lit(None).cast("string").alias("after_uid"), F.sha2(F.col("id").cast("string"), 512).alias("markdown"))
        log = log.withColumn("markdown", F.concat("markdown", F.count(F.lit(1)).over(Window.partitionBy("page_id")).cast("string")))
        blocks = log.select("page_id").distinct().select("page_id", F.lit("a").alias("uid"), F.lit(0).alias("place"), F.lit("A").alias("markdown"))
        # even pages remove their one block, odd ones edit it
        got = review.replay(blocks, log).collect()
    finally:
        for k in own:
            spark.conf.unset(k)
    assert sorted(r.page_id for r in got) == list(range(1, 50, 2)) and all(r.markdown != "A" for r in got)


def test_suppression_by_label_and_kind():
    box = (0.0, 0.0, 100.0, 100.0)
    inner = (10.0, 10.0, 60.0, 60.0)
    keep = lambda *r: layout.suppressed(list(r))
    assert keep(("table", 0.9, box), ("footnote", 0.8, inner)) == [0] and keep(("seal", 0.9, box), ("header", 0.8, inner)) == [0]
    assert keep(("figure", 0.9, box), ("text", 0.8, inner)) == [0, 1] and keep(("table", 0.9, box), ("image", 0.8, inner)) == [0, 1]
    assert keep(("image", 0.9, box), ("chart", 0.8, box)) == [0, 1] and keep(("text", 0.9, box), ("title", 0.8, box)) == [0]
    assert keep(("text", 0.9, box), ("text", 0.8, (0.0, 0.0, 100.0, 65.0))) == [0] and keep(("text", 0.9, box), ("title", 0.8, (0.0, 0.0, 100.0, 65.0))) == [0, 1]


def page_of(lines, width=1275):
    made = [assembly.Line(x, (x0, y, x0 + 8.0 * len(x), y + 16)) for x, x0, y in lines]
    return made, assembly.page_scales([x.box for x in made], width)


def test_assembly_states():
    lines = [("CENTRAL SERVICES", 500, 20), ("Microscopic Description:", 84, 100), ("The section shows a lesion of the skin that was", 84, 130), ("cut out whole with a clear margin on all sides", 84, 160)]
    lines += [("• Margin: the margin was found to be clear", 120, 220), ("of the lesion", 136, 250), ("• Second point", 120, 280), ("Date: 12/01/2014", 84, 340), ("Specimen 1", 84, 420)]
    made, scales = page_of(lines)
    blocks = assembly.assemble(made, scales)
    assert [(b.kind, b.depth) for b in blocks] == [("heading", 1), ("heading", 2), ("paragraph", 0), ("listItem", 0), ("listItem", 0), ("kv", 0), ("heading", 3)]
    assert blocks[3][2:4] == ("the margin was found to be clear of the lesion", "Margin") and blocks[5][3:5] == ("Date", "12/01/2014")
    assert [b.kind for b in assembly.assemble(made, scales, headings=False)][:2] == ["paragraph", "paragraph"]


def test_lost_bullets_and_wrapped_values():
    lines = [("Findings of the day were these and no other ones at all", 84, 60), ("Margin: the margin was found to be clear", 84, 100), ("and wide", 84, 130), ("Nodes: no node was found to be involved", 84, 160)]
    made, scales = page_of(lines)
    assert assembly.list_starts(made, scales) == {1, 3} and assembly.list_starts(made[:2], scales) == set()
    assert [b.kind for b in assembly.assemble(made, scales, headings=False)] == ["paragraph", "listItem", "listItem"]
    made, scales = page_of([("A first line that is long enough to be a text of its own", 84, 60), ("Name: DELMONT, EDITH", 84, 100), ("ANNA", 84, 130), ("and the text goes on here", 400, 200)])
    assert [b.value for b in assembly.assemble(made, scales, headings=False) if b.kind == "kv"] == ["DELMONT, EDITH ANNA"]


def test_regions_of_cells_become_tables_and_pairs():
    rows = [("Test", "Result", "Unit"), ("Glucose", "5.1", "mmol"), ("Sodium", "140", "mmol")]
    made, scales = page_of([(x, 84 + 300 * c, 100 + 40 * r) for r, row in enumerate(rows) for c, x in enumerate(row)])
    (table,) = assembly.assemble(made, scales, headings=False)
    assert table.kind == "table" and table.text.splitlines()[0] == "| Test | Result | Unit |" and len(table.text.splitlines()) == 4


def test_readings_are_cleaned_and_split():
    raw = "```markdown\nHere is the text:\n\n• one\n<!-- no -->“Two” – three\n```"
    assert readings.cleaned(raw) == '- one\n"Two" - three' and readings.cleaned(" ") == "" and readings.cleaned("Sure, here:\nx") == "x"
    parts = readings.parts_of("text\n**Name:** Jane\n**Ward**: 7\n<table><tr><td>\n**A:** b\n</td></tr></table>\n**no pair** x")
    assert parts[:3] == ["text", ("Name", "Jane"), ("Ward", "7")] and "**A:** b" in parts[3] and "no pair" in parts[3]


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [
        ("# Some *Title*\nmore", "title", [("heading", 1, "Some Title more")]),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "heading", [("heading", 2, "a b --- --- ")]),
        ("## Inner\ntext here\n- **Lead:** 12 mm\n\n---", "text", [("heading", 3, "Inner"), ("paragraph", 0, "text here"), ("listItem", 0, "12 mm"), ("rule", 0, "")]),
        ("##### Deep\n\n# Top", "page", [("heading", 3, "Deep"), ("heading", 1, "Top")]),
        ("One\n\nTwo\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "table", [("paragraph", 0, "One"), ("table", 0, "")]),
        ("<fcel>x<ecel><nl><fcel>1<lcel>no<nl>", "table", [("table", 0, "")]),
        ("no table", "table", []), ("", "text", []), ("[image]", "text", [("paragraph", 0, "[image]")]),
    ],
)
def test_reading_blocks(raw, kind, want):
    got = [(b.kind, b.depth, b.text) for b in readings.blocks_of(raw, kind)]
    assert got == ([("heading", 2, "a b")] if kind == "heading" else want)


def test_review_items_of_readings(spark):
    blocks = [readings.Read("kv", label="Dose 12", value="99 mg"), readings.Read("table", cells=(("a", "5.1"), ("b", "7.7")))]
    pool = anchoring.Pool([(0, "12"), (0, "5.1"), (0, "7.8")])
    out, items, counts = readings.anchored(blocks, 0, pool)
    assert out[0].value == "mg" and out[1].cells == (("a", "5.1"), ("b", "7.8"))
    assert [(i.kind, i.block, i.field, i.row, i.col, i.start, i.end, i.source, i.token) for i in items] == [("dropped", 0, "value", -1, -1, 0, 0, None, "99"), ("replaced", 1, "cell", 1, 1, 0, 3, "7.8", "7.7")]
    assert counts == {"total": 4, "exact": 2, "dropped": 1, "replaced": 1}
    flagged, items, _ = readings.anchored(blocks, 0, anchoring.Pool([(0, "12")]), "flag")
    assert flagged == blocks and [i.kind for i in items] == ["flagged"] * 3 and readings.anchored(blocks, 0, anchoring.Pool([]), "off")[:2] == (blocks, [])
    read = spark.createDataFrame([(1, 0, "text", "Total 15 of 20"), (1, 1, "text", "20")], "page_id long, region long, kind string, reading string")
    lines = spark.createDataFrame([(1, 0, 0, "Total 16"), (1, -1, 1, "20")], "page_id long, region long, ord long, text string")
    assert [(r.kind, r.source, r.token) for r in readings.anchored_pages(read, lines).orderBy("region", "start").collect()] == [("replaced", "16", "15"), ("dropped", None, "20")]
    assert readings.anchored_pages(read, lines, what="counts").first()[1:4] == (3, 1, 0)
    assert [r.text for r in readings.anchored_pages(read, lines, "flag", "blocks").orderBy("region").collect()] == ["Total 15 of 20", "20"]


@pytest.mark.parametrize("turn", [1, -1])
def test_readings_of_one_region_are_taken_in_one_order(spark, turn):
    """12 is an edit from both 1 and 123, 1234 from 123 alone: what happens to 12 doesn't hang on how the rows lie."""
    read = spark.createDataFrame([(1, 0, "text", x) for x in ("12", "1234")][::turn], "page_id long, region long, kind string, reading string").coalesce(1)
    lines = spark.createDataFrame([(1, 0, 0, x) for x in ("1", "123")][::turn], "page_id long, region long, ord long, text string").coalesce(1)
    assert sorted((r.kind, r.token) for r in readings.anchored_pages(read, lines).collect()) == [("ambiguous", "12"), ("replaced", "1234")]


def test_markup():
    md = "# T\n\npara one\nstill one\n\n- a\n  - b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n---"
    assert [(b[0], b[1]) for b in markup.parse_blocks(md)] == [("heading", 1), ("paragraph", 0), ("listItem", 0), ("listItem", 1), ("table", 0), ("rule", 0)]
    assert markup.html_grid("<table><thead><tr><th colspan='2'>H</th></tr><tr><th>a<th>b</tr></thead><tr><td rowspan=2>1<td>2&amp;</tr><tr><td>3</table>") == [["H a", "H b"], ["1", "2&"], ["1", "3"]]
    assert markup.html_grid("no table") == [] and markup.without_repeats("x" + "abcdefgh" * 5) == ("xabcdefgh", True)


def test_geometry_and_statistics(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 25.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    x, y = g.box(*map(F.col, "abcd")), g.box(*map(F.col, "efgh"))
    r = df.select(g.iou(x, y).alias("iou"), g.v_overlap_ratio(x, y).alias("v"), g.match_distance(x, y).alias("d"), g.rounded(F.lit(-2.5), 0).alias("r"), st.map_margin(F.lit(None).cast("double")).alias("m"), F.size(g.word_boxes(F.lit("ab c"), x)).alias("w"), g.char_boxes(F.lit("ab"), x)[1]["x0"].alias("cx")).first()
    assert (round(r.iou, 4), r.v, r.d, r.r, r.m, r.w, r.cx) == (round(25 / 275, 4), 0.5, 40.0, -2.0, 1.0, 2, 5.0)
    pages = spark.createDataFrame([(1, 0, 0.0)], "page_id long, line_id long, y double")
    assert spatial.orphan_clusters(pages.select("page_id", "line_id", g.box(F.col("y"), F.col("y"), F.col("y") + 1, F.col("y") + 1).alias("box")), F.lit(1.0)).first().cluster == 0


def test_tensors():
    assert tensors.greedy_text(np.eye(4)[[0, 1, 1, 0, 1, 2]], ["", "a", "b", "c"])[0] == "aab"
    cells = tensors.table_cells(["<thead>", "<tr>", "<td", " colspan=\"2\"", ">", "</td>", "</tr>", "</thead>", "<tr>", "<td></td>", "<td></td>", "</tr>"], [])
    assert [(c["row"], c["col"], c["col_span"], c["in_head"]) for c in cells] == [(0, 0, 2, True), (1, 0, 1, False), (1, 1, 1, False)]
    mask = np.zeros((40, 60))
    mask[10:20, 5:45] = 0.9
    ((score, (cx, cy, w, h, _)),) = tensors.text_boxes(mask)
    assert round(score, 3) == 0.9 and (round(cx), round(cy)) == (24, 14) and sorted((w, h))[1] > 39


def test_contracts(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"schema": "g-regions/1", "page_id": 1, "regions": [{"regionKey": "k1", "index": 0, "label": "text", "kind": "text"}], "orphans": []}\n')
    (tmp_path / "r.json").write_text('{"schema": "g-vlm-replay/1", "page_id": 1, "regions": [{"regionKey": "k1", "text": "hello"}]}\n')
    (tmp_path / "bad.json").write_text('{"schema": "g-vlm-replay/1", "page_id": 1, "regions": [{"regionKey": "k2", "text": "hello"}]}\n')
    e = contracts.export_pages(spark, str(tmp_path / "e.json"))
    (row,) = contracts.joined_regions(e, contracts.replay_files(spark, str(tmp_path / "r.json"))).collect()
    assert row.region_key == "k1" and row.reading.text == "hello"
    with pytest.raises(Exception, match="region keys differ"):
        contracts.joined_regions(e, contracts.replay_files(spark, str(tmp_path / "bad.json"))).collect()
    with pytest.raises(Exception, match="expected g-vlm-replay"):
        contracts.replay_files(spark, str(tmp_path / "e.json")).collect()
    (tmp_path / "x.txt").write_text("1,2,3,2,3,4,1,4,TOTAL, 12,50\nshort,line\n")
    (line,) = contracts.receipt_lines(spark, str(tmp_path / "x.txt")).collect()
    assert line.text == "TOTAL, 12,50" and tuple(line.box) == (1.0, 2.0, 3.0, 4.0)
    files = spark.createDataFrame([("a.pdf", 10), ("b.png", 0), ("c.exe", 5)], "path string, length long")
    taken, skipped = contracts.ingest(files, 4)
    assert [(r.path, r.kind, r.ord) for r in taken.collect()] == [("a.pdf", "pdf", 4)] and sorted(r.reason for r in skipped.collect()) == ["empty", "unknown type"]


def test_character_labels():
    assert alignment.common("kitten", "sitting") == [False, True, True, True, False, True, False]
    assert alignment.common("a–b", "A-b") == [True] * 3 and alignment.common("", "x") == [False] and alignment.common("x", "") == []


def test_documents_from_regions():
    row = lambda y, *xs: [(x, (84 + 400 * i, y, 184 + 400 * i, y + 16)) for i, x in enumerate(xs)]
    items = document.Region("t", 1, "table", (80, 140, 900, 260), row(150, "Item", "Price", "Day") + row(190, "Tea", "12.50", "Mon") + row(230, "Rice", "7.25", "Tue"))
    title = document.Region("h", 0, "title", (300, 20, 900, 60), [("Order list", (300, 20, 900, 60))])
    text = document.Region("p", 2, "text", (80, 300, 900, 330), [("The list was made by hand and was not checked by anyone so far", (84, 305, 880, 321))])
    pages = document.page_blocks([text, items, title], [("stray line", (84, 600, 200, 616))], 1275)
    assert [r.key for r, _ in pages] == ["h", "t", "p", "orphan-0"]
    blocks, events = document.with_readings(pages, {"t": "| Item | Price |\n| --- | --- |\n| Tea | 12.51 |", "p": "not used"})
    assert [b.kind for b in blocks] == ["heading", "table", "paragraph", "paragraph"] and events == ["replaced"] and blocks[1].text.endswith("| Tea | 12.50 |")
    cells = [pairing.Seg(i, x, *b, 0.0, False) for i, (x, b) in enumerate(row(150, "a", "b") + [("c", (484, 168, 584, 184))])]
    assert assembly.table_of(cells, 16) == [["a", "b c"]]
    near = document.coalesced([text, text._replace(key="q", box=(80, 335, 900, 350)), text._replace(key="r", box=(80, 600, 900, 620))], 16)
    assert [len(r.lines) for r in near] == [2, 1]
