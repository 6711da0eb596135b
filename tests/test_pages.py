"""Page reading: texts cut out of one buffer, only what is asked for, and time in proportion to the page."""

import random
import time

from syllabary.sources import pages as P

PIECES = ("Wort", " zwei Worte ", "\n", " \n\n ", " ", "a b", "x\n y", "", "&lt;b&gt;", "ä  ö")


def rendered(parts):
    """Text of (is text, characters) pieces as lines: squeezed, blank ones dropped; and its words."""
    words = [p.strip() for told, p in parts if told and p.strip()]
    lines = [" ".join(x.split()) for x in "".join(p for _, p in parts).split("\n")]
    return "\n".join(x for x in lines if x), " ".join(words), "".join(words), sum(1 for w in words for x in w.split("\n") if x.strip())


def test_spans_cut_what_the_pieces_say():
    rng = random.Random(1)
    for _ in range(60):
        parser, want, html = P._Elements(), [], []

        def grow(depth):
            tag = rng.choice(("b", "span", "div", "td"))
            html.append(f"<{tag}>")
            parts = []
            for _ in range(rng.randrange(4)):
                if depth and rng.random() < 0.4:
                    inner_tag, inner = grow(depth - 1)
                    parts += [(False, "\n" if inner_tag in P.BLOCK_TAGS else " "), *inner]
                elif rng.random() < 0.2:
                    html.append("<!--note\nmore-->")
                    parts.append((False, "note\nmore"))
                else:
                    piece = rng.choice(PIECES)
                    html.append(f"{piece}<i></i>")  # an element between them keeps two pieces apart
                    parts += [(True, piece.replace("&lt;", "<").replace("&gt;", ">")), (False, " ")]
            html.append(f"</{tag}>")
            want.append((tag, rendered(parts)))
            return tag, parts

        grow(4)
        parser.feed("".join(html))
        rows = parser.finish()
        assert [e["tag"] for e in rows] == [tag for tag, _ in want]
        for e, (_, texts) in zip(rows, want, strict=True):
            assert tuple(P._value(c, e, parser.buffers) for c in ("text", "flat", "glued", "n_lines")) == texts


def nested(depth):
    return "".join(f"<div><p>level {k} says something</p>" for k in range(depth)) + "<span>end</span>" + "</div>" * depth


def seconds(depth):
    best = 1e9
    for _ in range(3):
        started = time.process_time()
        parser = P._Elements()
        parser.feed(nested(depth))
        parser.finish()
        best = min(best, time.process_time() - started)
    return best


def test_reading_is_linear_in_the_page():
    assert seconds(8000) < 8 * seconds(2000) + 0.05  # four times the page; the square would be sixteen


def test_only_what_is_asked_for_is_sent(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>A <b>1</b></h1><a href='x'>t</a><div>plain</div>"), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    asked = P.elements(pages, P.headers)
    assert asked.columns == ["page_id", "node", "tag", "glued"]
    assert [tuple(r) for r in asked.collect()] == [("1", 0, "h1", "A1")]
    assert [tuple(r)[:2] for r in P.headers(P.elements(pages, P.headers, P.links)).collect()] == [("1", "A1")]
    assert {r["tag"] for r in P.elements(pages).collect()} == {"h1", "b", "a", "div"}


def test_plain_tags_are_cut_at_once_and_say_what_the_parser_says():
    pieces = (
        '<div class="tbdata">', '<table summary="S">', "<tr>", '<td class="a b" name="n">', "</td>", "</tr>", "</table>", "</div>", "<br/>", "<b>", "</b>",
        '<a href="/x?P=1&n=2">', "</a>", '<span class="font-semibold break-all">', "</span>", "<dl>", "<dd>", "<dt>", "</dl>", " x ", "a\nb", "&amp; &lt", "\n",
    )
    odd = ("<script>1<2</script>", "<!-- c -->", "<a href='q'>", '<b id="&amp;">', "<", "<BR>", "<title>t</title>")
    rng = random.Random(2)
    cut = 0
    for k in range(400):
        html = "".join(rng.choice(pieces + odd * (k % 2)) for _ in range(rng.randrange(30)))
        fed, read = P._Elements(), P._Elements()
        fed.feed(html)
        columns = [c for c in P._TYPES if c != "page_id"]
        want = [[P._value(c, e, fed.buffers) for c in columns] for e in fed.finish()]
        assert [[P._value(c, e, read.buffers) for c in columns] for e in read.read(html)] == want, html
        cut += P._events(html) is not None
    assert cut >= 200


def test_a_requirement_is_searched_once_for_its_colon(spark):
    from pyspark.sql import functions as F

    from syllabary.functions import text

    rows = spark.createDataFrame([("A: 1\nB (x: y): z\nfree\nA: 2\nallgemein: q",), ("",), (None,), ("A: 1",)], "t string")
    told = rows.select(text.parse_requirements(F.col("t")).alias("m"))
    assert [r["m"] for r in told.collect()] == [{"A": "1 2", "B (x: y)": "z", "allgemein": "free"}, {}, {}, {"A": "1"}]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_scans_read_what_they_need(spark):
    """A scan gives the same over the elements that it needs as over all of them, and room cells read the pages once."""
    from syllabary.plans import reconcile as R

    cell = '<td class="rw-course-room">{}</td>'
    link = '<a name="appointmentRooms" href="r">x</a>'
    html = f"<table><tr>{cell.format(link)}{cell.format(' free ')}{cell.format('')}<td>{link}</td>{cell.format(link + link)}</tr></table>"
    rows = [("1", html), ("1", html), (None, html), ("2", None), ("3", "<h1>1</h1><td class='rw-course-room'>y")]
    pages = spark.createDataFrame(rows, "page_id string, html string")
    for scan in (R.room_cells, R.table_shapes, R.impossible_times):
        few, whole = scan(P.elements(pages, scan)), scan(P.elements(pages))
        assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))
    cells = R.room_cells(P.elements(pages, R.room_cells))
    assert cells.collect()[0].asDict() == {"anchored": 4, "free_text": 6}
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_tag_that_is_written_again_is_not_read_again():
    events = P._events('<b class="x y">1</b><b class="x y">2</b>')
    tags = [tag for tag, _ in events if tag is not None]
    assert tags[0] is tags[2] and tags[1] is tags[3]
    assert [data for _, data in events] == ["", "1", "", "2", ""]


def test_course_rows_read_the_pages_once(spark):
    box = '<div class="tbdata"><b>{}:</b> <span>{}</span></div>'
    left = '<h1>K1 Name</h1><div id="contentlayoutleft">{}</div>'
    rows = [
        ("1", left.format(box.format("Lehrende", "A; B") + box.format("Literatur", "x") + box.format("Literatur", "y"))),
        ("2", "<h1>K2 Bare</h1>"), ("3", left[15:].format(box.format("Lehrende", "C"))), (None, left.format(box.format("Lehrende", "D"))),
        ("4", '<div class="tbdata"><h1>K4 Inside</h1><b>Lehrende</b><span>E</span></div><h1>K5 Later</h1>'),
    ]
    els = P.elements(spark.createDataFrame(rows, "page_id string, html string"), P.course_rows)
    found = P.course_rows(els)
    told = {r["page_id"]: (r["number"], r["name"], r["staff"], r["literature"]) for r in found.collect()}
    assert told == {"1": ("K1", "Name", ["A", "B"], "y"), "2": ("K2", "Bare", [], ""), None: ("K1", "Name", [], ""), "4": ("K4", "Inside", [], "")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_cell_texts_are_made_once_a_cell(spark):
    rows = [("1", '<div><div>Modulabschlussprüfungen</div><table><tr><td>E  1</td><td>am 3.</td><td>P</td><td>Ja</td></tr></table></div>')]
    els = P.elements(spark.createDataFrame(rows, "page_id string, html string"))
    exams = P.exams(els)
    assert [(r["name"], r["date_text"], r["staff"], r["required"]) for r in exams.collect()] == [("E 1", "am 3.", ["P"], True)]
    assert exams._jdf.queryExecution().optimizedPlan().toString().count("array_join(cell_values") == 2


def test_labels_are_sent_without_texts_that_nobody_reads(spark):
    from syllabary.plans import reconcile as R

    html = '<div id="contentlayoutleft"><div><span class="font-semibold break-all">Neu:</span><div>a<br>b</div></div></div>'
    pages = spark.createDataFrame([("1", html)], "page_id string, html string")
    assert P.elements(pages, P.unknown_labels).columns == ["page_id", "node", "tag", "area", "label"]
    labels = P.module_labels(P.elements(pages, P.unknown_labels))
    assert [r["message"] for r in P.unknown_labels(labels, P.MODULE_LABELS).collect()] == ["Neu"]
    labels = P.module_labels(P.elements(pages, R.label_frequencies))
    assert [tuple(r) for r in R.label_frequencies(labels, P.MODULE_LABELS).collect()] == [("Neu", 1, False, "a\nb")]


def labelled(label, value):
    return f'<div><span class="font-semibold break-all">{label}:</span> <div>{value}</div></div>'


def test_module_capture_compares_fields_and_counts_rows_page_by_page(spark):
    from syllabary.plans import reconcile as R

    left = '<div id="contentlayoutleft">{}</div>'.format
    exam = "<div><div>Modulabschlussprüfungen</div><table>{}</table></div>".format
    paper = '<table summary="Leistungen"><tr><td class="rw-detail-reqachieve">{}</td></tr></table>'.format
    row = "<tr><td>E</td><td>am 3.</td><td>P</td><td>Ja</td></tr>"
    rows = [
        ("1", left(labelled("Ziele", "a<!-- n -->b") + labelled("Inhalt", "<b>10</b>LP") + labelled("Neu", "a<!-- n -->b"))),
        ("2", left(labelled("Ziele", "x<!-- n -->y") + labelled("Ziele", "same")) + exam(row + "<tr><td>short</td></tr>") + paper("")),
        ("3", left(labelled("Inhalt", "p<!-- n -->q")) + exam(row) + paper("Paper")),
    ]
    pages = spark.createDataFrame(rows, "page_id string, html string")
    want = {
        "duplicate_labels": 1, "unreadable_exam_dates": 0, "changed_fields": 2, "changed_fields: Ziele": 1, "changed_fields: Inhalt": 1, "exam_raw_rows": 3,
        "exam_rows": 2, "exam_count_mismatches": 1, "achievement_raw_rows": 2, "achievement_rows": 1, "achievement_count_mismatches": 1,
    }
    for els in (P.elements(pages, R.module_capture), P.elements(pages)):
        assert {r["what"]: r["n"] for r in R.module_capture(els).collect()} == want
    none = R.module_capture(P.elements(pages.where("false"), R.module_capture))
    assert {r["what"]: r["n"] for r in none.collect()} == {k: 0 for k in want if ":" not in k}


def test_lost_requirements_are_told_from_the_page_and_not_from_what_is_stored(spark):
    from syllabary.plans import reconcile as R

    page = f'<div id="contentlayoutleft">{labelled("Teilnahmevoraussetzungen", "{}")}</div>'.format
    rows = [("1", page("A: 1<b>B: 2</b>")), ("2", page("A: 1<br>B (x: y): z<br>free"))]
    els = P.elements(spark.createDataFrame(rows, "page_id string, html string"), R.prerequisite_loss)
    found = {r["page_id"]: tuple(r)[1:] for r in R.prerequisite_loss(P.module_labels(els)).collect()}
    assert found == {"1": (2, 2, ["B"], True), "2": (3, 2, [], False)}
