"""Source against store: what the pages and snapshots hold and what was kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import dates, paths, text
from syllabary.operators.aggregates import counter
from syllabary.operators.ordering import largest
from syllabary.session import checkpointed
from syllabary.sources import pages as P
from syllabary.store import Store


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


# ---- snapshot against stored modules -----------------------------------------------------------------


def snapshot_rows(snapshot: DataFrame) -> DataFrame:
    """Snapshot entries (name, url, path) with number, name and their semesters."""
    header = text.split_header(F.col("name"))
    return snapshot.select(
        header["number"].alias("number"), header["name"].alias("name"), "url", "path",
        paths.semester_nodes(F.col("path")).alias("semesters"),
    )


def _stored_semesters(store: Store) -> DataFrame:
    semesters = store["semester"].select(F.col("id").alias("_sid"), F.col("name").alias("semester"))
    named = store["module_semester"].join(semesters, F.col("semester_id") == F.col("_sid")).select("module_id", "semester")
    modules = store["module"].select(F.col("id").alias("module_id"), "number", "name")
    return modules.join(named, "module_id").select("number", "name", "semester")


def coverage(snapshot: DataFrame, store: Store) -> DataFrame:
    """One row per snapshot entry and semester: ``missing_module``, ``missing_link``, ``linked`` or ``no_semester``."""
    entries = snapshot_rows(snapshot).select("number", "name", "url", F.explode_outer("semesters").alias("semester"))
    modules = store["module"].select(F.col("number").alias("_n"), F.col("name").alias("_m")).distinct()
    stored = _stored_semesters(store).select(
        F.col("number").alias("_sn"), F.col("name").alias("_sm"), F.col("semester").alias("_ss")
    ).distinct()
    joined = entries.join(modules, (F.col("number") == F.col("_n")) & (F.col("name") == F.col("_m")), "left").join(
        stored,
        (F.col("number") == F.col("_sn")) & (F.col("name") == F.col("_sm")) & (F.col("semester") == F.col("_ss")),
        "left",
    )
    status = (
        F.when(F.col("semester").isNull(), "no_semester")
        .when(F.col("_n").isNull(), "missing_module")
        .when(F.col("_ss").isNull(), "missing_link")
        .otherwise("linked")
    )
    return joined.select("number", "name", "url", "semester", status.alias("status"))


def semester_histograms(snapshot: DataFrame, store: Store) -> DataFrame:
    """(semester, in_snapshot, in_store): entries and stored links per semester, 0 where a side has none."""
    source = snapshot_rows(snapshot).select(F.explode("semesters").alias("semester"))
    left = counter(source, "semester", name="in_snapshot")
    right = counter(_stored_semesters(store), "semester", name="in_store")
    return left.join(right, "semester", "full").select(
        "semester", F.coalesce("in_snapshot", F.lit(0)).alias("in_snapshot"), F.coalesce("in_store", F.lit(0)).alias("in_store")
    )


def under_linked(snapshot: DataFrame, store: Store) -> DataFrame:
    """Modules found in several semesters but linked to fewer."""
    source = snapshot_rows(snapshot).select("number", "name", F.explode("semesters").alias("semester")).distinct()
    found = counter(source, "number", "name", name="found")
    stored = counter(_stored_semesters(store).distinct(), "number", "name", name="stored")
    joined = found.join(stored, ["number", "name"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return joined.where("found > 1 and stored < found")


def path_retention(snapshot: DataFrame, store: Store) -> DataFrame:
    """(number, name, found, stored): distinct snapshot paths and stored paths per snapshot module."""
    source = snapshot_rows(snapshot).select("number", "name", F.explode("path").alias("group")).distinct()
    found = counter(source, "number", "name", name="found")
    per_module = counter(store["module_path"], "module_id", name="stored")
    modules = store["module"].select(F.col("id").alias("module_id"), "number", "name")
    stored = modules.join(per_module, "module_id").select("number", "name", "stored")
    return found.join(stored, ["number", "name"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


def path_losses(retention: DataFrame, k: int | None = None) -> DataFrame:
    """Modules storing fewer paths than were found, the largest loss first."""
    lost = retention.where("found > stored").withColumn("lost", F.col("found") - F.col("stored"))
    ordered = lost.orderBy(F.col("lost").desc(), "number", "name")
    return ordered.limit(k) if k else ordered


# ---- sessions --------------------------------------------------------------------------------------


def event_keys(sessions: DataFrame, course: str = "course") -> DataFrame:
    """Session rows per (event_date, start_min, end_min, room) with the number of rows and of courses.

    Distinct courses are counted over combined (key, course) rows, so a slot that holds a third of all
    sessions is spread by course first.
    """
    room = F.coalesce("room", F.lit("")).alias("room")
    per_course = sessions.groupBy("event_date", "start_min", "end_min", room, course).agg(F.count(F.lit(1)).alias("_rows"))
    return per_course.groupBy("event_date", "start_min", "end_min", "room").agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_courses")
    )


def event_collisions(keys: DataFrame) -> DataFrame:
    """One row: sessions, distinct keys, keys shared by courses, rows that a merge by key folds away."""
    bare = F.col("room") == ""
    return keys.agg(
        F.sum("n_rows").alias("sessions"), F.coalesce(F.sum(F.when(bare, F.col("n_rows"))), F.lit(0)).alias("without_room"),
        F.count(F.lit(1)).alias("keys"), _count(F.col("n_courses") > 1, "shared_keys"),
        _count((F.col("n_courses") > 1) & bare, "shared_without_room"),
        (F.sum("n_rows") - F.count(F.lit(1))).alias("folded_rows"),
        F.coalesce(F.sum(F.when(bare, F.col("n_rows") - 1)), F.lit(0)).alias("folded_without_room"),
    )


def top_collisions(keys: DataFrame, k: int = 15) -> DataFrame:
    return largest(keys.where("n_courses > 1"), "n_courses", k, "event_date", "start_min", "end_min", "room")


def raw_session_rows(els: DataFrame) -> DataFrame:
    """(page_id, raw_rows, empty cells) counted from the named cells, without the session rules."""
    cells = els.where("tag = 'td' and tr is not null")

    def empty(name: str) -> Column:
        return (F.max((F.col("name") == name).cast("int")) == 1) & (F.max(F.when(F.col("name") == name, F.length("flat"))) == 0)

    rows = cells.groupBy("page_id", "tr").agg(
        F.max((F.col("name") == "appointmentDate").cast("int")).alias("dated"),
        empty("appointmentDate").alias("no_date"), empty("appointmentTimeFrom").alias("no_start"),
        empty("appointmentDateTo").alias("no_end"),
    ).where("dated = 1")
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("raw_rows"), _count(F.col("no_date"), "empty_date"),
        _count(F.col("no_start"), "empty_start"), _count(F.col("no_end"), "empty_end"),
    )


def event_detection(els: DataFrame) -> DataFrame:
    """Per page with session rows: raw rows, kept rows, NULL fields of kept rows and a verdict."""
    els = checkpointed(els.where("tag = 'td' and tr is not null"))  # pages are read once
    kept = P.sessions(els).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("kept"), _count(F.col("event_date").isNull(), "null_date"),
        _count(F.col("start_min").isNull(), "null_start"), _count(F.col("end_min").isNull(), "null_end"),
    )
    joined = raw_session_rows(els).join(kept, "page_id", "full")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in joined.columns if c != "page_id"}
    verdict = (
        F.when((F.col("raw_rows") > 0) & (F.col("kept") == 0), "none_kept")
        .when(F.col("kept") < F.col("raw_rows"), "some_dropped")
        .otherwise("ok")
    )
    return joined.withColumns(zeros).withColumn("verdict", verdict)


# ---- captured fields ---------------------------------------------------------------------------------


def duplicate_labels(labels: DataFrame) -> DataFrame:
    return counter(labels, "page_id", "label").where("n > 1")


def module_capture(els: DataFrame) -> DataFrame:
    """Totals: repeated labels, raw and extracted exam and achievement rows, pages where these differ in number, unreadable exam
    dates, and fields stored otherwise than the page has them, in all and for each label that has some."""
    els = checkpointed(els)  # pages are read once, and the counts read their columns of the elements
    changed = checkpointed(counter(module_field_capture(els), "label"))
    raw = els.where("tag = 'tr' and tbl is not null")
    kinds = {
        "exam_raw_rows": raw.where(F.col("heading") == "Modulabschlussprüfungen"), "exam_rows": P.exams(els),
        "achievement_raw_rows": raw.where(F.col("summary") == "Leistungen"), "achievement_rows": P.achievements(els),
    }
    rows = None
    for kind, df in kinds.items():
        ones = df.select("page_id", *[F.lit(int(k == kind)).alias(k) for k in kinds])
        rows = ones if rows is None else rows.unionByName(ones)
    pages = rows.groupBy("page_id").agg(*[F.sum(k).alias(k) for k in kinds])
    totals = pages.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds],
        _count(F.col("exam_raw_rows") != F.col("exam_rows"), "exam_count_mismatches"),
        _count(F.col("achievement_raw_rows") != F.col("achievement_rows"), "achievement_count_mismatches"),
    )
    parts = {
        "duplicate_labels": duplicate_labels(P.module_labels(els)).agg(F.count(F.lit(1)).alias("n")),
        "unreadable_exam_dates": unreadable_exam_dates(els).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        "changed_fields": changed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
    }
    by_label = changed.select(F.concat(F.lit("changed_fields: "), "label").alias("what"), "n")
    return _named_counts(parts).unionByName(totals.unpivot([], totals.columns, "what", "n")).unionByName(by_label)


def _named_counts(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("what"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def field_capture(labels: DataFrame, known: dict) -> DataFrame:
    """Known labels whose text is there but was stored empty or as something that is no part of it.

    Columns page_id, label, raw (independent text) and stored.
    """
    raw, stored = F.coalesce("raw", F.lit("")), F.coalesce("stored", F.lit(""))
    wrong = ((raw != "") & (stored == "")) | ((stored != "") & ~F.contains(raw, stored) & ~F.contains(stored, raw))
    return labels.where(F.col("label").isin(list(known)) & wrong)


def module_field_capture(els: DataFrame) -> DataFrame:
    """Independent text of the last label of a name against the text that is stored for it, both without white space, which the two
    set in different places."""
    last = P.last_labels(P.module_labels(els), "value", "flat")

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)\s+", "")

    told = [
        F.when(F.col(field).isNotNull(), F.struct(F.lit(label).alias("label"), F.col(field)["flat"].alias("raw"), F.col(field)["value"].alias("stored")))
        for label, field in P.MODULE_LABELS.items()
    ]
    found = last.select("page_id", F.explode(F.array(*told)).alias("f")).where("f is not null").select("page_id", "f.*")
    return field_capture(found.withColumns({"raw": bare(F.col("raw")), "stored": bare(F.col("stored"))}), P.MODULE_LABELS)


def course_field_capture(els: DataFrame) -> DataFrame:
    """Whole text of a label row (without its label) against the one element the field is read from."""
    labels = P.course_labels(els)
    boxes = els.where("tag = 'div' and node = box").select("page_id", F.col("node").alias("_box"), F.col("text").alias("_all"))
    joined = labels.join(boxes.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.col("node") == F.col("_box")))
    from_span = F.col("label").isin([k for k, (_, tag) in P.COURSE_LABELS.items() if tag == "span"])
    stored = F.when(from_span, F.col("span")).otherwise(F.col("div"))
    raw = F.trim(F.regexp_replace(F.col("_all"), r"^[^\n:]*:?\s*", ""))
    compared = joined.select("page_id", "label", F.when(F.contains("_all", F.coalesce(stored, F.lit(""))), stored).otherwise(raw).alias("raw"), stored.alias("stored"))
    return field_capture(compared, P.COURSE_LABELS)


def course_capture(els: DataFrame) -> DataFrame:
    """Totals: multi-room rows, dates and times that are there but unreadable, suspect staff, changed fields."""
    els = checkpointed(els)  # pages are read once
    rows = P.sessions(els)
    suspect = rows.select(F.explode("staff").alias("s")).where(
        F.col("s").rlike("(?U)" + text.TIME_ONLY) | F.col("s").rlike("(?U)" + text.DATE_ONLY) | F.col("s").contains("Termin")
    )
    bad_date = (F.col("date_text") != "") & F.col("event_date").isNull()
    bad_time = ((F.col("start_text") != "") & F.col("start_min").isNull()) | ((F.col("end_text") != "") & F.col("end_min").isNull())
    totals = rows.agg(
        F.count(F.lit(1)).alias("session_rows"), _count(F.col("n_rooms") > 1, "multi_room_rows"),
        _count(bad_date, "unreadable_dates"), _count(bad_time, "unreadable_times"),
    )
    parts = {c: totals.select(F.col(c).alias("n")) for c in totals.columns}
    parts["suspect_staff"] = suspect.agg(F.count(F.lit(1)).alias("n"))
    parts["changed_fields"] = course_field_capture(els).agg(F.count(F.lit(1)).alias("n"))
    parts["course_pages"] = P.course_rows(els).agg(F.count(F.lit(1)).alias("n"))
    return _named_counts(parts)


def _exam_date_cells(els: DataFrame) -> DataFrame:
    cells = els.where(F.col("tag") == "td").where(F.array_contains("classes", "rw-detail-date"))
    value = F.regexp_replace(text.single_line(F.col("flat")), r"^Datum\s+", "")
    return cells.select("page_id", value.alias("value")).where(F.col("value") != "")


def unreadable_exam_dates(els: DataFrame) -> DataFrame:
    """(value, n) of exam date cells that hold neither a slot nor the placeholder."""
    bad = _exam_date_cells(els).where((F.col("value") != dates.NO_APPOINTMENT) & ~dates.is_exam_slot(F.col("value")))
    return counter(bad, "value")


def multi_room_rows(els: DataFrame) -> DataFrame:
    """(rooms, n): room cells with more than one room."""
    cells = els.where((F.col("tag") == "td") & (F.array_contains("classes", "rw-course-room") | F.coalesce(F.col("name") == "appointmentRooms", F.lit(False))))
    filled = F.filter("cell_values", lambda v: v != "")
    several = cells.where(F.size(filled) > 1)
    return counter(several.select(F.array_join(filled, " | ").alias("rooms")), "rooms")


def anomalies(els: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    return {
        "exam_dates": largest(unreadable_exam_dates(els), "n", k, "value"),
        "multi_rooms": largest(multi_room_rows(els), "n", k, "rooms"),
        "headers": P.headers(els).where("malformed").select("page_id", "header"),
    }


# ---- rooms -------------------------------------------------------------------------------------------


def recoverable_locations(store: Store, room_rows: DataFrame) -> DataFrame:
    """Name-only locations of which a detail page is at hand."""
    names = room_rows.select(F.trim("name").alias("_name")).where("_name <> ''").distinct()
    bare = store["location"].where(text.is_blank(F.trim("external_id")))
    return bare.join(names, F.trim(F.col("name")) == F.col("_name"), "left_semi")


def events_on_bare_locations(store: Store) -> DataFrame:
    """One row: events on name-only locations and how many such locations are used."""
    bare = store["location"].where("external_id = ''").select(F.col("id").alias("_loc"))
    used = store["event"].groupBy("location_id").agg(F.count(F.lit(1)).alias("_n"))
    hit = used.join(bare, F.col("location_id") == F.col("_loc"))
    return hit.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("locations"))


def room_cells(els: DataFrame) -> DataFrame:
    """One row: session room cells with a detail link and with free text only."""
    room = (F.col("tag") == "td") & F.coalesce(F.array_contains("classes", "rw-course-room"), F.lit(False))
    anchor = (F.col("tag") == "a") & F.coalesce(F.col("name") == "appointmentRooms", F.lit(False))
    # The cell and the anchors in it name the same cell, so one pass over the pages brings them together.
    cells = els.where(F.col("td").isNotNull() & (room | anchor)).groupBy("page_id", "td").agg(
        F.count(F.when(room, 1)).alias("cells"), F.count(F.when(room & (F.col("flat") != ""), 1)).alias("filled"),
        F.count(F.when(anchor, 1)).alias("anchors"),
    )
    # Pages without a key are not told apart, so their anchors belong to no cell.
    anchored = F.col("page_id").isNotNull() & (F.col("anchors") > 0)

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    return cells.agg(total("cells", anchored).alias("anchored"), total("filled", ~anchored).alias("free_text"))


# ---- texts -------------------------------------------------------------------------------------------


def prerequisite_loss(labels: DataFrame) -> DataFrame:
    """Requirement texts (page_id, value, pieces): lines, lines with a context, contexts lost, contexts swallowed.

    Lines and the contexts that are to be expected come from the ``pieces`` as the page has them, not from the text that is stored. A
    context is swallowed if the stored text of another one still holds it with its colon.
    """
    lines = F.filter(F.transform(F.split("pieces", "\n"), text.squeeze), lambda x: x != "")
    expected = F.filter(F.transform("_lines", lambda x: text._cut_requirement(x)["key"]), lambda k: k.isNotNull())
    stored = text.parse_requirements(F.col("value"))
    rows = labels.withColumns({"_lines": lines, "_stored": stored}).withColumn("_expected", F.transform(expected, text.squeeze))
    keys = F.map_keys("_stored")
    swallowed = F.exists(
        F.map_values("_stored"), lambda v: F.exists("_expected", lambda k: (k != "") & F.contains(v, F.concat(k, F.lit(":"))))
    )
    return rows.select(
        "page_id", F.size("_lines").alias("n_lines"), F.size(F.filter("_lines", lambda x: x.contains(":"))).alias("colon_lines"),
        F.filter("_expected", lambda k: ~F.array_contains(keys, k)).alias("lost_keys"), swallowed.alias("swallowed"),
    )


def separator_verdicts(labels: DataFrame, stored: Column) -> DataFrame:
    """(label, verdict, n): is a stored text the structured one, glued, flattened or something else?

    ``labels`` has the renderings value (structured), flat, glued and n_lines of the element.
    """
    kept = F.trim(F.translate(F.coalesce(stored, F.lit("")), " ", " "))
    one = text.single_line(kept)
    glued, flat = text.single_line(F.col("glued")), text.single_line(F.col("flat"))
    verdict = (
        F.when(kept == F.col("value"), "OK")
        .when((glued == one) & (flat != glued), "GLUED")
        .when(flat == one, F.when(F.col("n_lines") > 1, "FLATTENED").otherwise("OK"))
        .otherwise("MISMATCH")
    )
    return counter(labels.withColumn("verdict", verdict), "label", "verdict")


def impossible_times(els: DataFrame) -> DataFrame:
    """(page_id, kind, value, n): clock times and dates in appointment cells that cannot exist."""
    named = F.col("name").isin("appointmentTimeFrom", "appointmentTimeTo", "appointmentDateTo", "appointmentDate")
    cells = els.where((F.col("tag") == "td") & (F.coalesce(named, F.lit(False)) | F.array_contains("classes", "rw-detail-date")))
    values = cells.select("page_id", text.single_line(F.col("flat")).alias("value"))
    return bad_moments(values)


def bad_moments(values: DataFrame) -> DataFrame:
    """The same over any (page_id, value) rows."""
    clocks = values.select("page_id", F.explode(F.regexp_extract_all("value", F.lit(r"\d{1,2}:\d{2}"), F.lit(0))).alias("value"))
    hour, minute = F.substring_index("value", ":", 1).cast("int"), F.substring_index("value", ":", -1).cast("int")
    bad_clock = clocks.where((hour > 23) | (minute > 59)).withColumn("kind", F.lit("time"))
    days = values.select("page_id", F.regexp_extract("value", r"(?U)\d{1,2}\.\s*\w{3}\.?\s*\d{4}", 0).alias("value"))
    bad_day = days.where((F.col("value") != "") & dates.german_date(F.col("value")).isNull()).withColumn("kind", F.lit("date"))
    return counter(bad_clock.unionByName(bad_day), "page_id", "kind", "value")


def label_frequencies(labels: DataFrame, known: dict, value: str = "value") -> DataFrame:
    """(label, n, mapped, example): how often each label occurs, whether it is read, and its first value."""
    mapped = F.col("label").isin(list(known))
    return labels.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, F.struct("page_id", "node")).alias("example")
    ).select("label", "n", mapped.alias("mapped"), "example")


def table_shapes(els: DataFrame) -> DataFrame:
    """(heading, class, n): cell classes below each table heading."""
    cells = els.where("tag = 'td' and tbl is not null").select("heading", F.explode("classes").alias("class"))
    return counter(cells, "heading", "class")


def course_exam_dates(els: DataFrame) -> DataFrame:
    """(date_text, n, pages) of the exam tables on course pages."""
    rows = P.course_exams(els)
    return rows.groupBy("date_text").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))
