"""Answer sheets: layout folds, manifests, boxes, page selections. Lengths are PDF points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions import text as T

#: Fixed values of the printed sheet, in points (72 an inch).
MM = 72 / 25.4
PAGE_W, PAGE_H = 210 * MM, 297 * MM
MARGIN, TOP_INSET, QR_SIZE = 20 * MM, 6 * MM, 18 * MM
CONTINUATION_GAP = QR_SIZE + 10 * MM
TITLE_GAP, LINE_GAP, TEXT_BOTTOM_GAP = 5 * MM, 4 * MM, 2 * MM
ANSWER_H = (10 + 4 * 5 + 3) * MM
SPACING, HEADER_H = 4 * MM, (8 + 12 + 22 + 8) * MM
MARK, MARK_GAP = 4 * MM, 2 * MM
TEXT_W = PAGE_W - 2 * MARGIN


def box_to_pixels(x: Column, y_bottom: Column, w: Column, h: Column, page_h: Column, dpi: int = 200) -> Column:
    """struct(left, upper, right, lower): a box with its origin at the bottom left as a crop from the top left."""
    px = lambda v: (v * (dpi / 72.0)).cast("int")
    return F.struct(px(x).alias("left"), px(page_h - y_bottom - h).alias("upper"), px(x + w).alias("right"), px(page_h - y_bottom).alias("lower"))


def fiducials(width: Column, height: Column, area_top: Column | None = None) -> Column:
    """The four marker boxes beside the question area."""
    left, right = F.greatest(F.lit(0.0), F.lit(MARGIN - MARK - MARK_GAP)), F.least(width - MARK, width - MARGIN + MARK_GAP)
    top = height - MARGIN - MARK
    if area_top is not None:
        top = F.least(F.coalesce(area_top - MARK, top), top)
    top = F.greatest(top, F.lit(MARGIN + 2 * MARK))
    one = lambda x, y: F.struct(x.alias("x_pt"), y.alias("y_pt"), F.lit(MARK).alias("width_pt"), F.lit(MARK).alias("height_pt"))
    return F.array(one(left, F.lit(MARGIN)), one(right, F.lit(MARGIN)), one(left, top), one(right, top))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area of two boxes (x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(small > 0, side("x", "w") * side("y", "h") / small).otherwise(0.0)


def dedupe_boxes(boxes: DataFrame, keys: list[str], most: float = 0.65) -> DataFrame:
    """Per page, boxes (x, y, w, h) from top to bottom, each kept unless it overlaps a kept one by more."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", "w", "h")))
    nothing = F.array().cast("array<struct<y: int, x: int, w: int, h: int>>")
    keep = lambda kept, b: F.when(F.exists(kept, lambda k: overlap_ratio(b, k) > most), kept).otherwise(F.concat(kept, F.array(b)))
    listed = boxes.groupBy(*keys).agg(order.alias("_boxes"))
    return listed.select(*keys, F.posexplode(F.aggregate("_boxes", nothing, keep)).alias("pos", "b")).select(*keys,
        F.col("pos").alias("index"), "b.x", "b.y", "b.w", "b.h")


def region_candidates(boxes: DataFrame) -> DataFrame:
    """Boxes large and low enough on their page (page_w, page_h), padded and cut to it."""
    c = F.col
    big = (c("w") * c("h") >= c("page_w") * c("page_h") * 0.025) & (c("w") >= c("page_w") * 0.35) & (c("h") >= c("page_h") * 0.05) & (c("y") >= c("page_h") * 0.10)
    px, py = (c("w") * 0.02).cast("int"), (c("h") * 0.04).cast("int")
    x, y = F.greatest(F.lit(0), c("x") - px), F.greatest(F.lit(0), c("y") - py)
    right, low = F.least(c("page_w"), c("x") + c("w") + px), F.least(c("page_h"), c("y") + c("h") + py)
    return boxes.where(big).withColumn("_b", F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))).drop("x",
        "y", "w", "h").select("*", "_b.*").drop("_b")


def overlapping_pairs(boxes: DataFrame, keys: list[str], most: float = 0.65) -> DataFrame:
    """Pairs of boxes (box_id, x, y, w, h; w and h above 0) of a page that overlap by more of the smaller one, most not below 0.

    Boxes lie in grids whose cells double from level to level. A box lives on the first level with cells as
    large as itself, so it touches four of them at most, and is looked for on that level and on the larger
    levels that its page has. A pair is formed in the cell that holds the upper left corner of the common
    part, on the level of the larger box: once, and only there. Boxes of no area overlap nothing.
    """
    page = F.array_sort(F.collect_set("_level"))
    sized = boxes.where("w > 0 and h > 0").select(*keys, "box_id", F.struct("x", "y", "w", "h").alias("box"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("w", "h").cast("double")) - 1e-9)).cast("int").alias("_level"))
    levels = sized.groupBy(*keys).agg(page.alias("_levels"))
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")

    def spread(rows: DataFrame, level: str) -> DataFrame:
        span = lambda p, s: F.sequence(cell(F.col(f"box.{p}"), F.col(level)), cell(F.col(f"box.{p}") + F.col(f"box.{s}"), F.col(level)))
        return rows.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))

    at = [*keys, "_level", "_cx", "_cy"]
    homes = spread(sized, "_level").select(*at, F.col("box_id").alias("_home"), F.col("box").alias("a"))
    on = sized.withColumnRenamed("_level", "_own").join(levels, keys)
    looked = on.select(*keys, "box_id", "box", "_own", F.explode(F.filter("_levels", lambda v: v >= F.col("_own"))).alias("_level"))
    guests = spread(looked, "_level").select(*at, F.col("box_id").alias("_guest"), F.col("box").alias("b"), "_own")
    corner = (cell(F.greatest("a.x", "b.x"), F.col("_level")) == F.col("_cx")) & (cell(F.greatest("a.y", "b.y"), F.col("_level")) == F.col("_cy"))
    once = (F.col("_own") < F.col("_level")) | (F.col("_home") < F.col("_guest"))
    met = homes.join(guests, at).where(corner & once & (F.col("_home") != F.col("_guest")) & (overlap_ratio(F.col("a"), F.col("b")) > most))
    return met.select(*keys, F.least("_home", "_guest").alias("a_id"), F.greatest("_home", "_guest").alias("b_id"))


def paginate(questions: DataFrame, width_pt: float | None = None) -> DataFrame:
    """exam_id, question_number, page, y_bottom_pt, height_pt, pages: questions laid in order on A4 sheets.

    A block that no longer fits begins a new sheet; the first sheet has the header, later ones a gap.
    Lines are wrapped by characters, or by the widths of the font where a width in points is given
    (that of the text column is TEXT_W).
    """
    text = F.col("question_text")
    lines = F.size(T.wrap_text(text) if width_pt is None else T.wrap_by_width(text, width_pt))
    listed = questions.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("question_number", lines.alias("lines")))).alias("qs"))
    first, later = PAGE_H - MARGIN - TOP_INSET - HEADER_H - 6 * MM, PAGE_H - MARGIN - TOP_INSET - CONTINUATION_GAP
    kind = "array<struct<question_number: int, page: int, y_bottom_pt: double>>"

    def place(acc: Column, q: Column) -> Column:
        text = q["lines"] * LINE_GAP + TITLE_GAP + TEXT_BOTTOM_GAP
        new = acc["y"] - (text + ANSWER_H + SPACING) < MARGIN
        page, y = F.when(new, acc["page"] + 1).otherwise(acc["page"]), F.when(new, F.lit(later)).otherwise(acc["y"])
        box = F.struct(q["question_number"].cast("int").alias("question_number"), page.alias("page"), (y - text - ANSWER_H).alias("y_bottom_pt"))
        return F.struct((y - text - ANSWER_H - SPACING).alias("y"), page.alias("page"), F.concat(acc["out"], F.array(box)).alias("out"))

    start = F.struct(F.lit(first).alias("y"), F.lit(1).alias("page"), F.array().cast(kind).alias("out"))
    placed = listed.select("exam_id", F.aggregate("qs", start, place).alias("r")).select("exam_id", F.explode("r.out").alias("b"),
        F.col("r.page").alias("pages"))
    return placed.select("exam_id", "b.question_number", "b.page", "b.y_bottom_pt", F.lit(ANSWER_H).alias("height_pt"), "pages")


#: Exams and students of a plan are dealt over so many parts each; a task joins one part of either.
PLAN_PARTS = 8


def sheet_plan(exams: DataFrame, students: DataFrame, layout: DataFrame) -> DataFrame:
    """Every student of an exam's class with every sheet of the exam; physical_index counts an exam's sheets by registration from 0.

    Students are placed once for the exams of one class (or of the same several classes), not once for each exam. An
    exam's numbers follow from these places, so the plan's rows, exams times students, are neither sorted nor shuffled.
    Rows that agree in registration and student_id have all their first sheets before their second ones.
    """
    sheets = layout.groupBy("exam_id").agg(F.max("pages").alias("pages"))
    asked = exams.groupBy("exam_id").agg(F.array_sort(F.collect_list("class_id")).alias("_classes")).join(sheets, "exam_id")
    kinds = asked.groupBy("_classes").agg(F.min("exam_id").alias("_kind"))
    person = ["_kind", "registration_number", "student_id"]
    people = kinds.select("_kind", F.explode("_classes").alias("class_id")).join(students, "class_id").groupBy(*person).agg(F.count("*").alias("_copies"))
    earlier = Window.partitionBy("_kind").orderBy("registration_number", "student_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = people.withColumn("_before", F.coalesce(F.sum("_copies").over(earlier), F.lit(0)))
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(PLAN_PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PLAN_PARTS - 1)))
    own = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    own = own.withColumn("_s", part("student_id", "registration_number")).withColumn("_e", every)
    sides = asked.join(kinds, "_classes").select("_kind", "exam_id", "pages", F.explode(F.sequence(F.lit(1), "pages")).alias("page_in_student"))
    sides = sides.withColumn("_e", part("exam_id")).withColumn("_s", every)
    index = F.col("_before") * F.col("pages") + (F.col("page_in_student") - 1) * F.col("_copies") + F.col("_copy")
    return own.join(sides, ["_kind", "_e", "_s"]).select("exam_id", "student_id", "registration_number", "page_in_student",
        F.col("pages").alias("total_pages_for_student"), index.cast("int").alias("physical_index"))


MANIFEST = "struct<version: int, pages: array<struct<physical_index: int, exam_id: string, student_id: string, page_in_student: int, total_pages_for_student: int, boxes: array<struct<question_number: int, x_pt: double, y_bottom_pt: double, width_pt: double, height_pt: double>>>>>"


def manifest_boxes(exams: DataFrame) -> DataFrame:
    """One row per page and box of layout manifests (exam_id, manifest text); the last of several pages with one index wins."""
    pages = exams.select("exam_id", F.posexplode(F.from_json("manifest", MANIFEST)["pages"]).alias("pos", "p"))
    last = pages.groupBy("exam_id", F.col("p.physical_index").alias("physical_index")).agg(F.max_by("p", "pos").alias("p"))
    return last.select("exam_id", "physical_index", F.col("p.student_id").alias("manifest_student"),
        F.explode_outer("p.boxes").alias("b")).select("exam_id", "physical_index", "manifest_student", "b.*")


def page_questions(pages: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions to read on each page (exam_id, page_id, page_index): those of its manifest's boxes, or all of the exam without a manifest."""
    known = boxes.select("exam_id", F.col("physical_index").alias("page_index"), "question_number")
    ids = questions.select("exam_id", "question_number", "question_id")
    mapped = pages.join(known, ["exam_id", "page_index"]).join(ids, ["exam_id", "question_number"]).select("page_id", "question_id",
        F.lit("mapped").alias("mode"))
    free = pages.join(known.select("exam_id", "page_index").distinct(), ["exam_id", "page_index"], "left_anti").join(ids,
        "exam_id").select("page_id", "question_id", F.lit("legacy").alias("mode"))
    return mapped.unionByName(free)


def select_pages(raw: Column, total: Column) -> Column:
    """Sorted distinct pages within 1..total of a list like '1, 3,9'; empty: all. A part that is no number is an error."""
    parts = F.transform(T.split_list(raw), lambda p: p.cast("int"))
    chosen = F.array_sort(F.array_distinct(F.filter(parts, lambda p: (p >= 1) & (p <= total))))
    return F.when(F.size(T.split_list(raw)) == 0, F.sequence(F.lit(1), total)).otherwise(chosen)
