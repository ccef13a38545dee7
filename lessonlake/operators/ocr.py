"""From recognised words to clean, numbered lines and page documents.

Words are rows of a word, or rows of a page with an array of them: (page_no, words array<struct<pos, text, x, y, ..>>), as a page's file
has them. A page's words are one row while its lines are made, so such pages need no shuffle until lines are numbered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from lessonlake.functions import text as T
from lessonlake.operators.ordered import fold

MIN_NATIVE_WORDS = 8
MIN_NATIVE_LINES = 5
MIN_CONFIDENCE = 35


def _pages(words: DataFrame) -> DataFrame:
    """A row a page, with its words as an array."""
    if "words" in words.columns:
        return words
    return words.groupBy("page_no").agg(F.collect_list(F.struct(*[c for c in words.columns if c != "page_no"])).alias("words"))


def _cut(words: Column, starts: Callable[[Column], Column], line: Callable[[Column, Column], Column]) -> Column:
    """line(words, place) of each run of words that begins at one of starts(words); null without words. Only lines leave the innermost
    function: what a transform gives is copied."""
    run = lambda w, s, a, i: F.slice(w, a + 1, F.coalesce(F.get(s, i + 1), F.size(w)) - a)
    lines = lambda w, s: F.transform(s, lambda a, i: T.let(run(w, s, a, i), lambda l: line(l, i)))
    return T.let(words, lambda w: F.when(F.size(w) > 0, T.let(starts(w), lambda s: lines(w, s))))


def _box(line: Column, at: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """Where a line of words lies; at gives a number of a word as a whole pixel."""
    first = lambda c: F.array_min(F.transform(line, lambda w: at(w[c])))
    extent = lambda c, size: F.array_max(F.transform(line, lambda w: at(w[c]) + at(w[size]))) - first(c)
    return [first("x").alias("x"), first("y").alias("y"), extent("x", "width").alias("width"), extent("y", "height").alias("height")]


def _joined(pages: DataFrame, words: Column, confidence: Callable[[Column], Column], group: list[str], scale: float = 1.0, least: int = 1) -> DataFrame:
    """Lines of words ordered by x, then reading order, without empty ones; boxes scaled and cut to whole pixels; none of pages with
    fewer than least words. All of a line is made in the array: columns that a filter could inline would be computed again at each use."""
    order = [*group, "x", "pos"]
    at = lambda c: c if scale == 1.0 else (c * scale).cast("int")
    clean = lambda w: F.struct(*[w[c].alias(c) for c in order], T.normalize_word(w["text"]).alias("text"), *[w[c].alias(c) for c in ("y", "width", "height")], confidence(w).alias("confidence"))
    cleaned = T.let(words, lambda ws: F.when(F.size(ws) >= least, F.transform(ws, clean))) if least > 1 else F.transform(words, clean)
    ordered = F.array_sort(F.filter(cleaned, lambda w: w["text"] != ""))
    moved = lambda a, b: reduce(or_, [~a[c].eqNullSafe(b[c]) for c in reversed(group)])
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | moved(F.get(w, i), F.get(w, i - 1)))
    line = lambda l, _: F.struct(
        T.normalize_text(F.array_join(l["text"], " ")).alias("text"), F.size(l).alias("n_words"), F.array_min(l["pos"]).alias("pos"), *_box(l, at),
        (F.aggregate(l["confidence"], F.lit(0.0), lambda total, c: total + c) / F.size(l)).alias("confidence"),
    )
    return pages.select("page_no", F.inline(_cut(ordered, starts, line)))


def build_lines(lines: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """The lines that pass the gate, with clean text, rounded confidence and the ready flag."""
    keep = T.should_keep_line(F.col("text"), F.col("n_words"), F.col("confidence"), F.col("width"), F.col("height"), F.lit(page_width), F.lit(page_height))
    return (
        lines.where(keep).withColumn("clean_text", T.clean_ai_text(F.col("text"))).withColumn("confidence", F.bround("confidence", 2))
        .withColumn("ai_ready", T.is_ai_ready(F.col("clean_text")))
        .select("page_no", "pos", "text", "clean_text", "x", "y", "width", "height", "confidence", "ai_ready")
    )


def lines_from_native(words: DataFrame, page_width: int, page_height: int, zoom: float = 2.0) -> DataFrame:
    """Lines of a page's own text layer; pages of fewer than 8 words give none."""
    return build_lines(_joined(_pages(words), F.col("words"), lambda _: F.lit(99.0), ["block_no", "line_no"], zoom, MIN_NATIVE_WORDS), page_width, page_height)


def lines_from_tokens(words: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """Lines of OCR tokens of confidence 35 or more; a confidence that is no number counts as -1."""
    pages = _pages(words)
    numeric = isinstance(pages.schema["words"].dataType.elementType["confidence"].dataType, NumericType)
    number = lambda w: F.coalesce(w["confidence"].cast("double") if numeric else w["confidence"].cast("string").try_cast("double"), F.lit(-1.0))
    sure = F.filter("words", lambda w: number(w) >= MIN_CONFIDENCE)
    return build_lines(_joined(pages, sure, number, ["block_no", "par_no", "line_no"]), page_width, page_height)


def cluster_lines_by_y(words: DataFrame, tolerance: int = 20) -> DataFrame:
    """In reading order, a word joins the line while it is within the tolerance of the y of the line's first word, which never
    moves. Line numbers count dropped lines too."""

    fields = ("pos", "y", "x", "width", "height", "text")
    ordered = F.array_sort(F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in fields])))

    def starts(words: Column) -> Column:
        state = lambda anchor, i, found: F.struct(anchor.cast("double").alias("anchor"), i.alias("i"), found.alias("found"))
        far = lambda s, w: s["anchor"].isNull() | (F.abs(w["y"] - s["anchor"]) >= tolerance)
        step = lambda s, w: F.when(far(s, w), state(w["y"], s["i"] + 1, F.concat(s["found"], F.array(s["i"])))).otherwise(state(s["anchor"], s["i"] + 1, s["found"]))
        return F.aggregate(words, state(F.lit(None), F.lit(0), F.array().cast("array<int>")), step, lambda s: s["found"])

    said = lambda l: F.array_sort(F.transform(l, lambda w: F.struct(w["x"], w["pos"], w["text"].alias("text"))))["text"]
    line = lambda l, i: F.struct((i + 1).alias("line_number"), T.collapse(F.array_join(said(l), " ")).alias("text"), *_box(l))
    lines = _pages(words).select("page_no", F.inline(_cut(ordered, starts, line)))
    return lines.where(~T.drop_bad_line(F.col("text")))


def drop_overlaps(lines: DataFrame) -> DataFrame:
    """Greedy, first in (y, x, pos) order wins: a line goes if a kept one has the same text, or one holds the other
    and the held one is longer than 12, and they stand closer than the larger height."""

    columns = [c for c in lines.columns if c != "page_no"]
    at = {c: i for i, c in enumerate(columns, 1)}

    def step(state: dict, row: tuple) -> list[tuple]:
        y, height, text = row[at["y"]], row[at["height"]], row[at["text"]]
        state["height"] = max(state["height"], height)
        low = text.lower()
        for ky, kh, kept in reversed(state["kept"]):
            if y - ky >= state["height"]:  # rows come by y, so all before are as far away
                break
            if y - ky < max(height, kh) and (low == kept or len(low) > 12 and low in kept or len(kept) > 12 and kept in low):
                return []
        state["kept"].append((y, height, low))
        return [row]

    schema = StructType([lines.schema[c] for c in ("page_no", *columns)])
    return fold(lines, "page_no", ["y", "x", "pos"], columns, lambda: {"height": 0, "kept": []}, step, schema).select(*lines.columns)


def choose_source(native: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per page: native lines where there are at least 5, else OCR lines."""
    every = native.withColumn("source", F.lit("native")).unionByName(tokens.withColumn("source", F.lit("tesseract")))
    found = every.withColumn("n", F.count_if(F.col("source") == "native").over(Window.partitionBy("page_no")))
    return found.where((F.col("source") == "native") == (F.col("n") >= MIN_NATIVE_LINES)).drop("n")


def number_lines(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_no").orderBy("y", "x", "pos")
    return lines.withColumn("line_number", F.row_number().over(w)).withColumn("id", T.line_id("page", F.col("page_no").cast("int"), F.col("line_number")))


def page_documents(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """A document for each page of pages(page_no), also for those without lines."""
    fields = F.struct("line_number", "id", "text", "clean_text", "ai_ready")
    docs = lines.groupBy("page_no").agg(F.array_sort(F.collect_list(fields)).alias("lines"))
    full = pages.select("page_no").join(docs, "page_no", "left").withColumn("lines", F.coalesce("lines", F.array().cast(docs.schema["lines"].dataType)))
    ready = F.filter("lines", lambda x: x["ai_ready"])
    text = lambda a, f: F.array_join(F.transform(a, lambda x: x[f]), "\n")
    return full.select(
        "page_no", "lines", ready.alias("ai_ready_lines"), text("lines", "text").alias("raw_text"), text("lines", "clean_text").alias("clean_text"), text(ready, "clean_text").alias("ai_ready_text"),
    )


def book_index(documents: DataFrame, book_id: str, failed: DataFrame | None = None) -> DataFrame:
    """documents(page_no, lines, ai_ready_lines, source) -> counts, source and file paths of each page; failed pages (page_no, error) stay
    as rows without them."""
    path = lambda kind, end: F.format_string(f"/ocr/books/%s/{kind}/page-%03d.{end}", F.lit(book_id), F.col("page_no").cast("int"))
    ok = documents.select(
        "page_no", path("pages", "json").alias("json"), path("page-images", "png").alias("image"), F.size("lines").alias("n_lines"), F.size("ai_ready_lines").alias("n_ready"),
        F.coalesce("source", F.lit("unknown")).alias("source"), F.lit(None).cast("string").alias("error"),
    )
    return ok if failed is None else ok.unionByName(failed.select("page_no", "error"), allowMissingColumns=True)


def book_header(index: DataFrame, book_id: str, title: str, start: int, end: int, total_pages: int) -> DataFrame:
    """One row: the book, its pages in all and the range that was asked for, with what the index has of it."""
    first, last = max(1, start), total_pages if end <= 0 else min(total_pages, end)
    return index.agg(F.count("*").alias("n_pages"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines")).select(
        F.lit(book_id).alias("book_id"), F.lit(title).alias("title"), F.lit(total_pages).alias("total_pages"), F.lit(first).alias("start_page"), F.lit(last).alias("end_page"), "n_pages", "n_failed", "n_lines",
    )


def normalize_import_lines(lines: DataFrame) -> DataFrame:
    """lines([title, ]page_no, pos, text, confidence, ai_ready, x, y, width, height, bbox, line_number[, clean_text]): the clean text comes
    before the text; nested or flat boxes, half-up rounding, a missing number is 0."""
    box = lambda c: F.floor(F.coalesce(F.col(f"bbox.{c}"), F.col(c), F.lit(0)).cast("double") + 0.5).cast("int").alias(c)
    text = F.coalesce("clean_text", "text") if "clean_text" in lines.columns else F.col("text")
    lines = reduce(lambda df, step: df.withColumn("_text", step(F.col("_text"))), T.OCR_STEPS, lines.withColumn("_text", text))
    said = F.explode(F.when(F.col("_text") != "", F.array("_text")))  # a filter on the text would clean it once more
    out = lines.select(
        *[c for c in ("title",) if c in lines.columns], "page_no", "pos", F.coalesce("line_number", F.col("pos") + 1).alias("line_number"), said.alias("text"), *[box(c) for c in ("x", "y", "width", "height")],
        F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("ai_ready", F.lit(True)).alias("flag"),
    )
    good = out.where((F.col("width") >= 0) & (F.col("height") >= 0))
    return good.withColumn("ai_ready", F.col("flag") & T.is_import_ai_ready(F.col("text"))).drop("flag")


def import_texts(lines: DataFrame, *page: str) -> DataFrame:
    """normalize_import_lines -> a row a page (page_no, or the columns of page): number of lines and the raw, clean (the same) and ready texts, in the file's order."""
    said = F.array_sort(F.collect_list(F.struct("pos", "text", "ai_ready")))
    text = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), "\n")
    page = page or ("page_no",)
    pages = lines.groupBy(*page).agg(said.alias("l"))
    return pages.select(*page, F.size("l").alias("n_lines"), text("l").alias("raw_text"), text("l").alias("clean_text"), text(F.filter("l", lambda s: s["ai_ready"])).alias("ai_ready_text"))


def make_lessons(lines: DataFrame) -> DataFrame:
    """lines(lesson_no, pos, line) -> one row a lesson: numbered lines, ready lines (longer than 12) and the joined texts."""
    clean = lines.withColumn("text", T.collapse(F.col("line"))).where("text <> ''")
    texts = clean.groupBy("lesson_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))
    long = F.filter("texts", lambda x: F.length(x) > 12)
    number = lambda a, kind: F.transform(a, lambda x, i: F.struct(T.line_id(kind, F.col("lesson_no").cast("int"), i + 1).alias("id"), (i + 1).alias("line_number"), x.alias("text")))
    return texts.select("lesson_no", number(F.col("texts"), "lesson").alias("lines"), number(long, "lesson-ai").alias("ai_ready_lines"), F.array_join("texts", "\n").alias("raw_text"), F.array_join(long, "\n").alias("ai_ready_text"))


#: The lessons' page ranges (fixed values): (title, first page, last page), numbered from 1.
LESSONS = (
    ("Going to a New School", 6, 8), ("Congratulations! Well Done!", 9, 11), ("At a Railway Station", 12, 13), ("Where are You From?", 14, 17), ("Thanks for Your Work", 18, 21),
    ("It Smells Good!", 22, 23), ("Holding Hands", 24, 25), ("Grocery Shopping", 26, 32), ("Health is Wealth", 33, 37), ("Remedies: Modern and Traditional", 38, 41), ("Are You Listening?-1", 42, 43),
    ("An Unseen Beauty of Bangladesh", 44, 46), ("Our Pride", 47, 50), ("The Lion's Mane", 51, 53), ("An Old People's Home", 54, 56), ("Boats Sail on the Rivers", 57, 57), ("Are You Listening?-2", 58, 60),
    ("Make Your Snacks", 61, 64), ("Stop, Look and Listen", 65, 65), ("Hason Raja: The Mystic Bard of Bangladesh", 66, 67), ("Wonders of the World-1", 68, 69), ("Wonders of the World-2", 70, 72),
    ("We Live in a Global Village", 73, 75), ("Our Wage Earners", 76, 79), ("The Concert for Bangladesh", 80, 82), ("Buying Clothes", 83, 87), ("Andre", 88, 88), ("Are You Listening?-3", 89, 90), ("Taking a Test", 91, 92),
    ("What Should We do?", 93, 94), ("Too Much or Too Little Water", 95, 96), ("An Invitation for Robin", 97, 98), ("The Garden", 99, 105),
)


def lesson_ranges(spark) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(LESSONS, 1)], "lesson_no int, title string, pdf_start int, pdf_end int")


def lesson_for_page(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first lesson whose range holds the page, else null. The ranges are a fixed list of 33 rows."""
    found = pages.select("page_no").distinct().join(F.broadcast(ranges), F.col("page_no").between(F.col("pdf_start"), F.col("pdf_end"))).groupBy("page_no").agg(F.min("lesson_no").alias("lesson_no"))
    return pages.join(found, "page_no", "left")


def page_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """start from 1; an end of 0 or less means the last page."""
    return pages.where((F.col("page_no") >= max(1, start)) & (F.col("page_no") <= end if end > 0 else F.lit(True)))


def skip_processed(todo: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Pages still to do: done(page_no, has_image, has_json) has both for those that are skipped."""
    return todo if force else todo.join(done.where("has_image AND has_json").select("page_no"), "page_no", "left_anti")


def index_of_run(todo: DataFrame, done: DataFrame, old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """The index after a run: new's rows, and those that old has of the pages that were skipped, with their counts."""
    if force:
        return new
    skipped = todo.join(done.where("has_image AND has_json").select("page_no"), "page_no", "left_semi")
    return new.unionByName(old.join(skipped.select("page_no"), "page_no", "left_semi"), allowMissingColumns=True)


def missing_books(books: DataFrame, titles: DataFrame) -> DataFrame:
    """titles(title) -> (book_id, title) of the books that books lacks, with an id that is of the title alone."""
    new = titles.select("title").distinct().join(books.select("title"), "title", "left_anti")
    return new.select(F.concat(F.lit("book-"), F.substring(F.sha2("title", 256), 1, 16)).alias("book_id"), "title")


def find_or_create_book(books: DataFrame, title: str) -> DataFrame:
    """books(book_id, title) with a row for title: the one it has, else a new one."""
    titles = books.sparkSession.createDataFrame([(title,)], "title string")
    return books.unionByName(missing_books(books, titles), allowMissingColumns=True)


def import_ocr(old_pages: DataFrame, old_lines: DataFrame, new: DataFrame, book_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new: normalize_import_lines of one book -> (pages, lines, counts). A page of (book_id, page_no) is updated or created, all
    lines of an imported page are replaced, other pages and books keep theirs; counts has a row a page that was imported."""
    key, book = ["book_id", "page_no"], F.lit(book_id).alias("book_id")
    texts = import_texts(new).select(book, "*")
    touched = texts.select(*key)
    pages = old_pages.join(touched, key, "left_anti").unionByName(texts.select(*key, "raw_text", "clean_text", "ai_ready_text"), allowMissingColumns=True)
    lines = old_lines.join(touched, key, "left_anti").unionByName(new.select(book, "*"), allowMissingColumns=True)
    counts = texts.join(old_pages.select(*key).distinct().withColumn("existed", F.lit(True)), key, "left").select(*key, "n_lines", F.coalesce("existed", F.lit(False)).alias("updated"))
    return pages, lines, counts


def import_rows(books: DataFrame, new: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """books(book_id, title); new: normalize_import_lines with the title of their book; files(title, page_no, file_name): every page that is
    imported, also those without a line -> (pages, lines, counts, totals): the rows to store, the lines of each page and of each book.

    Of books with one title the first id counts; of several files for one page the last name.
    """
    ids = books.groupBy("title").agg(F.min("book_id").alias("book_id"))
    done = files.groupBy("title", "page_no").agg(F.max("file_name").alias("file_name")).join(ids, "title")
    page_id = F.concat("book_id", F.lit("-page-"), F.col("page_no").cast("string")).alias("page_id")
    texts = import_texts(new, "title", "page_no")
    none = [F.coalesce(c, F.lit("")).alias(c) for c in ("raw_text", "clean_text", "ai_ready_text")]
    every = done.join(texts, ["title", "page_no"], "left").select("title", "book_id", "page_no", page_id, "file_name", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), *none)
    image = F.concat(F.lit("/ocr/books/test/page-"), F.col("page_no").cast("string"), F.lit(".png")).alias("image_path")
    pages = every.select("page_id", "book_id", "page_no", image, "raw_text", "clean_text", "ai_ready_text")
    lines = new.join(ids, "title").join(done.select("title", "page_no"), ["title", "page_no"], "left_semi").select("book_id", "page_no", page_id, *[c for c in new.columns if c not in ("title", "page_no")])
    counts = every.select("book_id", "page_no", F.col("n_lines").alias("line_count"), "file_name")
    totals = every.groupBy("book_id", F.col("title").alias("book_title")).agg(F.count("*").alias("imported_pages"), F.sum("n_lines").alias("imported_lines"))
    return pages, lines, counts, totals


def replace_pages(old_pages: DataFrame, old_lines: DataFrame, pages: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages and lines after an import: those of import_rows, and the old ones of pages that weren't imported."""
    key = ["book_id", "page_no"]
    touched = pages.select(*key)
    kept = lambda old, new: old.join(touched, key, "left_anti").unionByName(new, allowMissingColumns=True)
    return kept(old_pages, pages), kept(old_lines, lines)
