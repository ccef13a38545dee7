"""Readers and writers of book files. All paths go to Spark's readers, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators.activity import student_key
from lessonlake.sources import store

BOX = "bbox:struct<x:int,y:int,width:int,height:int>"
PAGE = f"bookId string, pageNumber int, image string, width int, height int, source string, lines array<struct<id:string,lineNumber:int,text:string,cleanText:string,{BOX},confidence:double,source:string,aiReady:boolean>>, aiReadyLines array<struct<id:string,lineNumber:int,text:string,{BOX},confidence:double,source:string>>, rawText string, cleanText string, aiReadyText string"
WORD = "array<struct<text:string,x:int,y:int,width:int,height:int,confidence:string>>"
LINE = "array<struct<id:string,lineNumber:int,text:string,cleanText:string,confidence:string,aiReady:boolean,x:double,y:double,width:double,height:double,bbox:struct<x:double,y:double,width:double,height:double>>>"
LESSON = "lessonNo int, title string, lessonTitle string, textbookPageStart int, textbookPageEnd int, pdfPageStart int, pdfPageEnd int, pages array<struct<pdfPage:int,textbookPage:int,rawText:string,rawLines:array<string>,cleanLines:array<string>,aiReadyLines:array<string>>>, lines array<struct<id:string,lineNumber:int,paragraphNo:int,text:string>>, aiReadyLines array<struct<id:string,text:string>>, rawText string, cleanText string, aiReadyText string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: name and whole text, without a leading byte order mark. A text that isn't UTF-8 is null. Spark's scans skip files of no bytes."""
    files = spark.read.format("binaryFile").load(path).withColumn("value", F.try_validate_utf8(F.col("content").cast("string")))
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", "^\ufeff", "").alias("body"))


def _parsed(files: DataFrame, schema: str, start: str) -> DataFrame:
    """files(file_name, body) with doc, and error where the body is no JSON value of that kind. start: how its text begins."""
    kept = F.from_json("body", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}) if start == "{" else F.from_json("body", schema)
    out = files.withColumn("doc", F.when(T.trim(F.col("body")).startswith(start), kept))
    whole = F.col("doc").isNotNull() & F.try_parse_json("body").isNotNull()
    if start == "{":
        whole = whole & F.col("doc._broken").isNull()
    return out.withColumn("error", F.when(~whole, F.concat(F.lit("not a JSON "), F.lit("object" if start == "{" else "array"))))


def _rejects(rows: DataFrame) -> DataFrame:
    """(page_no, file_name, error); the number is that of the file's name."""
    return rows.where("error IS NOT NULL").select(F.regexp_extract("file_name", r"(\d+)", 1).try_cast("int").alias("page_no"), "file_name", "error")


def _page_files(spark: SparkSession, path: str) -> DataFrame:
    files = _parsed(_documents(spark, path).where(F.col("file_name").rlike(r"^page-\d+\.json\z")), PAGE, "{")
    return files.withColumn("error", F.coalesce("error", F.when(~F.coalesce(F.col("doc.pageNumber") >= 1, F.lit(False)), "no page number from 1 on")))


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page documents of files page-NNN.json; unreadable_pages has those that aren't any."""
    return _page_files(spark, path).where("error IS NULL").select("doc.*").drop("_broken")


def unreadable_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, file_name, error) of the files that read_ocr_pages leaves out, for the error rows of ocr.book_index."""
    return _rejects(_page_files(spark, path))


def read_word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """A row a word, with its place in the file as pos; unreadable_word_boxes has the files without an array."""
    files = _parsed(_documents(spark, path), WORD, "[")
    return files.where("error IS NULL").select("file_name", F.posexplode("doc").alias("pos", "w")).select("file_name", "pos", "w.*")


def unreadable_word_boxes(spark: SparkSession, path: str) -> DataFrame:
    return _rejects(_parsed(_documents(spark, path), WORD, "["))


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files below path as a stream, a row each as the readers here read them: a run takes only files that its checkpoint hasn't seen."""
    files = spark.readStream.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace(F.try_validate_utf8("value"), "^\ufeff", "").alias("body"))


def line_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(file_name, body) -> (lines, rejects, pages) of those named page-N-lines.json: a file that holds no JSON array is rejected; pages
    (page_no, file_name) are the others, also those of an empty array."""
    numbered = files.withColumn("page_no", F.regexp_extract("file_name", r"(?i)^page-(\d+)-lines\.json\z", 1)).where("page_no <> ''").withColumn("page_no", F.col("page_no").cast("int"))
    parsed = _parsed(numbered, LINE, "[")
    good = parsed.where("error IS NULL")
    return good.select("page_no", F.posexplode("doc").alias("pos", "l")).select("page_no", "pos", "l.*"), parsed.where("error IS NOT NULL").select("page_no", "file_name", "error"), good.select("page_no", "file_name")


def read_line_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of files page-N-lines.json."""
    return line_files(_documents(spark, path))[:2]


def read_line_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, file_name) of each file that read_line_files reads."""
    return line_files(_documents(spark, path))[2]


def word_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(file_name, body) -> (words, rejects) of all files, with the page of the file's name."""
    parsed = _parsed(files, WORD, "[").withColumn("page_no", F.regexp_extract("file_name", r"(\d+)", 1).try_cast("long"))
    words = parsed.where("error IS NULL").select("page_no", "file_name", F.posexplode("doc").alias("pos", "w"))
    return words.select("page_no", "file_name", "pos", "w.*"), _rejects(parsed)


def import_columns(lines: DataFrame) -> DataFrame:
    """The lines of line_files in the columns that ocr.normalize_import_lines takes."""
    return lines.withColumnsRenamed({"lineNumber": "line_number", "cleanText": "clean_text", "aiReady": "ai_ready"})


def _lesson_files(spark: SparkSession, path: str) -> DataFrame:
    files = _parsed(_documents(spark, path).where(F.col("file_name").rlike(r"^lesson-\d+\.json\z")), LESSON, "{")
    return files.withColumn("error", F.coalesce("error", F.when(~F.coalesce(F.col("doc.lessonNo").between(1, 33), F.lit(False)), "no lesson number from 1 to 33")))


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lesson documents of either variant; missing arrays are empty, missing texts ''. unreadable_lessons has the other files."""
    rows = _lesson_files(spark, path).where("error IS NULL").select("doc.*").drop("_broken")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("pages", "lines", "aiReadyLines")}
    return rows.withColumns(empty | {c: F.coalesce(c, F.lit("")) for c in ("rawText", "cleanText", "aiReadyText")}).withColumn("lessonTitle", F.coalesce("title", "lessonTitle"))


def unreadable_lessons(spark: SparkSession, path: str) -> DataFrame:
    return _rejects(_lesson_files(spark, path)).withColumnRenamed("page_no", "lesson_no")


#: Fields of an attempt beside its numbers; a nested value is read as its JSON text.
ATTEMPT = {"lessonTitle": "lesson_title", "wrongAnswers": "wrong_answers", "weakAreas": "weak_areas", "submittedAnswers": "submitted_answers", "result": "result", "sentence": "sentence", "details": "details"}
ACTIVITY = "studentKey string, studentId string, activityType string, minutesStudied string, lessonNo string, score string, total string, gameType string, ts timestamp, event_id long, " + ", ".join(f"{c} string" for c in ATTEMPT)


def read_activity(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Request rows of JSON lines, as activity_rows gives them."""
    return activity_rows((spark.readStream if stream else spark.read).schema(ACTIVITY).json(path))


def activity_rows(raw: DataFrame) -> DataFrame:
    """Raw requests, all strings, as typed rows. Numbers may be strings and default to 0; a missing or blank key is the demo student's; a
    missing or blank lesson stays null for games and is 1 otherwise. Of the fields of ATTEMPT those that raw has stay."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0)).cast("long")
    lesson = F.col("lessonNo").try_cast("int")
    return raw.select(
        student_key(F.col("studentKey"), F.col("studentId")).alias("student_key"), F.col("activityType").alias("activity_type"), "ts", "event_id", T.day_key(F.col("ts")).alias("date_key"),
        F.when(F.col("activityType") == "game_finished", lesson).otherwise(F.coalesce(lesson, F.lit(1))).alias("lesson_no"), number("score").alias("score"), number("total").alias("total"), number("minutesStudied").alias("minutes"),
        F.col("gameType").alias("game_type"), *[F.col(c).alias(n) for c, n in ATTEMPT.items() if c in raw.columns],
    )


def write_ocr_pages(pages: DataFrame, path: str) -> None:
    """One JSON document a page, non-ASCII kept, in a folder a book; of rows for one page of a book, the one of most lines stays. Stored pages of
    these numbers are replaced, other pages stay, and other books keep their files."""
    best = F.row_number().over(Window.partitionBy("bookId", "pageNumber").orderBy(F.coalesce(F.size("lines"), F.lit(0)).desc(), F.to_json(F.struct("*"))))
    store.upsert(pages.withColumn("n_of_page", best).where("n_of_page = 1").drop("n_of_page"), path, ["pageNumber"], ["bookId"], form="json")
