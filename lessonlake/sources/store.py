"""Stored tables that change: rows replace the stored ones of their key, and only the partitions that they touch are written again.

A partition is written beside the old one and then takes its place, so a table may be read for its own change. A run that breaks off may have
changed some partitions and not others; running it again gives the whole result, as every change states the rows after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.operators import activity as G
from lessonlake.operators import ocr as O
from lessonlake.sources import tables

#: Values of a partition column that are looked for one by one; with more, all partitions are read.
FEW_PARTITIONS = 1000
#: Pages of a book that share a partition, and partitions of the students' tables.
PAGES, BUCKETS = 64, 64


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, none where there is no folder."""
    place, files = _place(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def upsert(rows: DataFrame, path: str, keys: list[str], by: list[str], replaced: DataFrame | None = None, form: str = "parquet") -> None:
    """Puts rows in the table at path, which is partitioned by the columns by. Stored rows whose keys are in replaced (by default those of
    rows) go. rows must not repeat a key, unless replaced is given: then a key's rows are replaced as a whole."""
    spark, rows = rows.sparkSession, rows.persist()
    try:
        gone = (rows if replaced is None else replaced).select(*dict.fromkeys((*by, *keys))).distinct()
        out = rows
        touched = gone.select(*by).distinct()
        there = exists(spark, path)
        if there:
            old = spark.read.schema(rows.schema).format(form).load(path)
            first = [r[0] for r in touched.select(by[0]).distinct().limit(FEW_PARTITIONS + 1).collect()]
            if len(first) <= FEW_PARTITIONS:
                old = old.where(F.col(by[0]).isin(first))
            out = old.join(touched, by, "left_semi").join(gone, list(gone.columns), "left_anti").unionByName(rows)
        out.repartition(*by).sortWithinPartitions(*by, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)
        if there and replaced is not None:  # partitions that have lost their last row
            left = spark.read.schema(rows.schema).format(form).load(path)
            stale = left.join(touched, by, "left_semi").join(gone, list(gone.columns), "left_semi").select(*by).distinct().join(rows.select(*by).distinct(), by, "left_anti")
            for r in stale.collect():  # names of folders
                delete(spark, "/".join([path, *[f"{c}={r[c]}" for c in by]]))
    finally:
        rows.unpersist()


def import_books(spark: SparkSession, path: str, new: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports pages into the stored books, pages and lines below path: new and files as ocr.import_rows takes them -> its (counts, totals).

    A book is found by its title or made. An imported page is updated or made, and all its lines are replaced, also by none. Other
    pages keep their rows, other books their files.
    """
    books = tables.load_table(spark, path, "books") if exists(spark, f"{path}/books") else spark.createDataFrame([], tables.SCHEMAS["books"])
    made = O.missing_books(books, files.select("title")).withColumn("created_at", F.current_timestamp()).persist()
    if not made.isEmpty():
        tables.save_table(made, path, "books", "append")
    pages, lines, counts, totals = O.import_rows(books.unionByName(made, allowMissingColumns=True), new, files)
    block = F.floor(F.col("page_no") / PAGES).cast("int").alias("page_block")
    pages = pages.persist()
    done = pages.select("book_id", block, "page_no")
    upsert(lines.select("*", block), f"{path}/book_lines", ["page_no"], ["book_id", "page_block"], replaced=done)
    upsert(pages.select("*", block), f"{path}/book_pages", ["page_no"], ["book_id", "page_block"])
    return counts, totals


def bucket(key: str = "student_key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def ensure_students(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Makes or renames the stored students of events, and makes the memories that they lack (activity.merge_students)."""
    def load(name: str) -> DataFrame:
        at = f"{path}/{name}"
        return tables.conform(spark.read.parquet(at), name) if exists(spark, at) else spark.createDataFrame([], tables.SCHEMAS[name])

    students, memories = G.merge_students(events, load("students"), load("student_memory"))
    touched = events.select("student_key").distinct()
    for name, rows in (("students", students.join(touched, "student_key", "left_semi")), ("student_memory", memories.join(touched, "student_key", "left_semi"))):
        upsert(tables.conform(rows, name).select("*", bucket()), f"{path}/{name}", ["student_key"], ["bucket"])
