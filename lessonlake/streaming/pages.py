"""Page files as they arrive: each file is read once, and what it changes is stored. A batch that is repeated stores the same rows again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lessonlake.operators import ocr as O
from lessonlake.sources import readers, store


def _stream(spark: SparkSession, path: str, out: str, checkpoint: str, put: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """put(files) stores what a batch of files holds and returns its rejects, which go to a folder of the batch's number."""

    def batch(files: DataFrame, number: int) -> None:
        rows = files.persist()
        try:
            put(rows).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        finally:
            rows.unpersist()

    return readers.page_stream(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def import_stream(spark: SparkSession, path: str, out: str, title: str, checkpoint: str) -> DataStreamWriter:
    """Line files of one book into the stored books, pages and lines below out, as store.import_books does it."""

    def put(files: DataFrame) -> DataFrame:
        lines, rejects, pages = readers.line_files(files)
        of_book = lambda rows: rows.withColumn("title", F.lit(title))
        store.import_books(files.sparkSession, out, O.normalize_import_lines(of_book(readers.import_columns(lines))), of_book(pages))
        return rejects

    return _stream(spark, path, out, checkpoint, put)


def word_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Word files into out/page_lines, the lines that their words form (ocr.cluster_lines_by_y); a page's lines are replaced as a whole."""

    def put(files: DataFrame) -> DataFrame:
        words, rejects = readers.word_files(files)
        block = F.floor(F.col("page_no") / store.PAGES).cast("int").alias("page_block")
        store.upsert(O.cluster_lines_by_y(words).select("*", block), f"{out}/page_lines", ["page_no"], ["page_block"], replaced=words.select("page_no", block))
        return rejects

    return _stream(spark, path, out, checkpoint, put)
