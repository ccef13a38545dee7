"""The stored entities: their schemas, and tables of them as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MADE = "created_at timestamp"
#: Column names and types of each entity (fixed values).
SCHEMAS = {
    "students": f"student_key string, email string, password_hash string, name string, class_level int, section string, roll_number string, school_name string, guardian_name string, guardian_phone string, avatar_theme string, {_MADE}, updated_at timestamp",
    "student_memory": f"student_key string, opened_lessons_json string, selected_lines_json string, used_tools_json string, weak_areas_json string, {_MADE}, updated_at timestamp",
    "daily_study": "student_key string, date_key string, minutes long, lessons_opened long, lines_selected long, ai_interactions long, quiz_attempts long, quiz_score long, quiz_total long, games_played long, game_score long",
    "game_attempts": f"student_key string, lesson_no int, game_type string, score int, total int, result string, sentence string, details_json string, {_MADE}",
    "research_events": f"student_key string, lesson_no int, event_type string, selected_line string, tool_used string, score int, total int, metadata_json string, {_MADE}",
    "quiz_attempts": f"student_key string, lesson_no int, lesson_title string, score int, total int, wrong_answers_json string, weak_areas_json string, submitted_answers_json string, {_MADE}",
    "chat_messages": f"student_key string, lesson_no int, selected_line string, tool_used string, question string, answer string, source string, {_MADE}",
    "wallets": "student_key string, credits long, points long, lifetime long, used long",
    "reward_tx": f"student_key string, type string, points_change long, credits_change long, reason string, metadata_json string, {_MADE}",
    "ai_usage": f"student_key string, lesson_no int, selected_line string, question string, tool_used string, credits_used int, {_MADE}",
    "books": f"book_id string, title string, class_level int, subject string, pdf_path string, cover_image string, {_MADE}",
    "book_pages": f"page_id string, book_id string, page_no int, image_path string, width int, height int, raw_text string, clean_text string, ai_ready_text string, {_MADE}",
    "book_lines": f"page_id string, line_number int, text string, clean_text string, x int, y int, width int, height int, confidence double, ai_ready boolean, {_MADE}",
}


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows in the entity's columns and types: a column that rows lack is null, one that the entity lacks goes."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])])


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The entity's table below path; columns that its files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def save_table(rows: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Writes the entity's table below path; mode append adds to it."""
    conform(rows, name).write.mode(mode).parquet(f"{path}/{name}")


def save_clustered(rows: DataFrame, table: str, key: str, buckets: int = 200) -> None:
    """Writes rows to a table of the catalogue, dealt to buckets by the key, a file a bucket, each sorted by it. Groups, windows and joins by the
    key then need no shuffle, if the joined tables have as many buckets."""
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
