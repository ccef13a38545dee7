"""Queries over the page operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.operators import ocr as O
from lessonlake.plans import adapters as A
from lessonlake.plans import sql_text as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W, H = A.PAGE_WIDTH, A.PAGE_HEIGHT


def query(f):
    QUERIES[f.__name__] = f
    return f


def _native(spark, d):
    return O.lines_from_native(A.word_pages(spark, d), W, H)


def _tokens(spark, d):
    return O.lines_from_tokens(A.word_pages(spark, d), W, H)


def _numbered(spark, d):
    return O.number_lines(_tokens(spark, d))


def _pages(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("page_no"))


def _documents(spark, d):
    return O.page_documents(_numbered(spark, d), _pages(spark, d))


def _built(source: str, group: str, conf: str, scale: int) -> str:
    x, y, w, h = (f"CAST(trunc({c} * {scale}) AS BIGINT)" for c in ("x", "y", "width", "height"))
    return f"""SELECT page_no, pos, text, {S.clean_ai_text('text')} AS clean_text, x, y, width, height, confidence FROM (
  SELECT page_no, {S.normalize_text("string_agg(text, ' ' ORDER BY x, pos)")} AS text, count(*) AS n_words, min(pos) AS pos, min({x}) AS x, min({y}) AS y, max({x} + {w}) - min({x}) AS width, max({y} + {h}) - min({y}) AS height, {conf} AS confidence
  FROM (SELECT * REPLACE ({S.normalize_text('text')} AS text) FROM {source}) WHERE text <> '' GROUP BY page_no, {group})
  WHERE {S.should_keep('text', 'n_words', 'confidence', 'width', 'height', W, H)}"""


NATIVE = f"native AS ({_built('(SELECT *, count(*) OVER (PARTITION BY page_no) AS n FROM words) WHERE n >= 8'.replace(') WHERE', ') q WHERE'), 'block_no, line_no', '99.0', 2)})".replace("FROM (SELECT *, count", "FROM (SELECT *, count")
TOKENS = f"tokens AS ({_built('words WHERE confidence >= 35', 'block_no, par_no, line_no', 'avg(confidence)', 1)})"
NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY y, x, pos) AS line_number FROM tokens)"


@query
def c1_lines_from_native(spark, d):
    return _native(spark, d).select("page_no", "pos", "text", "clean_text", "x", "y", "width", "height", "ai_ready")


SQL["c1_lines_from_native"] = f"WITH {A.WORDS}, {NATIVE} SELECT page_no, pos, text, clean_text, x, y, width, height, {S.is_ai_ready('clean_text')} AS ai_ready FROM native"


@query
def c2_lines_from_tokens(spark, d):
    return _tokens(spark, d).select("page_no", "pos", "text", "confidence")


SQL["c2_lines_from_tokens"] = f"WITH {A.WORDS}, {TOKENS} SELECT page_no, pos, text, round_even(confidence, 2) AS confidence FROM tokens"


@query
def c3_cluster_lines_by_y(spark, d):
    return O.cluster_lines_by_y(A.word_pages(spark, d))


SQL["c3_cluster_lines_by_y"] = f"""WITH {A.WORDS}, l AS (SELECT page_no, list({{'pos': pos, 'y': y}} ORDER BY pos) AS l FROM words GROUP BY 1),
n AS (SELECT page_no, list_reduce(l, lambda acc, x: CASE WHEN acc.anchor IS NOT NULL AND abs(x.y - acc.anchor) < 20 THEN {{'anchor': acc.anchor, 'no': acc.no, 'nos': list_append(acc.nos, {{'pos': x.pos, 'no': acc.no}})}}
  ELSE {{'anchor': x.y, 'no': acc.no + 1, 'nos': list_append(acc.nos, {{'pos': x.pos, 'no': acc.no + 1}})}} END, {{'anchor': NULL::BIGINT, 'no': 0::BIGINT, 'nos': []::STRUCT(pos BIGINT, no BIGINT)[]}}).nos AS nos FROM l),
p AS (SELECT page_no, unnest(nos) AS p FROM n), w AS (SELECT words.*, p.no AS line_number FROM p JOIN words ON words.page_no = p.page_no AND words.pos = p.pos),
g AS (SELECT page_no, line_number, {S.collapse("string_agg(text, ' ' ORDER BY x, pos)")} AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM w GROUP BY 1, 2)
SELECT * FROM g WHERE NOT ({S.collapse('text')} = '' OR {S.rm(S.collapse('text'), S.BAD_LINE)})"""


@query
def c4_build_line(spark, d):
    return _tokens(spark, d).select("page_no", "pos", "clean_text", "x", "y", "width", "height", "ai_ready")


SQL["c4_build_line"] = f"WITH {A.WORDS}, {TOKENS} SELECT page_no, pos, clean_text, x, y, width, height, {S.is_ai_ready('clean_text')} AS ai_ready FROM tokens"


@query
def c5_drop_overlaps(spark, d):
    shifted = _tokens(spark, d).select("page_no", "pos", "x", (F.col("y") / 3).cast("int").alias("y"), "height", "text")
    return O.drop_overlaps(shifted).select("page_no", "pos", "x", "y", "text")


_CLASH = "((lower(k.text) = lower(x.text) OR (contains(lower(x.text), lower(k.text)) AND length(k.text) > 12) OR (contains(lower(k.text), lower(x.text)) AND length(x.text) > 12)) AND abs(k.y - x.y) < greatest(k.height, x.height))"
_LINE = "STRUCT(pos BIGINT, x BIGINT, y BIGINT, height BIGINT, text VARCHAR)"
SQL["c5_drop_overlaps"] = f"""WITH {A.WORDS}, {TOKENS}, s AS (SELECT page_no, list({{'pos': pos::BIGINT, 'x': x::BIGINT, 'y': (y // 3)::BIGINT, 'height': height::BIGINT, 'text': text}} ORDER BY y // 3, x, pos) AS l FROM tokens GROUP BY 1),
k AS (SELECT page_no, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_CLASH})) > 0 THEN acc ELSE list_append(acc, x) END, []::{_LINE}[]) AS k FROM s),
u AS (SELECT page_no, unnest(k) AS u FROM k) SELECT page_no, u.pos, u.x, u.y, u.text FROM u"""


@query
def c6_choose_source(spark, d):
    return O.choose_source(_native(spark, d), _tokens(spark, d)).select("page_no", "pos", "text", "source")


SQL["c6_choose_source"] = f"""WITH {A.WORDS}, {NATIVE}, {TOKENS}, enough AS (SELECT page_no FROM native GROUP BY page_no HAVING count(*) >= 5)
SELECT page_no, pos, text, 'native' AS source FROM native SEMI JOIN enough USING (page_no) UNION ALL SELECT page_no, pos, text, 'tesseract' FROM tokens ANTI JOIN enough USING (page_no)"""


@query
def c7_number_lines(spark, d):
    return _numbered(spark, d).select("page_no", "pos", "line_number", "id")


SQL["c7_number_lines"] = f"WITH {A.WORDS}, {TOKENS}, {NUMBERED} SELECT page_no, pos, line_number, format('page-{{:03d}}-line-{{:03d}}', page_no, line_number) AS id FROM numbered"


@query
def c8_page_documents(spark, d):
    return _documents(spark, d).select("page_no", F.size("lines").alias("n_lines"), "raw_text", "clean_text", "ai_ready_text")


SQL["c8_page_documents"] = f"""WITH {A.WORDS}, {TOKENS}, {NUMBERED},
docs AS (SELECT page_no, count(*) AS n, string_agg(text, chr(10) ORDER BY line_number) AS r, string_agg(clean_text, chr(10) ORDER BY line_number) AS c, string_agg(clean_text, chr(10) ORDER BY line_number) FILTER (WHERE {S.is_ai_ready('clean_text')}) AS a FROM numbered GROUP BY page_no)
SELECT doc_id AS page_no, coalesce(n, 0) AS n_lines, coalesce(r, '') AS raw_text, coalesce(c, '') AS clean_text, coalesce(a, '') AS ai_ready_text FROM documents LEFT JOIN docs ON page_no = doc_id"""


@query
def c9_book_index(spark, d):
    failed = _pages(spark, d).where("page_no % 50 = 7").select((-F.col("page_no")).alias("page_no"), F.lit("unreadable").alias("error"))
    index = O.book_index(_documents(spark, d).withColumn("source", F.when(F.col("page_no") % 2 == 0, "tesseract")), "b1", failed)
    return index.join(F.broadcast(O.book_header(index, "b1", "A book", 0, 0, 500).select("end_page", "n_pages", "n_failed")))  # the header is one row


SQL["c9_book_index"] = f"""WITH {A.WORDS}, {TOKENS}, docs AS (SELECT page_no, count(*) AS n, count(*) FILTER (WHERE {S.is_ai_ready('clean_text')}) AS a FROM tokens GROUP BY page_no),
i AS (SELECT doc_id AS page_no, format('/ocr/books/b1/pages/page-{{:03d}}.json', doc_id) AS json, format('/ocr/books/b1/page-images/page-{{:03d}}.png', doc_id) AS image, coalesce(n, 0) AS n_lines, coalesce(a, 0) AS n_ready, CASE WHEN doc_id % 2 = 0 THEN 'tesseract' ELSE 'unknown' END AS source, NULL AS error FROM documents LEFT JOIN docs ON page_no = doc_id
UNION ALL SELECT -doc_id, NULL, NULL, NULL, NULL, NULL, 'unreadable' FROM documents WHERE doc_id % 50 = 7) SELECT *, 500 AS end_page, count(*) OVER () AS n_pages, count(error) OVER () AS n_failed FROM i"""


@query
def c10_normalize_import_lines(spark, d):
    w = A.words(spark, d)
    flat = w.select(
        "page_no", "pos", F.concat(F.lit("• "), "text").alias("text"), F.when(F.col("pos") % 5 == 0, "n/a").otherwise(F.col("confidence").cast("string")).alias("confidence"),
        F.when(F.col("pos") % 7 == 0, False).when(F.col("pos") % 7 == 1, True).alias("ai_ready"), (F.col("x") + 0.5).alias("x"), F.col("y").cast("double").alias("y"), (F.col("width") - 16.0).alias("width"), F.col("height").cast("double").alias("height"),
        F.when(F.col("pos") % 2 == 0, F.struct(F.lit(1.4).alias("x"), F.lit(2.5).alias("y"), F.lit(3.0).alias("width"), F.lit(4.0).alias("height"))).alias("bbox"), F.when(F.col("pos") % 3 == 0, F.col("pos") + 100).alias("line_number"),
    )
    return O.normalize_import_lines(flat.withColumn("clean_text", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("**"), "text"))))


SQL["c10_normalize_import_lines"] = f"""WITH {A.WORDS}, flat AS (SELECT page_no, pos, {S.clean_ocr_text("'• ' || text")} AS text, CASE WHEN pos % 5 = 0 THEN 0.0 ELSE CAST(confidence AS DOUBLE) END AS confidence, pos % 7 <> 0 AS flag,
  CASE WHEN pos % 2 = 0 THEN 1 ELSE CAST(floor(x + 1.0) AS INTEGER) END AS x, CASE WHEN pos % 2 = 0 THEN 3 ELSE y END AS y, CASE WHEN pos % 2 = 0 THEN 3 ELSE width - 16 END AS width, CASE WHEN pos % 2 = 0 THEN 4 ELSE height END AS height,
  CASE WHEN pos % 3 = 0 THEN pos + 100 ELSE pos + 1 END AS line_number FROM words)
SELECT page_no, pos, line_number, text, x, y, width, height, confidence, flag AND {S.is_import_ai_ready('text')} AS ai_ready FROM flat WHERE text <> '' AND width >= 0 AND height >= 0"""


@query
def c11_make_lessons(spark, d):
    lines = A.doc_lines(spark, d).select(F.col("doc_id").alias("lesson_no"), "pos", "line")
    out = O.make_lessons(lines)
    return out.select("lesson_no", F.size("lines").alias("n_lines"), F.array_join(F.transform("ai_ready_lines", lambda x: x["id"]), " ").alias("ids"), "raw_text", "ai_ready_text")


SQL["c11_make_lessons"] = f"""WITH {A.DOC_LINES}, c AS (SELECT doc_id, pos, {S.collapse('line')} AS t FROM doc_lines), k AS (SELECT * FROM c WHERE t <> ''),
l AS (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM k WHERE length(t) > 12)
SELECT doc_id AS lesson_no, n AS n_lines, coalesce(ids, '') AS ids, r AS raw_text, coalesce(a, '') AS ai_ready_text FROM
(SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY pos) AS r FROM k GROUP BY doc_id) LEFT JOIN
(SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) AS a, string_agg(format('lesson-{{:02d}}-ai-line-{{:03d}}', doc_id, no), ' ' ORDER BY pos) AS ids FROM l GROUP BY doc_id) USING (doc_id)"""

_RANGES = "ranges(lesson_no, title, a, b) AS (VALUES " + ", ".join(f"({i}, {S.q(t)}, {a}, {b})" for i, (t, a, b) in enumerate(O.LESSONS, 1)) + ")"


@query
def c12_lesson_for_page(spark, d):
    pages = A.table(spark, d, "events").select("event_id", (F.col("event_id") % 120).alias("page_no"))
    return O.lesson_for_page(pages, O.lesson_ranges(spark))


SQL["c12_lesson_for_page"] = f"WITH {_RANGES} SELECT event_id, event_id % 120 AS page_no, (SELECT min(lesson_no) FROM ranges WHERE event_id % 120 BETWEEN a AND b) AS lesson_no FROM events"


@query
def a5_lesson_ranges(spark, d):
    docs = A.table(spark, d, "documents").select((F.col("doc_id") % 33 + 1).cast("int").alias("lesson_no"))
    return docs.groupBy("lesson_no").count().withColumnRenamed("count", "n_documents").join(F.broadcast(O.lesson_ranges(spark)), "lesson_no")


SQL["a5_lesson_ranges"] = f"WITH {_RANGES} SELECT r.lesson_no, title, a AS pdf_start, b AS pdf_end, n AS n_documents FROM ranges r JOIN (SELECT doc_id % 33 + 1 AS lesson_no, count(*) AS n FROM documents GROUP BY 1) USING (lesson_no)"


@query
def a9_import_ocr(spark, d):
    """Three stored books have a page for each document; the conversations are imported as pages of four, one of them new."""
    title = lambda n: F.concat(F.lit("Book "), n.cast("string"))
    old_lines = A.doc_lines(spark, d).select(F.concat(F.lit("id-"), F.col("doc_id") % 3).alias("book_id"), F.col("doc_id").alias("page_no"), (F.col("pos") + 1).alias("line_number"), F.col("line").alias("text"))
    books = old_lines.select("book_id", title(F.substring("book_id", 4, 9)).alias("title")).distinct()
    said = A.table(spark, d, "conversations").select(title(F.col("conv_id") % 4).alias("title"), F.col("conv_id").alias("page_no"), F.col("turn").cast("int").alias("pos"), F.when(F.col("conv_id") % 5 != 0, F.col("text")).alias("text"))
    box = F.struct(*[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height")]).alias("bbox")
    new = O.normalize_import_lines(said.select("title", "page_no", "pos", "text", F.lit("9").alias("confidence"), F.lit(None).cast("boolean").alias("ai_ready"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")], box, F.lit(None).cast("int").alias("line_number")))
    files = said.select("title", "page_no", F.concat(F.lit("page-"), "page_no", F.lit("-lines.json")).alias("file_name")).distinct()
    ids = books.unionByName(O.missing_books(books, files))
    pages, lines, counts, totals = O.import_rows(ids, new, files)
    pages, kept = O.replace_pages(old_lines.select("book_id", "page_no").distinct(), old_lines, pages, lines)
    lines_now = kept.groupBy("book_id", "page_no").agg(F.count("*").alias("n_lines"), F.max("text").alias("last_line"))
    out = pages.select("book_id", "page_no", "page_id", F.length("raw_text").alias("n_raw")).join(lines_now, ["book_id", "page_no"], "left").join(counts, ["book_id", "page_no"], "left").join(totals, "book_id", "left")
    return out.join(ids.withColumnRenamed("title", "book"), "book_id")


SQL["a9_import_ocr"] = f"""WITH {A.DOC_LINES}, old AS (SELECT 'id-' || (doc_id % 3) AS book_id, doc_id AS page_no, line AS text FROM doc_lines),
said AS (SELECT CASE WHEN conv_id % 4 < 3 THEN 'id-' || (conv_id % 4) ELSE 'book-' || substr(sha256('Book 3'), 1, 16) END AS book_id, conv_id AS page_no, turn AS pos, {S.clean_ocr_text("CASE WHEN conv_id % 5 <> 0 THEN text END")} AS text FROM conversations),
new AS (SELECT * FROM said WHERE text <> ''),
n AS (SELECT book_id, page_no, count(new.text) AS line_count, coalesce(length(string_agg(new.text, chr(10) ORDER BY pos)), 0) AS n_raw FROM (SELECT DISTINCT book_id, page_no FROM said) LEFT JOIN new USING (book_id, page_no) GROUP BY 1, 2),
pages_now AS (SELECT DISTINCT book_id, page_no FROM old UNION SELECT book_id, page_no FROM n),
every AS (SELECT old.* FROM old ANTI JOIN n USING (book_id, page_no) UNION ALL SELECT book_id, page_no, text FROM new),
t AS (SELECT book_id, count(*) AS imported_pages, CAST(sum(line_count) AS BIGINT) AS imported_lines FROM n GROUP BY 1)
SELECT book_id, page_no, CASE WHEN n_raw IS NOT NULL THEN book_id || '-page-' || page_no END AS page_id, n_raw, n_lines, last_line, line_count, CASE WHEN line_count IS NOT NULL THEN 'page-' || page_no || '-lines.json' END AS file_name,
'Book ' || CASE WHEN book_id LIKE 'id-%' THEN substr(book_id, 4) ELSE '3' END AS book, CASE WHEN imported_pages IS NOT NULL THEN book END AS book_title, imported_pages, imported_lines
FROM pages_now LEFT JOIN (SELECT book_id, page_no, count(*) AS n_lines, max(text) AS last_line FROM every GROUP BY 1, 2) USING (book_id, page_no) LEFT JOIN n USING (book_id, page_no) LEFT JOIN t USING (book_id)"""


@query
def a10_skip_processed(spark, d):
    todo = _pages(spark, d)
    done = todo.select("page_no", (F.col("page_no") % 2 == 0).alias("has_image"), (F.col("page_no") % 3 == 0).alias("has_json"))
    old = A.table(spark, d, "documents").select(F.col("doc_id").alias("page_no"), F.col("n_chars").alias("n_lines"))
    return O.index_of_run(todo, done, old, O.skip_processed(todo, done).withColumn("n_lines", F.lit(-1).cast("long")))


SQL["a10_skip_processed"] = "SELECT doc_id AS page_no, CASE WHEN doc_id % 6 = 0 THEN n_chars ELSE -1 END AS n_lines FROM documents"


@query
def a11_page_range(spark, d):
    whole = O.page_range(_pages(spark, d), 40, 0).withColumn("part", F.lit("rest"))
    return O.page_range(_pages(spark, d), -3, 25).withColumn("part", F.lit("first")).union(whole)


SQL["a11_page_range"] = "SELECT doc_id AS page_no, 'first' AS part FROM documents WHERE doc_id BETWEEN 1 AND 25 UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id >= 40"
