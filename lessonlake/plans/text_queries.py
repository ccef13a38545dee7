"""Queries over the text functions and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.plans import adapters as A
from lessonlake.plans import sql_text as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _of_lines(name: str, sql: dict[str, str], columns: Callable[[], dict[str, Column]]) -> None:
    """A query of column functions over the lines of all documents."""
    QUERIES[name] = lambda spark, d: A.doc_lines(spark, d).select("doc_id", "pos", *[c.alias(n) for n, c in columns().items()])
    SQL[name] = f"WITH {A.DOC_LINES} SELECT doc_id, pos, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM doc_lines"


def _of_table(name: str, table: str, keys: str, sql: dict[str, str] | None, columns: Callable[[], dict[str, Column]]) -> None:
    QUERIES[name] = lambda spark, d: A.table(spark, d, table).select(*keys.split(", "), *[c.alias(n) for n, c in columns().items()])
    if sql is not None:
        SQL[name] = f"SELECT {keys}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {table}"



def labelled() -> Column:
    return F.concat(F.format_string("%d. ", F.col("pos")), F.lit("A) ii. "), F.col("line"))


LABELLED = "CAST(pos AS VARCHAR) || '. A) ii. ' || line"

_of_lines(
    "b1_normalize_text",
    {"value": S.normalize_text("line")},
    lambda: dict(
        value=T.normalize_text(F.col('line')),
    ),
)
_of_lines(
    "b2_alphabet_ratio",
    {"ratio": f"round({S.alphabet_ratio('line')}, 9)"},
    lambda: dict(
        ratio=F.round(T.alphabet_ratio(F.col('line')), 9),
    ),
)
_of_lines(
    "b3_is_label_only",
    {"whole": S.is_label_only("line"), "number": S.is_label_only("CAST(pos AS VARCHAR) || ')'"), "word": S.is_label_only("split_part(line, ' ', 1)")},
    lambda: dict(
        whole=T.is_label_only(F.col('line')),
        number=T.is_label_only(F.concat(F.col('pos').cast('string'), F.lit(')'))),
        word=T.is_label_only(F.split(F.col('line'), ' ')[0]),
    ),
)
_of_lines(
    "b4_is_header_or_footer",
    {"whole": S.is_header_or_footer("line"), "number": S.is_header_or_footer("CAST(pos AS VARCHAR)"), "form": S.is_header_or_footer("'FORMA-' || CAST(pos AS VARCHAR) || line")},
    lambda: dict(
        whole=T.is_header_or_footer(F.col('line')),
        number=T.is_header_or_footer(F.col('pos').cast('string')),
        form=T.is_header_or_footer(F.concat(F.lit('FORMA-'), F.col('pos').cast('string'), F.col('line'))),
    ),
)
_of_lines(
    "b6_is_ai_ready",
    {"plain": S.is_ai_ready("line"), "told": S.is_ai_ready("'Fill in ' || line")},
    lambda: dict(
        plain=T.is_ai_ready(F.col('line')),
        told=T.is_ai_ready(F.concat(F.lit('Fill in '), F.col('line'))),
    ),
)
_of_lines(
    "b7_clean_ai_text",
    {"value": S.clean_ai_text(LABELLED)},
    lambda: dict(
        value=T.clean_ai_text(labelled()),
    ),
)
_of_lines(
    "b8_clean_ocr_text",
    {"value": S.clean_ocr_text("'• ' || line"), "label": S.clean_ocr_text("' ' || CAST(pos AS VARCHAR) || '. '")},
    lambda: dict(
        value=T.clean_ocr_text(F.concat(F.lit('• '), F.col('line'))),
        label=T.clean_ocr_text(F.format_string(' %d. ', F.col('pos'))),
    ),
)
_of_lines(
    "b9_is_import_ai_ready",
    {"plain": S.is_import_ai_ready("line"), "label": S.is_import_ai_ready("'A. (' || CAST(pos AS VARCHAR) || ')'")},
    lambda: dict(
        plain=T.is_import_ai_ready(F.col('line')),
        label=T.is_import_ai_ready(F.format_string('A. (%d)', F.col('pos'))),
    ),
)


_KEEP = ("line", "(pos % 3 + 1)", "(pos * 17 % 100)", "(length(line) * 8)", "(pos % 40)")
QUERIES["b5_should_keep_line"] = lambda spark, d: A.doc_lines(spark, d).select(
    "doc_id", "pos", T.should_keep_line(F.col("line"), F.col("pos") % 3 + 1, F.col("pos") * 17 % 100, F.length("line") * 8, F.col("pos") % 40, F.lit(A.PAGE_WIDTH), F.lit(500)).alias("kept"))
SQL["b5_should_keep_line"] = f"WITH {A.DOC_LINES} SELECT doc_id, pos, {S.should_keep(*_KEEP, A.PAGE_WIDTH, 500)} AS kept FROM doc_lines"
_of_table(
    "b10_remove_markdown", "pages", "page_id",
    {"value": S.remove_markdown("html")},
    lambda: dict(
        value=T.remove_markdown(F.col('html')),
    ),
)
_of_lines(
    "b11_clean_line",
    {"once": S.clean_line(LABELLED), "twice": S.clean_line(S.clean_line(LABELLED))},
    lambda: dict(
        once=T.clean_line(labelled()),
        twice=T.clean_line(T.clean_line(labelled())),
    ),
)
_of_lines(
    "b12_is_junk",
    {"quiz": S.is_junk("line", 2), "game": S.is_junk("line", 3), "word": S.is_junk("split_part(line, ' ', 1)", 3)},
    lambda: dict(
        quiz=T.is_junk(F.col('line'), 2),
        game=T.is_junk(F.col('line'), 3),
        word=T.is_junk(F.split(F.col('line'), ' ')[0], 3),
    ),
)
_of_table(
    "b13_clean_context", "documents", "doc_id",
    {"quiz": S.clean_context("text"), "game": S.clean_context("text", 3, 8000)},
    lambda: dict(
        quiz=T.clean_context(F.col('text')),
        game=T.clean_context(F.col('text'), 3, 8000),
    ),
)
_of_table(
    "b14_split_sentences", "documents", "doc_id",
    {"quiz": f"array_to_string({S.split_sentences('text')}, '|')", "game": f"array_to_string({S.split_sentences('text', 22, 3)}, '|')"},
    lambda: dict(
        quiz=F.array_join(T.split_sentences(F.col('text')), '|'),
        game=F.array_join(T.split_sentences(F.col('text'), 22, 3), '|'),
    ),
)
_of_table(
    "b14_plain_sentences", "documents", "doc_id",
    {"value": f"array_to_string(list_filter(string_split({S.rr('text', r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1)), lambda x: length({S.trim('x')}) > 15), '|')"},
    lambda: dict(
        value=F.array_join(T.plain_sentences(F.col('text')), '|'),
    ),
)
_of_table(
    "b15_clean_book_text", "documents", "doc_id",
    {"value": S.collapse(S.rr(S.rr(S.rr(S.rr(S.nn("text"), r"(?m)^\s*\d+\s*$"), r"(?m)^\s*\d+[.)]\s*"), r"(?m)^\s*[A-Z][.)]\s*"), rf"(?m)^[{T.BULLETS}]\s*"))},
    lambda: dict(
        value=T.clean_book_text(F.col('text')),
    ),
)
_BAD = S.BAD_LINE
_of_lines(
    "b16_drop_bad_line",
    {"plain": f"({S.collapse('line')} = '' OR {S.rm(S.collapse('line'), _BAD)})", "number": S.rm("CAST(pos AS VARCHAR)", _BAD)},
    lambda: dict(
        plain=T.drop_bad_line(F.col('line')),
        number=T.drop_bad_line(F.col('pos').cast('string')),
    ),
)
_of_table(
    "b17_lesson_quiz_lines", "documents", "doc_id",
    {"value": f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.trim('x')}), lambda y: length(y) > 25 AND NOT starts_with(lower(y), 'image:') AND NOT contains(lower(y), 'choose the best answer'))[1:80], '|')"},
    lambda: dict(
        value=F.array_join(T.lesson_quiz_lines(F.col('text')), '|'),
    ),
)
_SOLID = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.trim('x')}), lambda y: y <> '')"
_of_table(
    "b18_text_lines", "documents", "doc_id",
    {n: f"array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.trim('x')}), lambda y: length(y) > {k}), '|')" for n, k in (("any_line", 0), ("long_line", 15))}
    | {"given": f"CASE WHEN len({_SOLID}) = 0 THEN 0 ELSE len({_SOLID}) END", "last_text": f"coalesce({_SOLID}[-1], '')"},
    lambda: dict(
        any_line=F.array_join(T.text_lines(F.col('text'), 0), '|'),
        long_line=F.array_join(T.text_lines(F.col('text'), 15), '|'),
        # lines as objects, as texts, or in one text, by document
        given=F.size(_lesson()).cast("long"),
        last_text=F.coalesce(F.get(_lesson(), F.size(_lesson()) - 1)["text"], F.lit("")),
    ),
)


def _lesson() -> Column:
    lines, k = T.text_lines(F.col("text")), F.col("doc_id") % 3
    objects = F.to_json(F.struct(F.struct(F.transform(lines, lambda x: F.struct(x.alias("lineText"))).alias("lines")).alias("lesson")))
    return T.lesson_lines(F.when(k == 0, objects).when(k == 1, F.to_json(F.struct(lines.alias("lines")))).otherwise(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))))


def _widest(x: str, first: str, last: str) -> tuple[str, str]:
    a, b = f"instr({x}, '{first}')", f"(length({x}) - instr(reverse({x}), '{last}') + 1)"
    return f"{a} > 0 AND instr({x}, '{last}') > 0 AND {b} > {a}", f"substr({x}, {a}, {b} - {a} + 1)"


def _extract(e: str, prefer: str = "array") -> str:
    (ok1, v1), (ok2, v2) = (_widest("v0", *p) for p in ([("[", "]"), ("{", "}")] if prefer == "array" else [("{", "}"), ("[", "]")]))
    return S.let(S.trim(S.rr(S.nn(e), r"(?i)```(?:json)?")), lambda x: f"CASE WHEN {ok1} THEN {v1} WHEN {ok2} THEN {v2} ELSE {x} END")


_of_table(
    "b19_extract_json", "documents", "doc_id",
    {"quiz": _extract("'```json' || chr(10) || '[{\"q\": ' || coalesce(text, '') || '}]' || chr(10) || '```'"), "game": _extract("'Here: {\"pairs\": [' || coalesce(text, '') || ']} end'", "object"), "plain": _extract("text")},
    lambda: dict(
        quiz=T.extract_json(F.concat(F.lit('```json\n[{"q": '), F.coalesce("text", F.lit("")), F.lit('}]\n```'))),
        game=T.extract_json(F.concat(F.lit('Here: {"pairs": ['), F.coalesce("text", F.lit("")), F.lit(']} end')), 'object'),
        plain=T.extract_json(F.col('text')),
    ),
)
_of_table(
    "b20_format_ai_output", "conversations", "conv_id, turn",
    {"value": S.trim(S.rr(S.rr(S.rr(S.rr(S.nn("text"), r"(?s)```.*?```"), r"\*\*|__|#"), r"(?m)^\s*-\s+", "• "), r"\n{3,}", "\n\n"))},
    lambda: dict(
        value=T.format_ai_output(F.col('text')),
    ),
)
_of_table(
    "b21_html_to_text", "pages", "page_id",
    {"value": f"substr({S.collapse(S.rr(S.rr(S.rr(S.nn('html'), r'(?is)<script.*?</script>'), r'(?is)<style.*?</style>'), '<[^>]*>', ' '))}, 1, 250)"},
    lambda: dict(
        value=T.html_to_text(F.col('html')),
    ),
)
_of_lines(
    "b22_normalize_sentence",
    {"value": f"lower({S.collapse(S.rr(S.nn('line'), '[.,!?;:]'))})", "words": f"array_to_string({S.split_words('line')}, '|')"},
    lambda: dict(
        value=T.normalize_sentence(F.col('line')),
        words=F.array_join(T.split_words(F.col('line')), '|'),
    ),
)
_of_table(
    "b23_slugify", "customer", "c_custkey",
    {n: f"coalesce(nullif({S.rr(S.rr(f'lower({e})', '[^a-z0-9]+', '-'), '^-|-' + chr(92) + 'z')}, ''), 'student')" for n, e in (("name", "c_name"), ("segment", "'  ' || c_mktsegment || '!!'"), ("blank", "'--'"))} | {"suffixed": f"coalesce(nullif({S.rr(S.rr('lower(c_name)', '[^a-z0-9]+', '-'), '^-|-' + chr(92) + 'z')}, ''), 'student') || '-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 6)"},
    lambda: dict(
        name=T.slugify(F.col('c_name')),
        segment=T.slugify(F.concat(F.lit('  '), F.col('c_mktsegment'), F.lit('!!'))),
        blank=T.slugify(F.lit('--')),
        suffixed=T.slugify(F.col('c_name'), F.col('c_custkey')),
    ),
)
_of_table(
    "b24_day_key", "events", "event_id",
    {"day": "strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d')"},
    lambda: dict(
        day=T.day_key(F.col('ts')),
    ),
)
_of_lines(
    "b25_weak_area",
    {"area": f"CASE WHEN {S.rm('lower(line)', 'is |are |was |were |have |has ')} THEN 'Grammar' WHEN length(line) < 45 THEN 'Vocabulary' ELSE 'Reading comprehension' END"},
    lambda: dict(
        area=T.weak_area(F.col('line')),
    ),
)
_of_lines(
    "b26_line_id",
    {"page": "format('page-{:03d}-line-{:03d}', CAST(doc_id % 999 AS INTEGER), pos + 1)", "lesson": "format('lesson-{:02d}-line-{:03d}', CAST(doc_id % 33 + 1 AS INTEGER), pos + 1)", "ai": "format('lesson-{:02d}-ai-line-{:03d}', CAST(doc_id % 33 + 1 AS INTEGER), pos + 1)"},
    lambda: dict(
        page=T.line_id('page', (F.col('doc_id') % 999).cast('int'), F.col('pos') + 1),
        lesson=T.line_id('lesson', (F.col('doc_id') % 33 + 1).cast('int'), F.col('pos') + 1),
        ai=T.line_id('lesson-ai', (F.col('doc_id') % 33 + 1).cast('int'), F.col('pos') + 1),
    ),
)


def b27_bbox_percent(spark: SparkSession, d: str) -> DataFrame:
    box = T.bbox_percent(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(A.PAGE_WIDTH), F.lit(A.PAGE_HEIGHT))
    return A.words(spark, d).select("page_no", "pos", box.alias("b")).select("page_no", "pos", *[F.round(f"b.{n}", 6).alias(f"{n}_pct") for n in ("left", "top", "width", "height")])


QUERIES["b27_bbox_percent"] = b27_bbox_percent
SQL["b27_bbox_percent"] = f"WITH {A.WORDS} SELECT page_no, pos, round(x / 1200.0 * 100, 6) AS left_pct, round(y / 1600.0 * 100, 6) AS top_pct, round(width / 1200.0 * 100, 6) AS width_pct, round(height / 1600.0 * 100, 6) AS height_pct FROM words"
_of_table(
    "b28_json_array", "events", "event_id",
    {"object": "'[]'", "array": "'[\"' || event_type || '\",\"' || CAST(event_id AS VARCHAR) || '\"]'", "bad": "'[]'", "none": "'[]'"},
    lambda: dict(
        object=F.to_json(T.json_array(F.col('props'))),
        array=F.to_json(T.json_array(F.concat(F.lit(' ["'), F.col('event_type'), F.lit('", '), F.col('event_id').cast('string'), F.lit(']')))),
        bad=F.to_json(T.json_array(F.lit('[1,'))),
        none=F.to_json(T.json_array(F.lit(None).cast('string'))),
    ),
)
_of_lines(
    "b29_unique_array",
    {"value": "array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(line, ' ')), lambda x: {'p': list_position(string_split(line, ' '), x), 'x': x})), lambda s: s.x), ' ')"},
    lambda: dict(
        value=F.array_join(F.array_distinct(F.split(F.col('line'), ' ', -1)), ' '),
    ),
)
_of_table(
    "b30_percent", "events", "event_id",
    {"pct": S.percent("(event_id % 11)", "(event_id % 7)")},
    lambda: dict(
        pct=T.percent(F.col('event_id') % 11, F.col('event_id') % 7),
    ),
)
_of_table(
    "b31_seeded_shuffle", "documents", "doc_id",
    None,
    lambda: dict(
        words=F.array_join(T.seeded_shuffle(T.split_words(F.col('text')), F.col('doc_id')), ' '),
        picked=F.array_join(T.pick(T.split_words(F.col('text')), 3, F.col('doc_id')), ' '),
    ),
)
_of_table(
    "b32_clamp_params", "events", "event_id",
    {"questions": "least(greatest(coalesce(event_id % 15, 5), 3), 10)", "pairs": "least(greatest(coalesce(event_id % 12, 6), 4), 8)", "page": "least(greatest(coalesce(event_id % 200, 1), 1), 105)", "level": "CASE WHEN event_type IN ('easy', 'medium', 'hard') THEN event_type ELSE 'medium' END"},
    lambda: dict(
        questions=T.clamp(F.col('event_id') % 15, 3, 10, 5),
        pairs=T.clamp(F.col('event_id') % 12, 4, 8, 6),
        page=T.clamp(F.col('event_id') % 200, 1, 105, 1),
        level=T.known_difficulty(F.col('event_type')),
    ),
)
