"""Queries over items and contexts, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import context as C
from lessonlake.operators import items as I
from lessonlake.plans import adapters as A
from lessonlake.plans import sql_text as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _contexts(spark, d, *variant):
    """The combined context of each document's first line and the rest, as the reader's page gives it; a null one has no items. A filter here would compute it twice."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), C.combined_context(lines[0], F.array_join(F.slice(lines, 2, F.size(lines)), "\n"), *variant).alias("context"))


def _context_sql(least: int = 2, most: int = 7000) -> str:
    """contexts(request_id, context)"""
    part = lambda e: S.clean_context(e, least, most)
    return f"""parts AS (SELECT doc_id, {part("string_split(coalesce(text, ''), chr(10))[1]")} AS a, {part("array_to_string(string_split(coalesce(text, ''), chr(10))[2:], chr(10))")} AS b FROM documents),
contexts AS (SELECT request_id, context FROM (SELECT doc_id AS request_id, {part("CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || chr(10) || b END")} AS context FROM parts) WHERE length(context) >= 20)"""


def _lessons(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("lesson_no"), F.concat(F.lit("Lesson "), F.col("doc_id").cast("string")).alias("title"), T.text_lines(F.col("text")).alias("lines"))


def _responses(spark, d, kind: str):
    """A response for each document: an item for each run of its words, of five or four."""
    w = T.split_words(F.col("text"))
    size = 5 if kind == "quiz" else 4
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / size).cast("int") - 1), lambda i: F.slice("w", i * size + 1, size))
    if kind == "quiz":
        item = lambda g, i: F.struct(F.concat(F.lit("Which word comes next after "), g[0]).alias("question"), F.array(g[1], g[2], F.translate(g[1], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), g[3], g[4]).alias("choices"), (i % 6).cast("string").alias("answerIndex"), g[2].alias("answer"))
    else:
        item = lambda g, i: F.struct(F.concat_ws(" ", g[0], g[1]).alias("term"), F.concat_ws(" ", g[2], g[3]).alias("meaning"))
    docs = A.table(spark, d, "documents").select("doc_id", w.alias("w"))
    items = docs.select("doc_id", F.when(F.size("w") >= size, F.transform(groups, item)).alias("i"))
    body = F.to_json(F.struct(F.coalesce("i", F.array()).alias("questions" if kind == "quiz" else "pairs")))
    for text, value in (("0", '""'), ("1", "true"), ("2", "2.0"), ("5", "null")):  # indexes of all kinds
        body = F.replace(body, F.lit(f'"answerIndex":"{text}"'), F.lit(f'"answerIndex":{value}'))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 7 == 1, F.substring(body, 1, 40)).otherwise(body)
    return items.select(F.col("doc_id").alias("request_id"), fenced.alias("body"))


def _groups_sql(size: int) -> str:
    """runs(request_id, i, g): the runs of words of each document whose response can be read."""
    return f"""w AS (SELECT doc_id AS request_id, {S.split_words('text')} AS w FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 <> 1),
runs AS (SELECT request_id, i, w[i * {size} + 1 : i * {size} + {size}] AS g FROM (SELECT *, unnest(range(len(w) // {size})) AS i FROM w))"""


@query
def d1_lesson_context(spark, d):
    lines = A.doc_lines(spark, d).select(F.concat_ws("-", "doc_id", "pos").alias("request_id"), F.when(F.col("pos") % 5 == 4, -1).otherwise(F.col("doc_id")).alias("lesson_no"), F.when(F.col("pos") % 3 == 2, "no such line").otherwise(F.concat(F.lit(" "), "line", F.lit(" "))).alias("line"))
    return C.lesson_context(lines, _lessons(spark, d))


_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.trim('x')}), lambda y: length(y) > 0)"
SQL["d1_lesson_context"] = f"""WITH {A.DOC_LINES}, r AS (SELECT doc_id || '-' || pos AS request_id, CASE WHEN pos % 5 = 4 THEN -1 ELSE doc_id END AS lesson_no, CASE WHEN pos % 3 = 2 THEN 'no such line' ELSE ' ' || line || ' ' END AS line FROM doc_lines),
l AS (SELECT doc_id AS lesson_no, {_LINES} AS lines FROM documents), j AS (SELECT r.*, lines, coalesce(list_position(list_transform(lines, lambda x: lower({S.trim('x')})), lower({S.trim('line')})), 0) AS spot FROM r LEFT JOIN l USING (lesson_no))
SELECT request_id, CASE WHEN lines IS NULL THEN 'Unknown lesson' ELSE 'Lesson ' || lesson_no END AS title, CASE WHEN lines IS NULL THEN line WHEN spot > 0 THEN array_to_string(lines[greatest(spot - 2, 1) : spot + 2], chr(10)) ELSE array_to_string(lines[1:5], chr(10)) END AS context,
CASE WHEN lines IS NULL THEN '' ELSE array_to_string(lines[1:25], chr(10)) END AS preview FROM j"""


@query
def d2_page_context(spark, d):
    lines = T.text_lines(F.col("text"))
    ready = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("text")))
    return A.table(spark, d, "documents").select("doc_id", C.page_context(ready, F.when(F.col("doc_id") % 3 == 1, F.slice(lines, 1, 3)), lines).alias("context"))


SQL["d2_page_context"] = f"""SELECT doc_id, {S.clean_context('c')} AS context FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END WHEN doc_id % 3 = 1 THEN array_to_string({_LINES}[1:3], chr(10)) ELSE array_to_string({_LINES}, chr(10)) END AS c FROM documents)"""


@query
def d3_combined_context(spark, d):
    first = F.concat(F.lit("1. A. "), F.split("text", "\n")[0])
    return A.table(spark, d, "documents").select("doc_id", C.combined_context(first, F.col("text")).alias("context"))


SQL["d3_combined_context"] = f"""WITH p AS (SELECT doc_id, {S.clean_context("'1. A. ' || string_split(text, chr(10))[1]")} AS a, {S.clean_context('text')} AS b FROM documents),
c AS (SELECT doc_id, {S.clean_context("CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || chr(10) || b END")} AS x FROM p) SELECT doc_id, CASE WHEN length(x) >= 20 THEN x END AS context FROM c"""


@query
def d5_build_prompts(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("tutor", "help", "quiz", "match"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), kinds.alias("kind"), F.lit("A lesson").alias("title"), F.split("text", "\n")[0].alias("line"), T.clean_context(F.col("text")).alias("context"), F.struct(F.lit(None).cast("string").alias("last_line"), F.col("n_chars").alias("n")).alias("memory"),
        F.when(F.col("doc_id") % 3 == 0, "explain").alias("tool"), F.when(F.col("doc_id") % 5 == 0, "Why?").alias("question"), F.when(F.col("doc_id") % 2 == 0, "hard").alias("level"),
    )
    return C.build_prompts(rows)


def _map(values: dict[str, str], of: str, default: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in values.items()) + f" ELSE {S.q(default)} END"


SQL["d5_build_prompts"] = f"""WITH r AS (SELECT doc_id AS request_id, ['tutor', 'help', 'quiz', 'match'][doc_id % 4 + 1] AS kind, string_split(text, chr(10))[1] AS line, {S.clean_context('text')} AS context, to_json({{'last_line': NULL, 'n': n_chars}}) AS memory,
CASE WHEN doc_id % 3 = 0 THEN 'explain' END AS tool, CASE WHEN doc_id % 5 = 0 THEN 'Why?' ELSE 'No extra question' END AS question, CASE WHEN doc_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS level FROM documents)
SELECT request_id, kind, CASE WHEN kind IN ('tutor', 'help') THEN 'Lesson: A lesson' || chr(10) || 'Line: ' || coalesce(line, '') || chr(10) || 'Context: ' || context || chr(10) || 'Memory: ' || memory || chr(10) || {_map(C.TOOLS, 'tool', 'Help with the line.')} || chr(10) || 'Question: ' || question
ELSE 'Write ' || kind || ' items as JSON from this text.' || chr(10) || {_map(C.DIFFICULTY, 'level', '')} || chr(10) || context END AS prompt,
CASE kind WHEN 'tutor' THEN 0.3 WHEN 'help' THEN 0.2 WHEN 'match' THEN CASE level WHEN 'hard' THEN 0.5 ELSE 0.3 END ELSE CASE level WHEN 'hard' THEN 0.55 ELSE 0.35 END END::DOUBLE AS temperature FROM r"""


@query
def d6_line_help(spark, d):
    lines = A.doc_lines(spark, d).select(F.concat_ws("-", "doc_id", "pos").alias("line_id"), F.length("line").alias("n"))
    return C.line_help(lines.select(F.col("line_id").alias("request_id"), "line_id"), lines.where("n % 2 = 0").select("line_id", F.col("n").alias("helper"))).select("request_id", "helper", "found")


SQL["d6_line_help"] = f"WITH {A.DOC_LINES} SELECT doc_id || '-' || pos AS request_id, CASE WHEN length(line) % 2 = 0 THEN length(line) END AS helper, length(line) % 2 = 0 AS found FROM doc_lines"


@query
def d7_parse_help(spark, d):
    good = F.to_json(F.struct(F.col("text").alias("simple"), F.col("role").alias("grammar")))
    body = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("turn") % 4 == 1, "").when(F.col("turn") % 4 == 2, F.col("text")).otherwise(good)
    return A.table(spark, d, "conversations").select("conv_id", "turn", C.parse_help(body).alias("h")).select("conv_id", "turn", "h.*")


SQL["d7_parse_help"] = """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'No help yet.' WHEN 2 THEN CASE WHEN coalesce(text, '') = '' THEN 'No help yet.' END ELSE text END AS simple,
CASE WHEN turn % 4 = 1 OR turn % 4 = 2 AND coalesce(text, '') = '' THEN '' END AS bangla, CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN CASE WHEN coalesce(text, '') = '' THEN '' END ELSE role END AS grammar, CASE WHEN turn % 4 = 2 AND coalesce(text, '') <> '' THEN 'bad JSON' END AS error FROM conversations"""


@query
def d8_assemble_answer(spark, d):
    part = F.struct(F.col("text").alias("text"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part, part).alias("parts")).alias("content"))).alias("candidates")))
    return A.table(spark, d, "conversations").select("conv_id", "turn", C.assemble_answer(F.when(F.col("turn") % 3 == 1, "{}").otherwise(body), F.col("turn") % 5 != 4).alias("a")).select("conv_id", "turn", "a.*")


SQL["d8_assemble_answer"] = f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN {S.q(C.NO_TUTOR)} WHEN turn % 3 = 1 OR {S.trim("coalesce(text || text, '')")} = '' THEN 'No response generated.' ELSE {S.trim('text || text')} END AS answer,
CASE WHEN turn % 5 = 4 THEN 'fallback' ELSE 'model' END AS source FROM conversations"""


@query
def e1_validate_quiz(spark, d):
    return I.validate_quiz(_responses(spark, d, "quiz")).withColumn("options", F.array_join("options", "|"))


SQL["e1_validate_quiz"] = f"""WITH {_groups_sql(5)},
q AS (SELECT request_id, i, {S.clean_line("'Which word comes next after ' || g[1]")} AS question, list_filter(list_transform([g[2], g[3], translate(g[2], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), g[4], g[5]], lambda x: {S.clean_line('x')}), lambda y: NOT {S.is_junk('y')}) AS o, {S.clean_line('g[3]')} AS answer, CAST(i % 6 AS INTEGER) AS a FROM runs),
u AS (SELECT *, list_transform(list_filter(list_transform(o, lambda x, j: {{'x': x, 'first': list_position(list_transform(o, lambda z: lower(z)), lower(x)) = j}}), lambda s: s.first), lambda s: list_filter(o, lambda z: lower(z) = lower(s.x))[-1]) AS u FROM q),
c AS (SELECT *, CASE WHEN a BETWEEN 0 AND 3 THEN a ELSE coalesce(list_position(list_transform(u, lambda z: lower(z)), lower(answer)), 0) - 1 END AS correct_index FROM u WHERE len(u) = 4 AND NOT {S.is_junk('question')} AND length(question) >= 10)
SELECT request_id, position, question, array_to_string(u, '|') AS options, correct_index, {S.q(I.EXPLANATION)} AS explanation FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i) AS position FROM c WHERE correct_index BETWEEN 0 AND 3) WHERE position <= 5"""


@query
def e2_fallback_quiz(spark, d):
    return I.fallback_quiz(_contexts(spark, d)).withColumn("options", F.array_join("options", "|"))


_STOP = "[" + ", ".join(map(S.q, I.POOL_STOP)) + "]"
_ANSWER_STOP = "[" + ", ".join(map(S.q, I.ANSWER_STOP)) + "]"
_NEAR = "list_filter(x.pool, lambda w: w <> lower(x.a) AND abs(length(w) - length(x.a)) <= 4)[acc.n + 1 : acc.n + 3]"
_BLANK = r"regexp_replace(x.s, '(?i)(^|[^A-Za-z0-9_])' || x.a || '($|[^A-Za-z0-9_])', '\1_____\2')"
_ITEM = "STRUCT(s VARCHAR, a VARCHAR, d VARCHAR[])"
SQL["e2_fallback_quiz"] = f"""WITH {_context_sql()}, s AS (SELECT request_id, {S.split_sentences('context')} AS l FROM contexts),
p AS (SELECT request_id, l, list_filter(flatten(list_transform(l, lambda x: regexp_extract_all(lower(x), '[a-z]{{4,}}'))), lambda w: NOT list_contains({_STOP}, w)) AS words FROM s),
f AS (SELECT request_id, l, list_transform(list_filter(list_transform(words, lambda w, i: {{'w': w, 'first': list_position(words, w) = i}}), lambda t: t.first), lambda t: t.w) AS pool FROM p),
r AS (SELECT request_id, list_transform(l, lambda x: {{'s': x, 'a': list_filter(regexp_extract_all(x, '[A-Za-z]{{5,}}'), lambda w: NOT list_contains({_ANSWER_STOP}, lower(w)))[1], 'pool': pool}}) AS r FROM f),
m AS (SELECT request_id, list_reduce(r, lambda acc, x: CASE WHEN acc.n >= 5 OR x.a IS NULL OR len({_NEAR}) < 3 THEN acc ELSE {{'n': acc.n + 1, 'items': list_append(acc.items, {{'s': {_BLANK}, 'a': x.a, 'd': {_NEAR}}})}} END, {{'n': 0::BIGINT, 'items': []::{_ITEM}[]}}) AS m FROM r),
q AS (SELECT request_id, unnest(m.items) AS q, unnest(range(len(m.items))) + 1 AS position FROM m)
SELECT request_id, position, 'Choose the correct word to complete the sentence: ' || q.s AS question, upper(q.d[1][1]) || q.d[1][2:] || '|' || q.a || '|' || upper(q.d[2][1]) || q.d[2][2:] || '|' || upper(q.d[3][1]) || q.d[3][2:] AS options, 1 AS correct_index, '"' || q.a || '" correctly completes the sentence from the textbook.' AS explanation FROM q"""


def _top_up_input(spark, d, most: int):
    """Valid items of each document's first lines (0 to most - 1 of them), fallback items of all its lines, twice."""
    lines = A.doc_lines(spark, d).select(F.col("doc_id").alias("request_id"), "pos", F.col("line").alias("item"))
    valid = lines.where(F.col("pos") < F.col("request_id") % most).select("request_id", (F.col("pos") + 1).alias("position"), F.translate("item", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("item"))
    copies = lines.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select("request_id", (F.col("pos") * 2 + F.col("copy") + 1).alias("position"), "item")
    return valid, copies


def _top_up_sql(most: int, least: int, n: int, need: int, distinct: bool) -> str:
    return f"""WITH {A.DOC_LINES}, v AS (SELECT doc_id AS request_id, pos + 1 AS position, translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS item, 0 AS part FROM doc_lines WHERE pos < doc_id % {most}), c AS (SELECT request_id, count(*) AS n FROM v GROUP BY 1),
f AS (SELECT doc_id AS request_id, pos * 2 + copy + 1 AS position, line AS item, 1 AS part FROM doc_lines, (VALUES (0), (1)) t(copy) WHERE coalesce((SELECT n FROM c WHERE c.request_id = doc_id), 0) < {least}),
g AS (SELECT *, row_number() OVER (PARTITION BY request_id, lower(item) ORDER BY position) AS seen FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.request_id = f.request_id AND lower(v.item) = lower(f.item))),
e AS (SELECT * FROM v UNION ALL SELECT request_id, position, item, part FROM g {'WHERE seen = 1' if distinct else ''}), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY part, position) AS spot FROM e)
SELECT request_id, item, part, spot AS position FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS total FROM r WHERE spot <= {n}) WHERE total >= {need}"""


@query
def e3_top_up_quiz(spark, d):
    return I.top_up(*_top_up_input(spark, d, 4), "item", 3, 5)


SQL["e3_top_up_quiz"] = _top_up_sql(4, 3, 5, 1, False)


@query
def e4_lesson_quiz(spark, d):
    return I.lesson_quiz(A.table(spark, d, "documents").select(F.col("doc_id").alias("lesson_no"), "text"))


@query
def e5_validate_pairs(spark, d):
    return I.validate_pairs(_responses(spark, d, "pairs"))


_PAIR = "STRUCT(l VARCHAR, r VARCHAR)"
SQL["e5_validate_pairs"] = f"""WITH {_groups_sql(4)}, c AS (SELECT request_id, i, {S.clean_line("g[1] || ' ' || g[2]")} AS l, {S.clean_line("g[3] || ' ' || g[4]")} AS r FROM runs),
p AS (SELECT request_id, list({{'l': l, 'r': r}} ORDER BY i) AS p FROM c WHERE NOT {S.is_junk('l', 3)} AND NOT {S.is_junk('r', 3)} AND length(l) >= 4 AND length(r) >= 4 AND lower(l) <> lower(r) GROUP BY 1),
m AS (SELECT request_id, list_reduce(p, lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda k: lower(k.l) = lower(x.l) OR lower(k.r) = lower(x.r))) > 0 THEN acc ELSE list_append(acc, x) END, []::{_PAIR}[]) AS m FROM p),
q AS (SELECT request_id, unnest(m) AS q, unnest(range(len(m))) + 1 AS position FROM m) SELECT request_id, position, q.l AS "left", q.r AS "right" FROM q"""


@query
def e6_fallback_pairs(spark, d):
    return I.fallback_pairs(_contexts(spark, d, 3, 8000))


_HALF = "CAST(ceil(len(w) / 2.0) AS BIGINT)"
SQL["e6_fallback_pairs"] = f"""WITH {_context_sql(3, 8000)}, s AS (SELECT request_id, {S.split_sentences('context', 22, 3)} AS l FROM contexts), x AS (SELECT request_id, unnest(l) AS s, unnest(range(len(l))) AS spot FROM s), w AS (SELECT *, regexp_split_to_array(s, '\\s+') AS w FROM x),
p AS (SELECT request_id, spot, s AS explanation, {S.clean_line(f"array_to_string(w[1 : {_HALF}], ' ') || ' ...'")} AS l, {S.clean_line(f"'... ' || array_to_string(w[{_HALF} + 1 :], ' ')")} AS r FROM w WHERE len(w) >= 8)
SELECT * FROM (SELECT request_id, l AS "left", r AS "right", explanation, row_number() OVER (PARTITION BY request_id ORDER BY spot) AS position FROM p WHERE NOT {S.is_junk('l', 3)} AND NOT {S.is_junk('r', 3)}) WHERE position <= 6"""


@query
def e7_top_up_pairs(spark, d):
    return I.top_up(*_top_up_input(spark, d, 5), "item", 4, 6, 4, distinct=True)


SQL["e7_top_up_pairs"] = _top_up_sql(5, 4, 6, 4, True)


@query
def e8_grammar_questions(spark, d):
    return A.doc_lines(spark, d).select("doc_id", "pos", I.grammar_question(F.col("line")).alias("g")).select("doc_id", "pos", "g.kind", "g.answer", F.array_join("g.options", "|").alias("options"))


def _e8() -> str:
    among = lambda words: "list_filter(w, lambda x: list_contains([" + ", ".join(map(S.q, words)) + "], lower(x)))[1]"
    of = lambda c, default: f"coalesce({c}, {S.q(default)})"
    row = lambda kind, *o: f"{{'kind': {S.q(kind)}, 'answer': {o[0]}, 'options': {' || chr(124) || '.join(o)}}}"
    return rf"""WITH {A.DOC_LINES}, s AS (SELECT doc_id, pos, line, {S.split_words('line')} AS w, regexp_extract(line, '(?i)\b(?:was|were)\s+\w+ing\b') AS past FROM doc_lines),
p AS (SELECT *, {among(I.BE)} AS be, {among(I.PREPOSITIONS)} AS prep, {among(I.CONJUNCTIONS)} AS conj, w[1] AS head, w[-1] AS tail FROM s),
g AS (SELECT doc_id, pos, CASE WHEN past <> '' THEN {row('past continuous', 'past', of('head', 'The'), of('prep', 'at'), of('tail', 'station'))} WHEN be IS NOT NULL THEN {row('be-verb', 'be', of('head', 'The'), of('prep', 'in'), of('conj', 'and'))}
WHEN prep IS NOT NULL THEN {row('preposition', 'prep', of('head', 'The'), of('tail', 'school'), of('conj', 'and'))} WHEN conj IS NOT NULL THEN {row('conjunction', 'conj', of('head', 'The'), of('tail', 'school'), of('prep', 'in'))}
ELSE {row('word', 'coalesce(head, line)', "'computer'", "'mountain'", "'airport'")} END AS g FROM p) SELECT doc_id, pos, g.kind, g.answer, g.options FROM g"""


SQL["e8_grammar_questions"] = _e8()


@query
def e11_coerce_quiz_items(spark, d):
    k, text = F.col("turn"), F.col("text")
    item = F.struct(F.when(k % 3 == 0, F.concat(F.lit("id-"), "conv_id")).alias("id"), F.when(k % 4 != 1, text).alias("question"), F.when(k % 5 != 2, F.split(text, " ")).alias("options"), F.when(k % 2 == 0, F.col("role")).alias("correctAnswer"), F.when(k % 3 != 1, F.lit("x")).alias("correctAns"))
    body = F.when(k % 7 == 6, F.to_json(F.struct(F.array(item, item).alias("quiz")))).otherwise(F.to_json(F.struct(F.array(item).alias("questions"))))
    made = I.coerce_quiz_items(A.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), body.alias("body")))
    return made.withColumn("options", F.array_join("options", "|")).drop("context", "explanation", "weak_area")


SQL["e11_coerce_quiz_items"] = """WITH c AS (SELECT conv_id || '-' || turn AS request_id, unnest(CASE WHEN turn % 7 = 6 THEN [1, 2] ELSE [1] END) AS position, * FROM conversations)
SELECT request_id, position, CASE WHEN turn % 3 = 0 THEN 'id-' || conv_id ELSE CAST(position AS VARCHAR) END AS item_id, CASE WHEN turn % 4 <> 1 THEN text ELSE 'Choose the best answer.' END AS question, array_to_string(string_split(text, ' '), '|') AS options,
CASE WHEN turn % 2 = 0 THEN role ELSE 'x' END AS correct_answer FROM c WHERE turn % 5 <> 2 AND (turn % 2 = 0 OR turn % 3 <> 1)"""


@query
def e9_word_bank(spark, d):
    return A.doc_lines(spark, d).select("doc_id", "pos", F.array_join(I.word_bank(F.col("line"), F.xxhash64("doc_id", "pos")), " ").alias("bank"))


@query
def e10_match_choices(spark, d):
    return I.match_choices(I.fallback_pairs(_contexts(spark, d, 3, 8000)))
