"""Text functions, Column -> Column. White space is Unicode's throughout; lengths count code points."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•●▪◦"
#: Header and footer lines of the book (fixed values).
HEADER_FOOTER = (r"english for today", r"class six", r"2026", r"\d+", r"forma-\d+.*", r"national curriculum.*")
#: How instruction lines begin (fixed values).
INSTRUCTIONS = (
    "after completing the lesson", "choose the best", "match a word", "look at the picture", "look at the pictures", "talk about",
    "discuss", "practise", "practice", "work in groups", "work with a partner", "answer the following", "write a paragraph",
    "write down", "listen to", "listen and", "read the following", "complete the", "fill in", "suppose you", "notice the", "imagine that",
)
#: Short texts that carry nothing (fixed values). The quiz's set has the bracketed letters too.
JUNK_GAME = (".", ",", ":", ";", "-", "_", "•", "●", "▪", "◦", "a", "b", "c", "d", "a.", "b.", "c.", "d.", "1", "2", "3", "4", "1.", "2.", "3.", "4.")
JUNK_QUIZ = (*JUNK_GAME, "a)", "b)", "c)", "d)")
#: Unicode's white space, as a class of its own: (?U) makes every class of a pattern slow.
WS = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as a set of characters, for F.trim.
SPACES = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that hold all white space but the space, and bullets and dashes beside it.
SPECIAL = r"[\x00-\x1f\x7f-\u00a0\u1680-\uffff]"
#: The same as bytes of UTF-8: those that are white space, or begin characters among which it is. A search for a byte reads the text as it is stored.
SPECIAL_BYTES = (b"\t", b"\n", b"\v", b"\f", b"\r", b"\xc2", b"\xe1", b"\xe2", b"\xe3")
#: The marks of markdown, and punctuation after a space.
MARKS = ("`", "*", "_", "<", "#")
AFTER_SPACE = (" ,", " .", " !", " ?", " ;", " :")
LINE_LABEL = rf"^{WS}*(?:[{BULLETS}*–—-]+|\(?\d+\)?[.)]|[A-Da-d][.)]){WS}*"
LABEL = r"(?i)^(?:\d+[.)]?|[a-z][.)]?|[ivxlcdm]+[.)]?|[.,:;!?()\-]+)\z"


def let(value: Column, f) -> Column:
    """f(value), with the value computed once: cleaning chains are long, and inlined copies overflow generated code."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def changed(c: Column, sign, f) -> Column:
    """f(c) where sign(c), a test for something to change, holds, else c itself: most texts are clean, and a search is cheaper than a chain."""
    return let(c, lambda x: F.when(sign(x), f(x)).otherwise(x))


def _open(x: Column) -> Column:
    return x.startswith(" ") | x.endswith(" ")


def _any_of(x: Column, parts: tuple) -> Column:
    return reduce(or_, [F.contains(x, F.lit(p)) for p in parts])


def _loose(x: Column) -> Column:
    """Whether collapse() may change x."""
    return x.contains("  ") | _open(x) | _any_of(x.cast("binary"), SPECIAL_BYTES)


def trim(c: Column) -> Column:
    return changed(c, lambda x: _open(x) | F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(SPECIAL), lambda x: replace(x, rf"^{WS}+|{WS}+\z"))


def _collapse(c: Column) -> Column:
    return F.trim(replace(c, rf"{WS}+", " "))  # which leaves no other white space


def collapse(c: Column) -> Column:
    return changed(c, _loose, _collapse)


def _bulleted(x: Column) -> Column:
    return x.contains("**") | _loose(x)  # bullets are among the characters that the special bytes begin


def normalize_text(c: Column) -> Column:
    return changed(F.coalesce(c, F.lit("")), _bulleted, lambda x: _collapse(replace(replace(x, r"\*\*"), f"[{BULLETS}]", " ")))


def normalize_word(c: Column) -> Column:
    """normalize_text of short texts that seldom need it: one search tells whether."""
    return F.when(~c.rlike(r"\*\*|[\x00-\x20\x7f-\u00a0\u1680-\uffff]"), c).otherwise(normalize_text(c))


def alphabet_ratio(c: Column) -> Column:
    solid = F.length(F.when(_any_of(c.cast("binary"), SPECIAL_BYTES), replace(c, rf"{WS}+")).otherwise(F.replace(c, F.lit(" "), F.lit(""))))
    return let(solid, lambda n: F.when(n == 0, 0.0).otherwise(F.length(replace(c, "[^A-Za-z]+")) / n))


def is_label_only(c: Column) -> Column:
    return trim(c).rlike(LABEL)


def is_header_or_footer(c: Column, patterns: tuple[str, ...] = HEADER_FOOTER) -> Column:
    return F.lower(trim(c)).rlike(rf"^(?:{'|'.join(patterns)})\z")


def is_ai_ready(c: Column) -> Column:
    starts = F.lower(c).rlike(rf"^(?:{'|'.join(INSTRUCTIONS)})")
    return (F.length(c) >= 14) & ~is_label_only(c) & (alphabet_ratio(c) >= 0.55) & ~starts


def clean_ai_text(c: Column) -> Column:
    return let(normalize_text(c), lambda x: normalize_text(replace(replace(replace(x, r"(?U)^\s*\d+[.)]\s+"), r"(?U)^\s*[A-Da-d][.)]\s+"), r"(?iU)^\s*[ivxlcdm]+[.)]\s+")))


def should_keep_line(text: Column, n_words: Column, confidence: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    # the numbers first: they are cheap
    return (
        (confidence >= 52) & (width >= F.greatest(F.lit(24.0), page_width * 0.018)) & (height >= 6) & (height <= page_height * 0.07)
        & (F.length(text) >= 4) & ~((n_words == 1) & (F.length(text) < 8)) & text.rlike("[A-Za-z]") & ~is_label_only(text) & ~is_header_or_footer(text) & (alphabet_ratio(text) >= 0.42)
    )


def _no_bullet(x: Column) -> Column:
    return F.when(F.substring(x, 1, 1).isin(*BULLETS), F.ltrim(F.substr(x, F.lit(2)))).otherwise(x)


def _no_label(x: Column) -> Column:
    label = (x.endswith(".") | x.endswith(")")) & x.rlike(r"^(?:\p{Nd}+|[A-Da-d])[.)]\z")
    return F.when(label, "").otherwise(x)


#: The steps of clean_ocr_text: bold marks and one bullet go, white space is collapsed, a label alone is empty. A column for each step is
#: compiled, which let() isn't.
OCR_STEPS = (lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("**"), F.lit("")), _no_bullet, lambda x: F.when(_loose(x), _collapse(x)).otherwise(x), _no_label)


def clean_ocr_text(c: Column) -> Column:
    return reduce(let, OCR_STEPS, c)


def is_import_ai_ready(c: Column) -> Column:
    # a letter beyond D is both a letter and no part of a label: most texts have one
    return (F.length(c) >= 4) & (c.rlike("[E-Ze-z]") | (c.rlike("[A-Za-z]") & c.rlike(rf"[^A-Da-d\p{{Nd}}{WS[1:-1]}.()]")))


def _remove_markdown(c: Column) -> Column:
    def marks(x: Column) -> Column:
        x = replace(replace(x, r"(?i)```(?:json)?"), r"\*\*|__")
        return replace(replace(x, rf"(?m)^#{{1,6}}{WS}*"), "<[^>]+>", " ")

    return trim(changed(c, lambda x: _any_of(x, MARKS), marks))


def remove_markdown(c: Column) -> Column:
    return _remove_markdown(F.coalesce(c, F.lit("")))


def clean_line(c: Column) -> Column:
    def chain(x: Column) -> Column:
        x = changed(replace(_remove_markdown(x), LINE_LABEL), _loose, lambda y: replace(y, rf"{WS}+", " "))
        return F.trim(replace(x, r" +([,.!?;:])", "$1"))

    unclean = lambda x: _loose(x) | _any_of(x, (*MARKS, *AFTER_SPACE)) | x.rlike(LINE_LABEL)
    return changed(F.coalesce(c, F.lit("")), unclean, chain)


def _again(x: Column) -> Column:
    """clean_line of a text that it has cleaned before: only marks that stood apart, or a second label, are left to it."""
    return F.when(_any_of(x, MARKS) | x.rlike(LINE_LABEL), clean_line(x)).otherwise(x)


def _junk(cleaned: Column, min_length: int) -> Column:
    junk = JUNK_QUIZ if min_length < 3 else JUNK_GAME
    longest = max(map(len, junk))
    short = (F.length(cleaned) <= longest) & (F.lower(cleaned).isin(*junk) | cleaned.rlike(r"^[A-Da-d][.)]?\z"))
    return (F.length(cleaned) < max(min_length, 1)) | short | ~cleaned.rlike("[A-Za-z]")  # without letters are also numbers and signs alone


def is_junk(c: Column, min_length: int = 2) -> Column:
    """min_length: 2 for quizzes, 3 for games. The text is cleaned once more, whatever was done to it before."""
    return let(clean_line(c), lambda x: _junk(x, min_length))


def is_clean_junk(c: Column, min_length: int = 2) -> Column:
    """is_junk of a result of clean_line, which seldom has to be cleaned once more."""
    return let(_again(c), lambda x: _junk(x, min_length))


def clean_context(c: Column, min_length: int = 2, max_chars: int = 7000, before: bool = False) -> Column:
    """7000 characters for quizzes, 8000 for games. before: c is made of results of this function, each cut at max_chars, so a line is cleaned
    again only where it has a second label or an end that was cut, or where the whole has marks, which may reach over lines."""

    def lines(text: Column, marked: Column | None) -> Column:
        clean = clean_line if marked is None else lambda x: F.when(marked | x.endswith(" ") | x.rlike(LINE_LABEL), clean_line(x)).otherwise(x)
        return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n", -1), clean), lambda x: (F.length(x) >= 8) & ~is_clean_junk(x, min_length)), "\n")

    kept = let(c, lambda x: let(_any_of(x, MARKS), lambda marked: lines(remove_markdown(x), marked))) if before else lines(remove_markdown(c), None)
    return F.substring(kept, 1, max_chars)


def split_sentences(c: Column, min_length: int = 20, junk_length: int = 2) -> Column:
    """20 characters for quizzes, 22 for games."""
    parts = F.transform(F.split(replace(c, r"\n+", " "), rf"(?<=[.!?]){WS}+", -1), clean_line)
    return F.filter(parts, lambda x: (F.length(x) >= min_length) & x.rlike("[A-Za-z]{3,}") & ~is_clean_junk(x, junk_length))


def plain_sentences(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?<=[.!?]){WS}+", -1), lambda x: F.length(trim(x)) > 15)


def clean_book_text(c: Column) -> Column:
    x = replace(replace(F.coalesce(c, F.lit("")), r"(?mU)^\s*\d+\s*$"), r"(?mU)^\s*\d+[.)]\s*")
    return collapse(replace(replace(x, r"(?mU)^\s*[A-Z][.)]\s*"), rf"(?mU)^[{BULLETS}]\s*"))


def drop_bad_line(c: Column) -> Column:
    return let(collapse(F.coalesce(c, F.lit(""))), lambda x: (x == "") | x.rlike(r"^(?:\d+\z|[A-D]\.\z|[a-d]\)\z|[•●▪]|\.\z)"))


def lesson_quiz_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), trim)
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 25) & ~F.lower(x).startswith("image:") & ~F.lower(x).contains("choose the best answer")), 1, 80)


def text_lines(c: Column, min_length: int = 0) -> Column:
    """Trimmed lines longer than min_length."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), trim), lambda x: F.length(x) > min_length)


def lesson_lines(body: Column) -> Column:
    """array<struct<id, text>> of a lesson's JSON: lines as texts or as objects with aliases, in the lesson or beside it; without any, the
    lines of its text. Blank ones go, after numbering."""
    line = "array<string>"
    shape = f"lesson struct<lines:{line},text:string>, lines {line}, text string"

    def of(p: Column) -> Column:
        item = lambda x, *names: F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in names])
        number = lambda i: F.concat(F.lit("line-"), (i + 1).cast("string"))
        given = F.transform(F.coalesce(p["lesson"]["lines"], p["lines"]), lambda x, i: F.when(
            x.startswith("{"), F.struct(F.coalesce(item(x, "id", "lineId"), number(i)).alias("id"), F.coalesce(item(x, "text", "lineText", "content"), F.lit("")).alias("text"))
        ).otherwise(F.struct(number(i).alias("id"), F.coalesce(x, F.lit("")).alias("text"))))
        plain = F.transform(F.filter(F.transform(F.split(F.coalesce(p["lesson"]["text"], p["text"], F.lit("")), r"\r?\n", -1), trim), lambda x: x != ""), lambda x, i: F.struct(number(i).alias("id"), x.alias("text")))
        return F.when(F.size(given) > 0, F.filter(given, lambda r: trim(r["text"]) != "")).otherwise(plain)

    return let(F.from_json(body, shape), of)


def extract_json(c: Column, prefer: str = "array") -> Column:
    """The widest array, else the widest object (the other way round for prefer='object'), else the whole text."""

    def widest(x: Column, first: str, last: str) -> Column:
        ends = F.struct(F.instr(x, first).alias("a"), (F.length(x) - F.length(F.substring_index(x, last, -1))).alias("b"))  # b is 0 without last
        return let(ends, lambda p: F.when((p["a"] > 0) & (p["b"] > p["a"]), F.substring(x, p["a"], p["b"] - p["a"] + 1)))

    pairs = [("[", "]"), ("{", "}")]
    pick = lambda x: F.coalesce(*[widest(x, *p) for p in (pairs if prefer == "array" else pairs[::-1])], x)
    return let(trim(changed(F.coalesce(c, F.lit("")), lambda x: x.contains("```"), lambda x: replace(x, r"(?i)```(?:json)?"))), pick)


def strip_fence(c: Column) -> Column:
    return trim(replace(replace(trim(F.coalesce(c, F.lit(""))), r"(?iU)^```(?:json)?\s*"), r"(?U)\s*```\z"))


def format_ai_output(c: Column) -> Column:
    x = replace(replace(F.coalesce(c, F.lit("")), r"(?s)```.*?```"), r"\*\*|__|#")
    return trim(replace(replace(x, r"(?mU)^\s*-\s+", "• "), r"\n{3,}", "\n\n"))


def html_to_text(c: Column, max_chars: int = 250) -> Column:
    x = replace(replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>"), r"(?is)<style.*?</style>")
    return F.substring(collapse(replace(x, "<[^>]*>", " ")), 1, max_chars)


def normalize_sentence(c: Column) -> Column:
    return F.lower(collapse(replace(F.coalesce(c, F.lit("")), "[.,!?;:]")))


def split_words(c: Column) -> Column:
    return F.filter(F.split(collapse(replace(F.coalesce(c, F.lit("")), '[.,!?;:"]')), " ", -1), lambda x: x != "")


def slugify(c: Column, suffix: Column | None = None) -> Column:
    """suffix: a value whose hash tells equal slugs apart."""
    x = replace(replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), r"^-|-\z")
    slug = F.when(x == "", "student").otherwise(x)
    return slug if suffix is None else F.concat_ws("-", slug, F.substring(F.sha2(suffix.cast("string"), 256), 1, 6))


def day_key(ts: Column) -> Column:
    return F.date_format(ts + F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd")


def weak_area(c: Column) -> Column:
    return F.when(F.lower(c).rlike("(?:is|are|was|were|have|has) "), "Grammar").when(F.length(c) < 45, "Vocabulary").otherwise("Reading comprehension")


def line_id(kind: str, number: Column, line: Column) -> Column:
    forms = {"page": "page-%03d-line-%03d", "lesson": "lesson-%02d-line-%03d", "lesson-ai": "lesson-%02d-ai-line-%03d"}
    return F.format_string(forms[kind], number, line)


def bbox_percent(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return F.struct((x / page_width * 100).alias("left"), (y / page_height * 100).alias("top"), (width / page_width * 100).alias("width"), (height / page_height * 100).alias("height"))


def json_array(c: Column) -> Column:
    return F.coalesce(F.from_json(F.when(trim(c).startswith("["), c), "array<string>"), F.array().cast("array<string>"))


def percent(score: Column, total: Column) -> Column:
    """Half up; 0 where total is not positive."""
    return F.when(total > 0, F.floor(score * 100 / total + 0.5)).otherwise(0).cast("long")


def seeded_shuffle(items: Column, seed: Column) -> Column:
    """A permutation that depends on the seed alone."""
    ranked = F.transform(items, lambda x, i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda s: s["x"])


def pick(items: Column, n: int, seed: Column) -> Column:
    return F.slice(seeded_shuffle(items, seed), 1, n)


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def known_difficulty(c: Column) -> Column:
    return F.when(c.isin("easy", "medium", "hard"), c).otherwise("medium")


def js_number(c: Column) -> Column:
    """The number that a text stands for, 0 for a blank one, null for any other."""
    return F.when(trim(c) == "", 0.0).otherwise(trim(c).try_cast("double"))


def js_number_of(v: Column) -> Column:
    """The number of a JSON value: a text's as js_number, 1 and 0 for true and false; null for null, arrays and objects."""
    kind = F.schema_of_variant(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    return F.when(kind == "STRING", js_number(text)).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), number)
