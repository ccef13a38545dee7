"""The text functions as DuckDB expressions."""

from __future__ import annotations

from lessonlake.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"


def rm(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(pattern)})"


BAD_LINE = r"^(?:\d+\z|[A-D]\.\z|[a-d]\)\z|[•●▪]|\.\z)"


def trim(e: str) -> str:
    return rr(e, r"^\s+|\s+\z")


def collapse(e: str) -> str:
    return trim(rr(e, r"\s+", " "))


def nn(e: str) -> str:
    return f"coalesce({e}, '')"


def let(value: str, f) -> str:
    """f of a value that is computed once."""
    return f"list_transform([{value}], lambda v0: {f('v0')})[1]"


def normalize_text(e: str) -> str:
    return collapse(rr(rr(nn(e), r"\*\*"), f"[{T.BULLETS}]", " "))


def alphabet_ratio(e: str) -> str:
    return f"CASE WHEN length({rr(e, r'\s+')}) = 0 THEN 0.0 ELSE length({rr(e, '[^A-Za-z]')}) / length({rr(e, r'\s+')}) END"


def is_label_only(e: str) -> str:
    return rm(trim(e), T.LABEL)


def is_header_or_footer(e: str) -> str:
    return rm(f"lower({trim(e)})", rf"^(?:{'|'.join(T.HEADER_FOOTER)})\z")


def is_ai_ready(e: str) -> str:
    return f"(length({e}) >= 14 AND NOT {is_label_only(e)} AND {alphabet_ratio(e)} >= 0.55 AND NOT {rm(f'lower({e})', '^(?:' + '|'.join(T.INSTRUCTIONS) + ')')})"


def clean_ai_text(e: str) -> str:
    return normalize_text(rr(rr(rr(normalize_text(e), r"^\s*\d+[.)]\s+"), r"^\s*[A-Da-d][.)]\s+"), r"(?i)^\s*[ivxlcdm]+[.)]\s+"))


def should_keep(e: str, n: str, conf: str, w: str, h: str, pw: int, ph: int) -> str:
    return (
        f"({e} <> '' AND NOT {is_label_only(e)} AND NOT {is_header_or_footer(e)} AND {rm(e, '[A-Za-z]')} AND {alphabet_ratio(e)} >= 0.42 AND {conf} >= 52 AND NOT ({n} = 1 AND length({e}) < 8) "
        f"AND length({e}) >= 4 AND {w} >= greatest(24.0, {pw} * 0.018) AND {h} >= 6 AND {h} <= {ph} * 0.07)"
    )


def clean_ocr_text(e: str) -> str:
    return collapse(rr(rr(rr(rr(nn(e), r"\*\*"), rf"^[{T.BULLETS}]\s*"), r"^\s*\d+[.)]\s*\z"), r"^\s*[A-Da-d][.)]\s*\z"))


def is_import_ai_ready(e: str) -> str:
    return f"(length({e}) >= 4 AND {rm(e, '[A-Za-z]')} AND NOT {rm(e, r'^[A-Da-d\d\s.()]+\z')})"


def remove_markdown(e: str) -> str:
    return trim(rr(rr(rr(rr(nn(e), r"(?i)```(?:json)?"), r"\*\*|__"), r"(?m)^#{1,6}\s*"), "<[^>]+>", " "))


def clean_line(e: str) -> str:
    x = rr(remove_markdown(e), rf"^\s*(?:[{T.BULLETS}*–—-]+|\(?\d+\)?[.)]|[A-Da-d][.)])\s*")
    return trim(rr(rr(x, r"\s+", " "), r"\s+([,.!?;:])", r"\1"))


def is_junk(e: str, least: int = 2) -> str:
    junk = ", ".join(map(q, T.JUNK_QUIZ if least < 3 else T.JUNK_GAME))
    x = clean_line(e)
    return f"(length({x}) < {least} OR lower({x}) IN ({junk}) OR NOT {rm(x, '[A-Za-z]')} OR {rm(x, r'^(?:[A-Da-d][.)]?|\d+[.)]?|[^\p{L}\p{N}]+)\z')})"


def clean_context(e: str, least: int = 2, most: int = 7000) -> str:
    lines = f"list_transform(string_split({rr(remove_markdown(e), r'\r\n', chr(10))}, chr(10)), lambda x: {clean_line('x')})"
    return f"substr(array_to_string(list_filter({lines}, lambda y: NOT {is_junk('y', least)} AND length(y) >= 8), chr(10)), 1, {most})"


def split_sentences(e: str, least: int = 20, junk: int = 2) -> str:
    cut = rr(rr(e, r"\n+", " "), r"([.!?])\s+", "\\1\x01")
    lines = f"list_transform(string_split({cut}, chr(1)), lambda x: {clean_line('x')})"
    return f"list_filter({lines}, lambda y: length(y) >= {least} AND {rm('y', '[A-Za-z]{3,}')} AND NOT {is_junk('y', junk)})"


def split_words(e: str) -> str:
    cut = collapse(rr(nn(e), '[.,!?;:"]'))
    return f"list_filter(string_split({cut}, ' '), lambda x: x <> '')"


def percent(score: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST(floor({score} * 100 / {total} + 0.5) AS BIGINT) ELSE 0 END"
