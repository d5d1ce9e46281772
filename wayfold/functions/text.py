"""Text clean-up expressions: name folding, blankness, identifiers.

Everything here is a native expression, so it stays inside whole-stage code generation and
never ships a row to Python.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character Unicode (and str.isspace) counts as white space.
_SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())

# Arithmetic of the precomposed Hangul block (Unicode standard, section 3.12).
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_LEAD = "".join(map(chr, range(0x1100, 0x1113)))
_VOWEL = "".join(map(chr, range(0x1161, 0x1176)))
_TAIL = "".join(map(chr, range(0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, dict[str, str]]:
    """Character rules derived from the Unicode tables of the running interpreter.

    Returns ``(source, target, expansions)`` for ``translate``: characters of ``source`` beyond
    the length of ``target`` are deleted. ``expansions`` holds the few characters which fold to
    more than one character.
    """
    source, target, marks, expansions = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if _HANGUL_FIRST <= code <= _HANGUL_LAST or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        folded = "".join(
            c
            for c in unicodedata.normalize("NFD", char.lower())
            if unicodedata.category(c) != "Mn"
        )
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions[char] = folded
    return "".join(source + marks), "".join(target), expansions


def strip(col: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(_as_col(col), F.lit(_SPACES))


def normalize_name(expression: str) -> Column:
    """Fold a name for matching: lower case, no accents, no outer white space.

    ``expression`` is a column name or other SQL expression. NULL becomes the empty string and
    inner white space is kept. Pure ASCII text, the usual case, skips the accent tables; of other text each
    different character is looked up once, since what characters fold to folds no further.
    """
    text = f"lower(coalesce({expression}, ''))"
    return F.expr(f"""
        btrim(
          CASE
            WHEN octet_length({text}) = char_length({text}) THEN {text}
            ELSE aggregate(array_distinct(regexp_extract_all({text}, '[^\\\\x00-\\\\x7f]', 0)), {text},
                           (folded, c) -> replace(folded, c, {_folded_character("c")}))
          END, '{_sql_text(_SPACES)}')""")


def _folded_character(c: str) -> str:
    """What one character folds to, as SQL."""
    source, target, expansions = _fold_rules()
    table = ",".join(f"{char}:{parts}" for char, parts in expansions.items())
    index = f"(ascii({c}) - {_HANGUL_FIRST})"
    return f"""translate(
        CASE
          WHEN {c} BETWEEN '{chr(_HANGUL_FIRST)}' AND '{chr(_HANGUL_LAST)}' THEN concat(
            substr('{_LEAD}', {index} DIV 588 + 1, 1),
            substr('{_VOWEL}', {index} % 588 DIV 28 + 1, 1),
            CASE WHEN {index} % 28 > 0 THEN substr('{_TAIL}', {index} % 28, 1) ELSE '' END)
          ELSE coalesce(try_element_at(str_to_map('{table}', ',', ':'), {c}), {c})
        END, '{source}', '{target}')"""


def _sql_text(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


def is_empty(col: Column | str, floating: bool = False) -> Column:
    """True for NULL, for blank text and, with ``floating``, for NaN."""
    value = _as_col(col)
    if floating:
        return value.isNull() | F.isnan(value)
    return value.isNull() | (strip(value) == "")


def snake(col: Column | str) -> Column:
    """Trimmed, lower-cased, blanks as underscores; NULL becomes the empty string."""
    cleaned = F.lower(strip(F.coalesce(_as_col(col), F.lit(""))))
    return F.replace(cleaned, F.lit(" "), F.lit("_"))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename columns to trimmed lower case with underscores; colliding names are an error."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after normalisation: {clashes}")
    return df.toDF(*names)


def _as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
