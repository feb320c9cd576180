"""From free-text replies to answers. Codes: 1 yes or A, 0 no or B; 0 to 3 for A to D; -1 nothing found.

The functions take text that functions.pythonic.nfkc has normalised. Patterns are Java's with (?U), so that white
space, word edges and case are Unicode's, as where the patterns come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide which reply counts as which answer. Each has the answer in group 1.
YES_NO = [
    r"(?iU)(?:final(?: answer)?|answer|prediction)\s*[:：]\s*(yes|no)\b",
    r"(?iU)\b(yes|no)\b(?=[\s\.\,\!\?\)]|$)",
]
TWO_WAY = [
    r"(?iU)(?:final(?: answer)?|answer|prediction)\s*[:：]\s*([AB])\b",
    r"(?iU)(?:option|choice)\s*[:：]?\s*([AB])\b",
    r"(?iU)[\(\[\{]\s*([AB])\s*[\)\]\}]",
    r"(?iU)\b([AB])\s*[\.\)]\b",
]
TWO_WAY_ALONE = r"(?iU)(?<![A-Za-z0-9/])([AB])(?![A-Za-z0-9/])"
TWO_WAY_KEYWORD = r"(?iU)\b(final(?: answer)?|answer|prediction)\b"
FOUR_WAY = [
    r"(?iU)(?:final(?: answer)?|answer|prediction)\s*[:：]\s*\(?\s*([ABCD])\b",
    r"(?iU)(?:option|choice)\s*[:：]?\s*\(?\s*([ABCD])\b",
    r"(?iU)[\(\[\{]\s*([ABCD])\s*[\)\]\}]",
    r"(?U)(?<![A-Za-z0-9])([ABCD])\s*[\.\)]",
    r"(?U)(?<![A-Za-z0-9/])([ABCD])(?![A-Za-z0-9/])",
]
CHOICE = [
    r"(?iU)\b(?:the\s+)?best\s+answer\s+is\s*[:\.]?\s*[\(\[]?([A-D])[\)\]]?",
    r"(?iU)(?:final(?:\s+answer)?|answer|prediction|option|choice)\s*[:：]\s*[\(\[]?([A-D])[\)\]]?",
    r"(?U)^[\(\[]?([A-D])[\)\]]?\s*[\.\):]",
    r"(?U)^\s*([A-D])\s*$",
    r"(?U)[\(\[\{]\s*([A-D])\s*[\)\]\}]",
]
CHOICE_ALONE = r"(?U)(?<![A-Za-z0-9])(?!A\s[a-z])([A-D])(?![A-Za-z0-9])"
OPTION_LETTER = r"(?U)^[A-D][\.\)]\s*"


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def _letter(found: Column) -> Column:
    return F.coalesce(F.instr(F.lit("ABCD"), F.upper(found)) - 1, F.lit(-1)).cast("int")


def yes_no(text: Column) -> Column:
    found = F.lower(first_match(text, YES_NO))
    return F.when(found == "yes", 1).when(found == "no", 0).otherwise(-1)


def two_way(text: Column) -> Column:
    """A keyword without a letter beside it: the letter before it counts first, then one after it, then any."""
    at, word = F.regexp_instr(text, F.lit(TWO_WAY_KEYWORD)), F.regexp_extract(text, TWO_WAY_KEYWORD, 0)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(word), F.length(text))
    near = F.when(at > 0, F.coalesce(first_match(before, [TWO_WAY_ALONE]), first_match(after, [TWO_WAY_ALONE])))
    found = F.upper(F.coalesce(first_match(text, TWO_WAY), near, first_match(text, [TWO_WAY_ALONE])))
    return F.when(found == "A", 1).when(found == "B", 0).otherwise(-1)


def four_way(text: Column) -> Column:
    return _letter(first_match(text, FOUR_WAY))


def choice(text: Column, options: Column | None = None) -> Column:
    """Letter of a multiple-choice reply: explicit forms, else the last letter alone, else the one option it quotes."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(CHOICE_ALONE), F.lit(1)), F.lit(-1))
    found = _letter(F.coalesce(first_match(text, CHOICE), last))
    if options is None:
        return found
    body = lambda o: F.rtrim(F.lower(F.trim(F.regexp_replace(o, OPTION_LETTER, ""))), F.lit("."))
    quoted = F.filter(F.transform(options, lambda o, i: F.when((F.length(body(o)) >= 4) & F.contains(F.lower(text), body(o)), i)), lambda i: i.isNotNull())
    return F.when(found >= 0, found).when(F.size(quoted) == 1, F.try_element_at(quoted, F.lit(1))).otherwise(-1).cast("int")


def gold_letter(answer: Column) -> Column:
    return _letter(F.nullif(F.regexp_extract(F.upper(answer), "[A-D]", 0), F.lit("")))


def answer(text: Column, kind: Column, options: Column | None = None) -> Column:
    """Code of a normalised reply for its item's type; a blank reply is -1 before the type is looked at."""
    return (
        F.when(text.isNull() | (text == ""), -1)
        .when(kind == "yes_no", yes_no(text))
        .when(kind == "multiple_choice", two_way(text))
        .when(kind == "multiple_choice_4", four_way(text))
        .when(kind == "mcq4", choice(text, options))
        .otherwise(F.raise_error(F.concat(F.lit("unknown item type: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    )


def label(code: Column, kind: Column) -> Column:
    """Name of a code: yes and no, a and b, or a to d; empty for -1."""
    by_kind = {"yes_no": {1: "yes", 0: "no"}, "multiple_choice": {1: "a", 0: "b"}, "mcq4": {0: "a", 1: "b", 2: "c", 3: "d"}, "multiple_choice_4": {0: "a", 1: "b", 2: "c", 3: "d"}}
    out = F.lit("")
    for k, names in by_kind.items():
        for value, name in names.items():
            out = F.when((kind == k) & (code == value), name).otherwise(out)
    return out


def item_correct(code: Column, gold: Column) -> Column:
    """Strict: what can't be read is wrong, even if the gold can't be read either."""
    return (code >= 0) & (code == gold)
