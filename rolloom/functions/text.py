"""String expressions. All stay inside the JVM; none is a Python UDF."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.constants import WHITESPACE


def strip_ws(text: Column) -> Column:
    """Strip the full Unicode whitespace set from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def regex_quote(literal: str) -> str:
    """A Java pattern that matches ``literal`` as is."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def char_class(chars) -> str:
    """Java character class for a set of characters, as code point ranges."""
    points = sorted(ord(c) for c in chars)
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


SPACE_CLASS = char_class(WHITESPACE)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Everything ``str.isdigit`` accepts: decimal digits of all scripts, superscripts, circled.

    Built from the rule itself, so it does not depend on the Unicode version of the JVM.
    """
    return char_class(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit())


def holds(text: Column, literal: str) -> Column:
    """Whether a fixed text occurs: a quoted pattern is searched with skips (Boyer-Moore), where
    ``contains`` compares at every byte."""
    return F.rlike(text, F.lit(regex_quote(literal)))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences, counted from the left."""
    return F.regexp_count(text, F.lit(regex_quote(literal)))


def last_piece(text: Column, separator: str) -> Column:
    """What follows the last separator when the text is split from the left.

    ``substring_index(-1)`` searches from the right; a separator that overlaps itself, such as a
    tag between two newlines, makes the two differ.
    """
    return F.element_at(F.split(text, regex_quote(separator), -1), -1)


def xml_answer(text: Column, guarded: bool = True) -> Column:
    """The stripped body of the last ``<answer>``, up to the first ``</answer>`` after it.

    Without the opening tag the guarded form returns the whole stripped text; the plain form
    still cuts at ``</answer>``.
    """
    body = F.substring_index(F.substring_index(text, "<answer>", -1), "</answer>", 1)
    if guarded:
        body = F.when(F.contains(text, F.lit("<answer>")), body).otherwise(text)
    return strip_ws(body)


def hash_answer(text: Column) -> Column:
    """The field between the first and the second ``####``; NULL without the mark."""
    return strip_ws(F.get(F.split(text, "####", -1), F.lit(1)))


def count_xml(text: Column) -> Column:
    """Score of the four tag marks: 0.125 for each that occurs once, 0.001 off per trailing char.

    The additions keep their left-to-right order, so the double equals the sequential sum.
    """

    def if_once(tag: str, value: Column) -> Column:
        return F.when(occurrences(text, tag) == 1, value).otherwise(F.lit(0.0))

    mark = F.lit(0.125)
    long_tail = F.length(last_piece(text, "\n</answer>\n"))
    short_tail = F.length(last_piece(text, "\n</answer>")) - 1
    score = if_once("<reasoning>\n", mark) + if_once("\n</reasoning>\n", mark)
    score = score + if_once("\n<answer>\n", mark)
    score = score - if_once("\n<answer>\n", long_tail * F.lit(0.001))
    score = score + if_once("\n</answer>", mark)
    return score - if_once("\n</answer>", short_tail * F.lit(0.001))


def xml_cot(reasoning: Column, answer: Column) -> Column:
    """The tagged layout a completion is asked to follow."""
    return F.concat(
        F.lit("<reasoning>\n"),
        reasoning,
        F.lit("\n</reasoning>\n<answer>\n"),
        answer,
        F.lit("\n</answer>\n"),
    )


def quoted_list(items: Column) -> Column:
    """How Python prints a list of strings: ``['a', "it's"]``.

    Backslashes, quotes and the line and tab characters are escaped; other control characters stay.
    """

    def printed(item: Column) -> Column:
        for char, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            item = F.replace(item, F.lit(char), F.lit(mark))
        single, double = F.contains(item, F.lit("'")), F.contains(item, F.lit('"'))
        escaped = F.replace(item, F.lit("'"), F.lit("\\'"))
        return F.when(
            single & ~double, F.concat(F.lit('"'), item, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, printed), ", "), F.lit("]"))


def strip_fences(text: Column) -> Column:
    """Remove code fences wherever they stand, then strip."""
    without_json = F.replace(text, F.lit("```json"), F.lit(""))
    return strip_ws(F.replace(without_json, F.lit("```"), F.lit("")))


def preview(text: Column, chars: int) -> Column:
    """The first characters of a text, for a printed sample."""
    return F.substring(text, 1, chars)
