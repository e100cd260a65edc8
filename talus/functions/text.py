"""Text and number functions that keep the meaning of the logs' own runtime. Lengths are code points throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space, beyond Java's ASCII class.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
CJK = r"[\u3400-\u9FFF]"


def trim_all(text: Column, space: str = SPACE) -> Column:
    """White space of any kind, or of the class ``space``, off both ends."""
    return F.regexp_replace(text, rf"^{space}+|{space}+\z", "")


def blank(text: Column) -> Column:
    return F.coalesce(trim_all(text), F.lit("")) == ""


def non_blank(text: Column) -> Column:
    """The text as it is, or null if it has nothing but white space."""
    return F.when(~blank(text), text)


def dense_length(text: Column, space: str = SPACE) -> Column:
    """Characters that are no white space, or not of the class ``space``."""
    return F.length(F.regexp_replace(text, space, ""))


def first_non_blank(*texts: Column) -> Column:
    return F.coalesce(*(non_blank(t) for t in texts))


def round_up_ties(x: Column, places: int) -> Column:
    """Rounded to ``places``, halves going up for either sign."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def contains_ci(text: Column, pattern: str) -> Column:
    """LIKE '%pattern%' without regard to case; % and _ in the pattern stay wildcards."""
    return text.ilike(f"%{pattern}%")


def last_segment(path: Column) -> Column:
    """Last non-empty segment of a path with slashes of either kind; null if there is none."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


def file_uri_path(uri: Column) -> Column:
    """Folder of a file:/// URI: percent escapes decoded, plus signs kept."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:///", ""), F.lit("+"), F.lit("%2B")))


def normalised_tags(tags: Column) -> Column:
    """Trimmed, lower-case, distinct, none empty; order of first appearance."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(trim_all(t))), lambda t: t != ""))


def united(a: Column, b: Column) -> Column:
    """Both arrays without repeats, in order of first appearance; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def united_values(a: Column, b: Column) -> Column:
    """``united`` for arrays of any type, such as structs, which are equal by value; null only where both are."""
    return F.coalesce(F.array_distinct(F.concat(a, b)), F.array_distinct(a), F.array_distinct(b))


def matches(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found; with (?i), letters of all scripts are equal in either case.

    Java's (?i) folds ASCII alone, its (?iu) takes the Turkish i's for i as well: those two give way to characters that never occur.
    A $ that ends ``pattern`` stands for the very end, where Java's also stands before a last line end.
    """
    pattern = re.sub(r"(?<!\\)\$\Z", r"\\z", pattern)
    for letter, stand_in in (("\u0130", "\ufdd0"), ("\u0131", "\ufdd1")):
        text, pattern = F.replace(text, F.lit(letter), F.lit(stand_in)), pattern.replace(letter, stand_in)
    return text.rlike(pattern.replace("(?i)", "(?iu)"))


def contains_literal(text: Column, part: str) -> Column:
    """Whether a text has ``part`` somewhere, whatever its case; nothing in it is a wildcard."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))
