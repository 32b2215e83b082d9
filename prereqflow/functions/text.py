"""Text rules of course outlines as column expressions (Java patterns; (?iU) for Unicode classes)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
HYPHEN_BREAK = r"(?U)(\w+)-\s*\n\s*(\w+)"
UNIT_HEADER = r"(?iU)^(?:unit|module|chapter|part|section)\s*[-:]?\s*([0-9ivxlcdm]+|\w+)\s*[-:]?\s*(.*)$"
COURSE_CODE = r"(?iU)\b([A-Z]{2,4}\s*[-:]?\s*\d{3,4})\b"
TITLE_CODE = r"(?iU)^[A-Z]{2,4}\s*[-:]?\s*\d{3,4}\s*[:|-]?\s*"
TITLE_LABEL = r"(?iU)^(course|syllabus|subject)\s*[:|-]\s*"
CANDIDATE_SPLIT = r"(?U)[;•\*]|\b-\b"
LEADING_MARK = r"(?iU)^\s*([0-9]+[\.\)]|\([0-9]+\)|[a-z][\.\)]|[-•\*\:\–])\s*"
HOURS = r"(?iU)\s*\(\s*\d+\s*(hours|hrs|marks|credits)?\s*\)"
IGNORED_PREFIXES = ("unit", "module", "chapter", "syllabus", "textbook", "reference", "prerequisites:", "outcomes:", "hours", "marks", "exam", "assignment", "course", "subject", "code:")
FOUNDATIONAL = ("basic", "basics", "foundation", "foundations", "introduction", "intro", "fundamental", "fundamentals", "python", "algebra", "calculus", "vector", "vectors", "probability", "statistics", "math", "linear")
DEFAULT_TITLE = "Course Syllabus"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, CONTROL, ""), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, HYPHEN_BREAK, "$1$2"), r"\n{3,}", "\n\n"))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def course_code(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, COURSE_CODE, 1))


def is_unit_header(c: Column) -> Column:
    return c.rlike(UNIT_HEADER)


def title_of_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, TITLE_CODE, ""), TITLE_LABEL, ""))


def clean_topic(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, LEADING_MARK, ""), HOURS, "")
    return strip(F.regexp_replace(c, r"^[ .,\-:]+|[ .,\-:]+$", ""))


def is_topic(c: Column) -> Column:
    ignored = "^(?:" + "|".join(map(re.escape, IGNORED_PREFIXES)) + ")"
    return F.length(c).between(3, 75) & ~F.lower(c).rlike(ignored) & ~c.rlike(COURSE_CODE)


def unit_number(unit: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(unit, r"(?U)\d+", 0), F.lit("")).try_cast("int"), F.lit(999))


def words(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(r"(?U)\w+"), F.lit(0))


def is_foundational(name: Column) -> Column:
    return F.arrays_overlap(words(name), F.array(*[F.lit(w) for w in FOUNDATIONAL]))


def lexical_direction(a: Column, b: Column) -> Column:
    return F.when(F.contains(F.lower(b), F.lower(a)), "A_to_B").when(F.contains(F.lower(a), F.lower(b)), "B_to_A")
