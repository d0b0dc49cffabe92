"""Text expressions: tidying, labels, headings and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of labels and headings.
LABEL = r"^(\d{1,2})\s*(?:\(.*)?\.?$"
#: The same with what may stand before a number, for numbers from 1 to 40.
LABEL_NUMBER = r"^(?:(?:[Qq]|[.,])\s*(?=[0-9]))?(0?[1-9]|[1-3][0-9]|40)\s*(?:\(.*)?\.?$"
LABEL_START = r"^\d{1,2}\s*(?:[.(]|$)"
NAMES_A_PART = r"^\d{1,2}\s*\("
WORDED_HEADING = r"^Question\s+(\d{1,2})\b"
PART = r"^(?:(\d{1,2})\s*)?\(([a-z])\)"
MARK_ALLOCATION = r"\[\s*(?:Total:?\s*)?\d{1,2}\s*\]"
HIGHEST_LABEL = 40


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def squash(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def tag_list(text: Column) -> Column:
    """Array of comma-separated tags, squashed; empties go, and of spellings that differ in case the first stays."""
    tags = F.filter(F.transform(F.split(text, ","), squash), lambda t: t != "")
    # The first place of each spelling is found in an array of lower-case tags.
    low = F.transform(tags, F.lower)
    return F.filter(tags, lambda t, k: F.array_position(low, F.lower(t)) == k + 1)


def tidy_tags(text: Column) -> Column:
    """``tag_list`` joined by comma and space."""
    return F.array_join(tag_list(text), ", ")


def heading_key(text: Column) -> Column:
    """Letters and digits of a column heading, for look-up."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def picture_stem(name: Column) -> Column:
    """A picture's name without its side and extension."""
    return F.regexp_replace(F.trim(name), r"(?i)_(Q|MS)\.png$", "")


def stitched(left: Column, right: Column) -> Column:
    """Two pieces of a broken word joined over their longest overlap; null if they have none."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1)))
    fits = F.filter(sizes, lambda n: F.right(left, n) == F.left(right, n))
    return F.concat(left, F.substr(right, F.get(fits, F.lit(0)) + 1))


def matched_number(text: Column, pattern: str) -> Column:
    """The whole number that a pattern's first group holds; null if the text does not match."""
    # An empty text that is tried as a number costs an exception a row, a null costs nothing.
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def label_number(text: Column) -> Column:
    """The question a label belongs to (1 to 40); null if the text is no label."""
    return matched_number(stripped(text), LABEL_NUMBER)


def opens_as_label(text: Column) -> Column:
    """Whether a text starts like a label."""
    return F.trim(text).rlike(LABEL_START)


def names_a_part(text: Column) -> Column:
    """Whether a label goes on with a part."""
    return F.trim(text).rlike(NAMES_A_PART)


def heading_number(text: Column) -> Column:
    """The number of a heading in words; null if there is none."""
    return F.when(text.rlike(WORDED_HEADING), F.regexp_extract(text, WORDED_HEADING, 1).try_cast("int"))


def part_label(text: Column) -> Column:
    """struct(number, part) of a part label; null if the text is none."""
    body = F.trim(text)
    fields = F.struct(F.regexp_extract(body, PART, 1).try_cast("int").alias("number"), F.regexp_extract(body, PART, 2).alias("part"))
    return F.when(body.rlike(PART), fields)


def mark_allocations(text: Column) -> Column:
    """Array of the mark allocations in a text."""
    return F.regexp_extract_all(text, F.lit(f"({MARK_ALLOCATION})"), F.lit(1))


def control_counts(text: Column) -> Column:
    """struct(visible, odd, readable): characters that are no white space, control or format codes, letters or digits."""
    visible = F.regexp_replace(text, r"\s", "")
    length = F.length(visible)
    odd = length - F.length(F.regexp_replace(visible, r"[\p{Cc}\p{Cf}\p{Cn}]", ""))
    readable = length - F.length(F.regexp_replace(visible, r"[\p{L}\p{N}]", ""))
    return F.struct(length.alias("visible"), odd.alias("odd"), readable.alias("readable"))


def is_code_strip(text: Column) -> Column:
    """Whether a text is a strip of control codes, as a barcode font leaves it."""
    n = control_counts(text)
    return text.rlike(r"[\p{Cc}\p{Cf}\p{Cn}]") & (n["visible"] >= 6) & (n["odd"] > 0.3 * n["visible"]) & (n["odd"] >= 8) & (n["odd"] > n["readable"])
