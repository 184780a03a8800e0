"""Column expressions over text: white space, names, hashes. Sizes are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space and as a line's end in the data model.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Namespace of ids made from URLs, without its dashes.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(or_empty(x), SPACE + "+", " "))


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends; null stays null."""
    return F.regexp_replace(x, rf"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def nullif_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def tokens(x: Column, normal: bool = False) -> Column:
    """Lower-cased words; normal says that white space is normalized already."""
    return F.filter(F.split(F.lower(or_empty(x) if normal else normalize_whitespace(x)), " "), lambda t: t != "")


def point_id(text: Column) -> Column:
    """The version 5 UUID of a text in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _snake(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(or_empty(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def upper_snake(x: Column) -> Column:
    return F.upper(_snake(x))


def attribute_name(x: Column) -> Column:
    return _snake(F.lower(or_empty(x)))


def template_id(x: Column) -> Column:
    """Lower snake case, `template` if nothing is left, with the suffix `_v1`."""
    base = F.coalesce(nullif_empty(F.lower(_snake(x))), F.lit("template"))
    return F.when(base.endswith("_v1"), base).otherwise(F.concat(base, F.lit("_v1")))


def loose_boolean(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin("true", "yes", "required"), F.lit(False))


def five_lines(x: Column, template_name: Column) -> Column:
    """The text's non-empty lines, five of them: filled up, cut, or all defaults."""
    lines = F.filter(F.transform(F.split(or_empty(x), LINE_END), strip), lambda v: v != "")
    # The lines of an empty description, and the one that fills a short one up.
    defaults = F.array(
        F.concat(F.lit("Reusable template for "), template_name, F.lit(".")),
        F.lit("Captures identity, classification, and core descriptive fields."),
        F.lit("Includes inventory, storage, and lifecycle information."),
        F.lit("Supports optional nutrition and flexible tagging metadata."),
        F.lit("Designed for AI-assisted suggestion and structured data entry."),
    )
    filled = F.concat(lines, F.array_repeat(F.lit("Additional template guidance."), 5))
    return F.array_join(F.slice(F.when(F.size(lines) == 0, defaults).otherwise(filled), 1, 5), "\n")
