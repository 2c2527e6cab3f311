"""Text, list and label expressions used by the prompt builders."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(template: str) -> list[tuple[str | None, str]]:
    """Template text as (slot name, "") and (None, literal) in order."""
    out: list[tuple[str | None, str]] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            out.append((None, literal))
        if slot is not None:
            out.append((slot, ""))
    return out


def fill(template: str, slots: dict[str, Column]) -> Column:
    """``{slot}`` text to one concat expression, parsed when the plan is built."""
    return F.concat(*[F.lit(literal) if slot is None else slots[slot] for slot, literal in parts(template)])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda would otherwise be computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slot_names(template: str) -> list[str]:
    return [slot for slot, _ in parts(template) if slot]


def joined(items: Column, first: str, second: str, use_first: Column) -> Column:
    """Join a list with one of two separators."""
    return F.when(use_first, F.array_join(items, first)).otherwise(F.array_join(items, second))


def arrow_pairs(left: Column, right: Column) -> Column:
    """``left -> right`` for two parallel lists."""
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" -> "), b))


def bullets(items: Column, marker: Column) -> Column:
    """One line per item, each with its marker and a line end."""
    return F.array_join(F.transform(items, lambda x: F.concat(marker, x, F.lit("\n"))), "")


def user_label(user_name: Column, user_key: Column) -> Column:
    """The name, or the key when the name is empty."""
    return F.when(user_name == "", user_key).otherwise(user_name)


def title_label(title: Column) -> Column:
    """The title, or a fixed text when it is empty or unknown."""
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("unknown title")).otherwise(title)


def like_label(rating: Column) -> Column:
    """NULL for no rating."""
    return F.when(rating >= 4, "like").when(rating < 4, "dislike")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def two_decimals(total: Column, count: Column) -> Column:
    """``total / count`` of integers as text with two decimals; NULL without values.

    Rounded as C-style formatting rounds the double average.  The integers decide, except at
    a tie x.xx5: there the double may lie above or below it, which shows in whole numbers
    once both are multiplied by 200 and a power of two that makes the double whole.  A double
    that is the tie itself goes to the even hundredth.
    """
    total, count = total.cast("bigint"), F.nullif(count.cast("bigint"), F.lit(0).cast("bigint"))
    size = F.abs(total)
    scaled = size * 200 + count
    half_up = F.floor(scaled / (count * 2)).cast("bigint")
    mean = F.when(scaled % (count * 2) == 0, size / count)  # NULL but for a tie
    power = F.lit(53) - F.floor(F.log2(mean))
    unit = F.pow(F.lit(2.0), power)
    above = (mean * unit).cast("bigint") * 200 - (half_up * 2 - 1) * unit.cast("bigint")
    down = (above < 0) | ((above == 0) & (half_up % 2 == 1))
    cents = F.when(down, half_up - 1).otherwise(half_up)
    return F.concat(
        F.when(total < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def one_decimal(value: Column) -> Column:
    """Rounded to one decimal and clamped to 1..5."""
    rounded = F.floor(value * 10 + F.lit(0.5)) / F.lit(10.0)
    # least and greatest skip NULL
    return F.when(value.isNotNull(), F.least(F.greatest(rounded, F.lit(1.0)), F.lit(5.0)))


def remove_at(items: Column, index: Column) -> Column:
    """The list without the element at a 0-based index."""
    return F.filter(items, lambda x, i: i != index)


def sub_sequence(items: Column, start: Column, length: Column) -> Column:
    """``length`` elements from a 0-based start."""
    return F.slice(items, (start + 1).cast("int"), length.cast("int"))


def element(items: Column, index: Column) -> Column:
    """Element at a 0-based index, NULL outside."""
    return F.get(items, index.cast("int"))
