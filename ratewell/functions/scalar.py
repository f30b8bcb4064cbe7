"""Column functions over text, numbers and nested messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_none(c: Column) -> Column:
    """A null prints as ``None`` in templates."""
    return F.coalesce(c, F.lit("None"))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """``template`` with each {NAME} replaced by its column. The template is cut first, so braces in values stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = sorted((rest.index(f"{{{name}}}"), name) for name in values if f"{{{name}}}" in rest)
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = found[0]
        parts += [F.lit(rest[:at])] * bool(at) + [or_none(values[name])]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def lookup(c: Column, table: Mapping[str, str | int | float]) -> Column:
    """The table's value for ``c``, null where it has none."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def date_token(c: Column) -> Column:
    """A date as YYYYMMDD."""
    return F.date_format(c, "yyyyMMdd")


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def enum_name(c: Column, names: tuple[str, ...]) -> Column:
    """``c`` in lower case if it is one of ``names``; an error otherwise. Null stays null."""
    low = F.lower(c)
    return F.when(c.isNull() | low.isin(*names), low).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), c)))


def rater_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def rater_kind(c: Column) -> Column:
    """primary or secondary; an error if the name says neither."""
    return F.when(F.contains(c, F.lit("primary")), "primary").when(F.contains(c, F.lit("secondary")), "secondary").otherwise(F.raise_error(F.concat(F.lit("neither primary nor secondary: "), c)))


def strip_vertical(c: Column, names: tuple[str, ...] = ("Sleep ", "Fitness ")) -> Column:
    """A rater's label without the vertical in front."""
    for name in names:
        c = F.replace(c, F.lit(name), F.lit(""))
    return c


def place_in(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a display order, from 1; 0 if it isn't shown."""
    return F.array_position(F.array(*map(F.lit, order)), c).cast("int")


def composite_key(*columns: str) -> Column:
    return F.concat_ws("::", *(or_none(F.col(c).cast("string")) for c in columns))


def percent_text(c: Column) -> Column:
    return F.format_string("%.2f%%", 100 * c)


def zero_padded(c: Column, width: int = 4) -> Column:
    """A whole number with zeros in front, as wide as it is if that is more."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def utf8(c: Column) -> Column:
    """Bytes as text."""
    return F.decode(c, "UTF-8")


def interval_label(mean: Column, low: Column, high: Column, n: Column, undefined: str = "nan") -> Column:
    """mean, interval and count, without leading zeros; a number that is nan prints as ``undefined``."""
    label = F.replace(F.format_string("%.3f\n[%.2f–%.2f]\nn=%d", mean, low, high, n), F.lit("0."), F.lit("."))
    return F.replace(label, F.lit("NaN"), F.lit(undefined))


def message_index(messages: Column, tag: Column, role: Column) -> Column:
    """Place of the first message with this tag and role, from 0; -1 if there is none."""
    keys = F.transform(messages, lambda m: F.struct(m["tag"].alias("tag"), m["role"].alias("role")))
    return F.coalesce(F.array_position(keys, F.struct(tag.alias("tag"), role.alias("role"))).cast("int") - 1, F.lit(-1))


def message_text(messages: Column, tag: Column, role: Column) -> Column:
    """Text of the first chunk of that message, null if there is none."""
    return F.get(F.get(F.filter(messages, lambda m: (m["tag"] == tag) & (m["role"] == role)), F.lit(0))["chunks"], F.lit(0))["text"]


def repeats_tag_role(messages: Column) -> Column:
    """Whether a (tag, role) occurs twice in a conversation."""
    keys = F.transform(messages, lambda m: F.struct(m["tag"], m["role"]))
    return F.size(F.array_distinct(keys)) < F.size(keys)


def first_line(c: Column) -> Column:
    return F.get(F.split(c, "\n"), F.lit(0))


def answer_in(text: Column, letters: str = "ABCDE") -> Column:
    """The first <answer>(X)</answer> in upper case, null if there is none."""
    found = F.regexp_extract(F.trim(text), rf"(?i)<answer>(\([{letters}]\))</answer>", 1)
    return F.nullif(F.upper(found), F.lit(""))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by the series of positive terms; 0 from about 5.66 on, where z passes 8."""
    terms = F.sequence(F.lit(1), F.lit(150))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(terms, start, add)["sum"]
    return F.greatest(F.lit(0.0), 1 - 1.1283791670955126 * F.exp(-x * x) * total)


def two_sided_p(z: Column) -> Column:
    """p of a standard normal beyond |z|; 0 beyond 8, where the series ends."""
    return F.when(F.abs(z) > 8, F.lit(0.0)).otherwise(erfc(F.abs(z) / F.sqrt(F.lit(2.0))))
