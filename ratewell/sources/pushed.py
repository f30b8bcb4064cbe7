"""Filters that a data source takes over, judged on a record's fields as Spark would judge them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import datasource as d

#: How a filter with a value judges a field that isn't null.
_TESTS: dict[type, Callable] = {
    d.EqualTo: lambda x, v: x == v,
    d.GreaterThan: lambda x, v: x > v,
    d.GreaterThanOrEqual: lambda x, v: x >= v,
    d.LessThan: lambda x, v: x < v,
    d.LessThanOrEqual: lambda x, v: x <= v,
    d.In: lambda x, v: x in v,
    d.StringStartsWith: lambda x, v: x.startswith(v),
    d.StringEndsWith: lambda x, v: x.endswith(v),
    d.StringContains: lambda x, v: v in x,
}


def supported(f: d.Filter, fields: frozenset[str]) -> bool:
    """Whether judged() knows the filter, and it is about one of the fields."""
    if isinstance(f, d.Not):
        return supported(f.child, fields)
    if type(f) is d.In and None in f.value:
        return False
    return (type(f) in _TESTS or isinstance(f, d.IsNull | d.IsNotNull | d.EqualNullSafe)) and len(f.attribute) == 1 and f.attribute[0] in fields


def judged(f: d.Filter, record: Mapping[str, object]) -> bool | None:
    """True, False, or None where a comparison with null leaves it open."""
    if isinstance(f, d.Not):
        inner = judged(f.child, record)
        return None if inner is None else not inner
    x = record.get(f.attribute[0])
    if isinstance(f, d.IsNull):
        return x is None
    if isinstance(f, d.IsNotNull):
        return x is not None
    if isinstance(f, d.EqualNullSafe):
        return x == f.value
    if x is None or f.value is None:
        return None
    return _TESTS[type(f)](x, f.value)


def passes(filters: list[d.Filter], record: Mapping[str, object]) -> bool:
    return all(judged(f, record) for f in filters)
