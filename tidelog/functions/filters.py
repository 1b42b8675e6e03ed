"""The filter grammar ``pattern[@domain]`` as Columns.

``*`` takes every type, ``prefix.*`` types with exactly one more segment, anything else the type
of that name. Nothing after ``@`` means any domain; an empty pattern takes nothing. Underscores
and case are literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """A parsed filter: kind is all, exact, pre or none; pre keeps the parent segment path."""

    kind: str
    key: str
    domain: str | None


def parse(text: str) -> Filter:
    pattern, _, domain = text.partition("@")
    if pattern == "*":
        kind, key = "all", "*"
    elif pattern.endswith(".*"):
        kind, key = "pre", pattern[:-2]
    else:
        kind, key = ("exact", pattern) if pattern else ("none", "")
    return Filter(kind, key, domain or None)


def matches(text: str, event_type: Column | str = "event_type", domain: Column | str = "domain") -> Column:
    """The predicate of one filter; equality and prefix tests reach the scan."""
    t = F.col(event_type) if isinstance(event_type, str) else event_type
    d = F.col(domain) if isinstance(domain, str) else domain
    f = parse(text)
    if f.kind == "all":
        test = F.lit(True)
    elif f.kind == "exact":
        test = t == f.key
    elif f.kind == "pre":
        at = len(f.key) + 2
        test = t.startswith(f.key + ".") & (F.length(t) >= at) & ~F.contains(F.substring(t, at, 1 << 20), F.lit("."))
    else:
        test = F.lit(False)
    return test if f.domain is None else test & (d == f.domain)


def parsed(column: Column) -> Column:
    """A filter column as a struct of kind, key and domain (null for any)."""
    at = F.instr(column, "@")
    pattern = F.when(at > 0, F.substring(column, F.lit(1), at - 1)).otherwise(column)
    domain = F.when(at > 0, F.nullif(F.substring(column, at + 1, F.length(column)), F.lit("")))
    kind = F.when(pattern == "*", "all").when(pattern.endswith(".*"), "pre").when(pattern == "", "none").otherwise("exact")
    key = F.when(pattern.endswith(".*"), F.substring(pattern, F.lit(1), F.length(pattern) - 2)).otherwise(pattern)
    return F.struct(kind.alias("kind"), key.alias("key"), domain.alias("domain"))


def event_keys(event_type: Column) -> Column:
    """The three (kind, key) pairs under which a filter can want an event."""
    parent = F.when(F.contains(event_type, F.lit(".")) & ~event_type.endswith("."), F.regexp_replace(event_type, r"\.[^.]*$", ""))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    return F.array(pair("all", F.lit("*")), pair("exact", event_type), pair("pre", parent))


def split_provided(column: Column) -> Column:
    """A provider's comma-separated filters, trimmed."""
    return F.transform(F.split(column, ","), lambda x: F.trim(x))
