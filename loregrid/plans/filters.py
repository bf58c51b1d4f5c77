"""Typed filters of a query and the Column that applies them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregrid.functions import urls
from loregrid.functions.dates import parse_date, relative_range

#: The kinds of source, and those whose documents are files.
SOURCES = ["markdown", "pdf", "email", "browser", "clipboard", "html", "docx", "epub", "org", "code"]
FILE_SOURCES = ["markdown", "pdf", "email", "html", "docx", "epub", "org", "code"]


@dataclass(frozen=True)
class FilterSet:
    """Any of the sources, domains, kinds and collections; all of the tags, paths and phrases; none of the excluded.

    ``after`` is inclusive, ``before`` exclusive. ``ids`` None is no restriction, empty matches nothing.
    """

    sources: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    excluded_tags: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    after: datetime | str | None = None
    before: datetime | str | None = None
    relative_time: str = ""
    paths: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    ids: frozenset[str] | None = None

    def is_empty(self) -> bool:
        return all(getattr(self, f.name) in ((), None, "") for f in fields(self))

    def resolved(self, now: datetime) -> FilterSet:
        """Relative time as bounds; explicit bounds win."""
        if not self.relative_time or self.after or self.before:
            return replace(self, relative_time="")
        start, end = relative_range(self.relative_time, now)
        return replace(self, after=start, before=end, relative_time="")

    def merged(self, other: FilterSet) -> FilterSet:
        """Both sets: lists joined without repeats, single values of the other one first."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            if f.name == "ids":
                out[f.name] = a if b is None else b if a is None else a & b
            else:
                out[f.name] = tuple(dict.fromkeys((*a, *b))) if isinstance(a, tuple) else (b or a)
        return FilterSet(**out)

    def labels(self) -> list[str]:
        """What is filtered, in words, in a fixed order."""
        day = lambda t: t.strftime("%Y-%m-%d") if isinstance(t, datetime) else t
        rows = [("source", self.sources), ("tag", self.tags), ("-tag", self.excluded_tags), ("collection", self.collections), ("path", self.paths), ("domain", self.domains), ("kind", self.kinds)]
        out = [f"{name}:{v}" for name, values in rows for v in values]
        out += [f"after:{day(self.after)}"] * bool(self.after) + [f"before:{day(self.before)}"] * bool(self.before)
        return out + [self.relative_time] * bool(self.relative_time) + [f'"{p}"' for p in self.phrases] + [f"-{x}" for x in self.excluded]

    def column(self, source: str = "source", path: str = "path", title: str = "title", content: str = "content", tags: str = "tags", modified: str = "modified_at", metadata: str = "metadata", id_col: str = "id") -> Column:
        """The filter on a documents relation; collections are resolved to ids, or joined, beforehand."""
        if self.relative_time:
            raise ValueError("resolve relative time first")
        tests: list[Column] = []
        if self.sources:
            tests.append(F.col(source).isin(*self.sources))
        own = lambda: F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.lower)
        tests += [F.array_contains(own(), t.lower()) for t in self.tags] + [~F.array_contains(own(), t.lower()) for t in self.excluded_tags]
        tests += [F.lower(path).contains(p.lower()) for p in self.paths]
        if self.after:
            tests.append(F.col(modified) >= _moment(self.after))
        if self.before:
            tests.append(F.col(modified) < _moment(self.before))
        if self.domains:
            host = domain_of(F.col(metadata), F.col(path))
            tests.append(reduce(Column.__or__, (urls.in_domain(host, d) for d in self.domains)))
        if self.kinds:
            kinds = F.split(F.lower(F.coalesce(F.col(metadata)["kind"], F.lit(""))), "[, ]+")
            tests.append(F.arrays_overlap(kinds, F.array(*(F.lit(k.lower()) for k in self.kinds))))
        body = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit(""))))
        tests += [body.contains(p.lower()) for p in self.phrases] + [~body.contains(x.lower()) for x in self.excluded]
        if self.ids is not None:
            tests.append(F.col(id_col).isin(*sorted(self.ids)) if self.ids else F.lit(False))
        return reduce(Column.__and__, tests, F.lit(True))


def domain_of(metadata: Column, path: Column) -> Column:
    """The host that a document comes from: its metadata's domain, else the host of an URL there, else of its path."""
    named = F.lower(F.regexp_replace(metadata["domain"], r"^\*\.|^\.+|\.+$", ""))
    hosts = [urls.host(metadata[k]) for k in ("normalized_url", "url", "source_url")] + [urls.host(path)]
    return F.coalesce(*(F.when(h != "", h) for h in (named, *hosts)), F.lit(""))


def _moment(t: datetime | str) -> Column:
    t = parse_date(t.replace(" ", "T") + ("" if len(t) == 10 else "Z")) if isinstance(t, str) else t
    return F.lit(t.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
