"""A search service as a Spark data source over staged results.

    searched(spark, folder, domains=["a.example", "b.example"]).where("published_at >= '2022-06-01'")

Results are JSON lines files with query, url, title, snippet, published_at and raw_content; lines that are no JSON objects, and
results without a URL, are left out, and a blank raw_content is null. What is asked of the source:

* ``domains``: applied where rows are read, and again to what comes back, as with a service that may ignore it.
* Filters of the plan on these columns (comparisons, lists, beginnings, ends, parts, nulls, and their negations) are handed to the source, so that
  rows they reject never become Spark rows. What it can't take, Spark applies.
* ``limit``: at most so many results of each file, one query's answer, in their order, after the domains and before filters. Reading
  stops there.
* Files are cut into ranges of ``split_bytes``, each a partition of its own. A line belongs to the range it begins in, and is read a line at
  a time. With a limit a file is one partition, as it is short then.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

FIELDS = ("query", "url", "title", "snippet", "published_at", "raw_content")
SPLIT_BYTES = 32 << 20
#: How filters on a column of strings are tested; a null passes none of them.
TESTS: dict[type, Callable[[str, object], bool]] = {
    ds.EqualTo: lambda x, v: x == v,
    ds.GreaterThan: lambda x, v: x.encode() > v.encode(),
    ds.GreaterThanOrEqual: lambda x, v: x.encode() >= v.encode(),
    ds.LessThan: lambda x, v: x.encode() < v.encode(),
    ds.LessThanOrEqual: lambda x, v: x.encode() <= v.encode(),
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
}


@dataclass
class Part(ds.InputPartition):
    path: str
    begin: int
    end: int


def taken(f: ds.Filter) -> tuple[int, type, object, bool] | None:
    """(column, kind, value, negated) of a filter that the source can apply by itself."""
    negated = isinstance(f, ds.Not)
    inner = f.child if negated else f
    if len(getattr(inner, "attribute", ())) != 1 or inner.attribute[0] not in FIELDS:
        return None
    value = getattr(inner, "value", None)
    if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
        value = None
    elif isinstance(inner, ds.In):
        if not all(isinstance(v, str) for v in value):
            return None  # a null in the list makes the answer unknown
    elif type(inner) not in TESTS or not isinstance(value, str):
        return None
    return FIELDS.index(inner.attribute[0]), type(inner), value, negated


def passes(row: tuple, tests: list[tuple[int, type, object, bool]]) -> bool:
    for at, kind, value, negated in tests:
        x = row[at]
        if kind in (ds.IsNull, ds.IsNotNull):
            found = (x is None) == (kind is ds.IsNull)
        elif x is None:
            return False  # unknown, also when negated
        else:
            found = TESTS[kind](x, value)
        if found == negated:
            return False
    return True


class StagedSearch(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_search"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> StagedReader:
        options = dict(self.options)
        return FilteringReader(options) if options.get("push_filters") == "true" else StagedReader(options)


class StagedReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.domains = [d.lower() for d in options.get("domains", "").split(",") if d]
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[int, type, object, bool]] = []

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = self._system()
        parts = []
        for f in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith((".json", ".jsonl")):
                step = max(f.size, 1) if self.limit is not None else self.split
                parts += [Part(f.path, at, min(at + step, f.size)) for at in range(0, f.size, step)]
        return parts or [Part("", 0, 0)]

    def _row(self, line: bytes) -> tuple | None:
        try:
            found = json.loads(line)
        except ValueError:
            return None
        if not isinstance(found, dict) or not found.get("url"):
            return None
        host = (urlsplit(str(found["url"])).hostname or "").lower()
        if self.domains and not any(host == d or host.endswith("." + d) for d in self.domains):
            return None
        row = tuple(None if (x := found.get(f)) is None else str(x) for f in FIELDS)
        return row if (row[-1] or "").strip() else (*row[:-1], None)

    def read(self, partition: Part) -> Iterator[tuple]:
        import io

        if not partition.path:
            return
        left = self.limit
        with self._system()[0].open_input_file(partition.path) as opened, io.BufferedReader(opened, 1 << 20) as stream:
            at = partition.begin
            if at:
                stream.seek(at - 1)
                at += len(stream.readline()) - 1  # the line that began before is the range's before
            while at < partition.end and left != 0:
                line = stream.readline()
                at += len(line)
                row = self._row(line)
                if row is not None:
                    left = None if left is None else left - 1
                    if passes(row, self.tests):
                        yield row


class FilteringReader(StagedReader):
    """A reader that takes filters; Spark asks one only where its setting allows it, and fails otherwise."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            test = taken(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


def searched(spark: SparkSession, folder: str, domains: list[str] = (), limit: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The staged results of a folder (query, url, title, snippet, published_at, raw_content)."""
    spark.dataSource.register(StagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("staged_search").option("path", folder).option("domains", ",".join(domains)).option("split_bytes", split_bytes).option("push_filters", "true")
    return (reader.option("limit", limit) if limit is not None else reader).load()
