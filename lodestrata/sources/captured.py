"""Captured pages and run documents as Spark data sources, in batch and as streams.

    catalog.register(spark)
    spark.read.format("captured_pages").option("path", folder).load().where("source = 'green'")
    spark.read.format("run_documents").option("path", folder).load()

A capture folder holds <source>/<keyword>/<page>.html (or .json) below it; a run document is one JSON object over
any number of lines with its listings under `jobs`.  Both are read through the file system that Python sees on the executors, as a data
source in Python has to; tables in other stores are read by spark.read and parsed by the same functions
(catalog.parse_pages, run_documents).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import catalog

#: Files of one task.
FILES = 64

PAGES = catalog.RAW + ", page_file string"


class Files(InputPartition):
    """Some files of one source."""

    def __init__(self, source: str, names: list[str]):
        self.source, self.names = source, names


def _keyword_and_page(name: str) -> tuple[str, int]:
    folder, last = os.path.split(name)
    number = "".join(c for c in last if c.isdigit())
    return os.path.basename(folder), int(number or 0)


def captured_files(root: str, sources: list[str]) -> dict[str, list[str]]:
    """Files of each source, in order."""
    out = {}
    for source in sources:
        found = [os.path.join(at, x) for at, _, names in os.walk(os.path.join(root, source)) for x in names if x.endswith((".html", ".json")) and not x.startswith((".", "_"))]
        out[source] = sorted(found, key=lambda f: (_keyword_and_page(f)[0], _keyword_and_page(f)[1], f))
    return out


def read_files(part: Files) -> Iterator[tuple]:
    """Raw listings of the files; those of one page keep their order."""
    fields = [x.split()[0] for x in catalog.RAW.split(", ")]
    s = catalog.SOURCES[part.source]
    for name in part.names:
        keyword, page = _keyword_and_page(name)
        with open(name, encoding="utf-8", errors="replace") as f:
            body = f.read()
        for i, got in enumerate(catalog.parse_cards(s, body)):
            row = {**dict.fromkeys(fields), "source": s.name, "language": list(s.language), "matched_keyword": keyword or None, "_ord": (page << 16) + i, **got, "workplace": got.get("workplace") or s.place}
            yield (*(row[k] for k in fields), name)


def _wanted(options: dict) -> list[str]:
    """Sources that the option `sources` (names with commas, or a selection's name) means; unknown ones are an error."""
    asked = options.get("sources", "all-including-experimental")
    names, warnings = catalog.select_sources(asked if asked.startswith("all") else asked.split(","))
    if warnings:
        raise ValueError("; ".join(warnings))
    return names


class PageReader(DataSourceReader):
    """Batches of files; a filter on source leaves out the folders of all others."""

    def __init__(self, options: dict):
        self._root, self._sources = options["path"], _wanted(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("source",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self._sources = [s for s in self._sources if s in values]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Files(s, names[i : i + FILES]) for s, names in captured_files(self._root, self._sources).items() for i in range(0, len(names), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return read_files(partition)


class PageStreamReader(DataSourceStreamReader):
    """New files since the last offset; an offset is, for each source, the newest change time and the files that have it."""

    def __init__(self, options: dict):
        self._root, self._sources = options["path"], _wanted(options)

    def _all(self) -> dict[str, list[tuple[int, str]]]:
        return {s: sorted((os.stat(f).st_mtime_ns, f) for f in names) for s, names in captured_files(self._root, self._sources).items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for s, files in self._all().items():
            if files:
                out[s] = {"time": files[-1][0], "files": [f for t, f in files if t == files[-1][0]]}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for s, files in self._all().items():
            if s not in end:
                continue
            a, b = start.get(s, {"time": -1, "files": []}), end[s]
            known, last = set(a["files"]), set(b["files"])
            new = [f for t, f in files if (t > a["time"] or t == a["time"] and f not in known) and (t < b["time"] or f in last)]
            out += [Files(s, new[i : i + FILES]) for i in range(0, len(new), FILES)]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        return read_files(partition)


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: object) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return PageStreamReader(self.options)


RUN_LISTINGS = "run_file string, scanned_at string, place long, job string"


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self._root = options["path"]

    def partitions(self) -> list[InputPartition]:
        names = [self._root] if os.path.isfile(self._root) else sorted(os.path.join(at, x) for at, _, xs in os.walk(self._root) for x in xs if x.endswith(".json") and not x.startswith((".", "_")))
        return [Files("", names[i : i + FILES]) for i in range(0, len(names), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            with open(name, encoding="utf-8") as f:
                run = json.load(f)
            for i, job in enumerate(run.get("jobs") or []):
                yield name, run.get("scanned_at"), i, json.dumps(job, ensure_ascii=False)


class RunDocuments(DataSource):
    """One row for each listing of each run document, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "run_documents"

    def schema(self) -> str:
        return RUN_LISTINGS

    def reader(self, schema: object) -> DataSourceReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters handed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)
    spark.dataSource.register(RunDocuments)


def run_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Listings of run documents in any store that Spark reads: a document over many lines, its `jobs` exploded in order."""
    runs = spark.read.schema(f"scanned_at string, jobs array<struct<{schema}>>").option("multiLine", True).json(path)
    return runs.select(F.input_file_name().alias("run_file"), "scanned_at", F.posexplode("jobs").alias("_ord", "job")).select("run_file", "scanned_at", F.col("_ord").cast("long").alias("_ord"), "job.*")
