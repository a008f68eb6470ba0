"""Kept answers of crawls as a data source, for batches and streams.

An answer is one file, ``<path>/<source>/<kind>/<number>.json``; numbers grow with
time. A partition is a range of numbers of one source and kind. Filters on source, kind and
number are pushed down where ``spark.sql.python.filterPushdown.enabled`` is on, and may
be given as options anyway, so folders and files outside them are never opened. A
stream's offset is the next number of every folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, kind string, number long, payload string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
STEP = 64


@dataclass(frozen=True)
class Range(InputPartition):
    """Numbers of a folder that are there, so that a task opens its files without listing the folder."""

    source: str
    kind: str
    numbers: tuple[int, ...]

    def __init__(self, source: str, kind: str, numbers: tuple[int, ...]):
        for name, value in (("source", source), ("kind", kind), ("numbers", numbers)):
            object.__setattr__(self, name, value)
        object.__setattr__(self, "value", (source, kind, numbers))


class _Folder:
    def __init__(self, options: dict):
        self.path, self.step = options["path"].rstrip("/"), int(options.get("step", STEP))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def _names(self, *parts: str) -> list[str]:
        system, root = self._open()
        found = system.get_file_info(fs.FileSelector("/".join((root, *parts)), allow_not_found=True))
        return sorted(x.base_name for x in found)

    def folders(self, sources=None, kinds=None) -> Iterator[tuple[str, str]]:
        for source in self._names():
            if sources is None or source in sources:
                yield from ((source, kind) for kind in self._names(source) if kinds is None or kind in kinds)

    def numbers(self, source: str, kind: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(source, kind) if n.endswith(".json") and n[:-5].isdigit())

    def ranges(self, source: str, kind: str, first: int = 0, end: int | None = None) -> Iterator[Range]:
        numbers = [n for n in self.numbers(source, kind) if n >= first and (end is None or n < end)]
        for at in range(0, len(numbers), self.step):
            yield Range(source, kind, tuple(numbers[at : at + self.step]))

    def read(self, partition: Range | None) -> Iterator[tuple]:
        """Spark asks for one partition of nothing where there is none."""
        system, root = self._open()
        p = partition
        for n in p.numbers if p is not None else ():
            with system.open_input_stream(f"{root}/{p.source}/{p.kind}/{n}.json") as f:
                yield p.source, p.kind, n, f.read().decode("utf-8", "replace")


class Scan(_Folder, DataSourceReader):
    """Options ``source``, ``kind``, ``first`` and ``end`` bound what is read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.sources = {options["source"]} if "source" in options else None
        self.kinds = {options["kind"]} if "kind" in options else None
        self.first, self.end = int(options.get("first", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[Range]:
        return [r for folder in self.folders(self.sources, self.kinds) for r in self.ranges(*folder, self.first, self.end)]


class Reader(Scan):
    """The same bounds from filters of the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "source" and values is not None:
                self.sources = values if self.sources is None else self.sources & values
            elif name == "kind" and values is not None:
                self.kinds = values if self.kinds is None else self.kinds & values
            elif name == "number" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif name == "number" and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            elif name == "number" and isinstance(f, EqualTo):
                self.first, self.end = max(self.first, f.value), f.value + 1 if self.end is None else min(self.end, f.value + 1)
            else:
                yield f


class StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f"{source}/{kind}": numbers[-1] + 1 for source, kind in self.folders() if (numbers := self.numbers(source, kind))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for folder, n in sorted(end.items()) for r in self.ranges(*folder.split("/"), start.get(folder, 0), n)]


class KeptAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kept_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Scan:
        return (Reader if self.options.get("pushdown") == "true" else Scan)(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def answers(spark: SparkSession, path: str, step: int = STEP, **bounds: str | int) -> DataFrame:
    """Kept answers; ``source``, ``kind``, ``first`` and ``end`` bound them whether or not filters are pushed down."""
    spark.dataSource.register(KeptAnswers)
    return spark.read.format("kept_answers").options(path=path, step=step, pushdown=spark.conf.get(PUSHDOWN, "false"), **bounds).load()


def answer_stream(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    spark.dataSource.register(KeptAnswers)
    return spark.readStream.format("kept_answers").option("path", path).option("step", step).load()


def keep(rows: DataFrame, path: str) -> int:
    """Write ``rows (source, kind, number, payload)`` as files of the bronze folder, a task its own; how many."""
    folder = _Folder({"path": path})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = folder._open()
        made = set()
        for b in batches:
            for source, kind, number, payload in zip(b["source"], b["kind"], b["number"], b["payload"]):
                if (source, kind) not in made:
                    system.create_dir(f"{root}/{source}/{kind}")
                    made.add((source, kind))
                with system.open_output_stream(f"{root}/{source}/{kind}/{number}.json") as f:
                    f.write(payload.encode())
            yield pd.DataFrame({"n": [len(b)]})

    told = rows.select("source", "kind", F.col("number").cast("long").alias("number"), "payload").mapInPandas(write, "n long")
    return told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
