"""A table source of descriptors, each one partition: ``spark.read.format("descriptors")``.

A descriptor names a loader registered in ``LOADERS``; a loader that raises gives no rows and its error in the report.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOADERS: dict[str, Callable[[dict], Iterator[tuple[str, str]]]] = {}


def loader(name: str) -> Callable:
    def register(f: Callable) -> Callable:
        LOADERS[name] = f
        return f

    return register


@loader("inline")
def inline(descriptor: dict) -> Iterator[tuple[str, str]]:
    """Documents given in the descriptor itself as (key, body)."""
    yield from ((str(k), str(v)) for k, v in descriptor["documents"])


@loader("file")
def file(descriptor: dict) -> Iterator[tuple[str, str]]:
    """A text file on storage every task reaches."""
    with open(descriptor["path"], encoding="utf-8") as f:
        yield descriptor["path"], f.read()


class _Part(InputPartition):
    def __init__(self, place: int, descriptor: dict):
        self.place, self.descriptor = place, descriptor


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.descriptors = json.loads(options.get("descriptors", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(i, d) for i, d in enumerate(self.descriptors)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        d = partition.descriptor
        try:
            rows = list(LOADERS[d["loader"]](d))
        except Exception as e:  # noqa: BLE001 - one source's failure is its own
            yield partition.place, d.get("source", ""), None, None, f"{type(e).__name__}: {e}"
            return
        for key, body in rows:
            yield partition.place, d.get("source", ""), key, body, None


class DescriptorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "descriptors"

    def schema(self) -> str:
        return "source_ord int, source string, key string, body string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DescriptorSource)
