"""A paged literature service as a Python data source: one input partition a page, the fetcher injected by its import path."""

from __future__ import annotations

import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, id string, title string, year string, cited_by int"


class Pages(DataSource):
    """Options: fetch ('module:function' of (query, page) to a JSON text with results), query, pages."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Page(InputPartition):
    def __init__(self, n: int):
        super().__init__(n)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.query, self.pages = options["fetch"], options.get("query", ""), int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(self.pages)]

    def read(self, partition: InputPartition):
        module, _, name = self.fetch.partition(":")
        answer = json.loads(getattr(importlib.import_module(module), name)(self.query, partition.value))
        for r in answer.get("results", []):
            yield partition.value, r.get("id"), r.get("title"), r.get("year"), r.get("cited_by")
