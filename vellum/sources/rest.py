"""Paged JSON services as a Spark source: batches of ids are partitions, each follows its own cursor."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import reduce
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How often a page is tried, and answers after which trying again may help.
TRIES = 4
PASSING = {429, 500, 502, 503, 504}


class Batch(InputPartition):
    def __init__(self, number: int, ids: list[str]):
        super().__init__(number)
        self.number, self.ids = number, ids


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.results, self.next = options["url"], options.get("results", "results"), options.get("next", "meta.next_cursor")
        self.first, self.joint, self.pause = options.get("first", "*"), options.get("joint", "|"), float(options.get("pause", "1"))
        self.ids, self.size = json.loads(options.get("ids", "[]")), int(options.get("batch", "50"))

    def partitions(self) -> list[Batch]:
        """A partition a batch of ids; without ids one partition follows the cursor from its start."""
        batches = [self.ids[i : i + self.size] for i in range(0, len(self.ids), self.size)] or [[]]
        return [Batch(n, ids) for n, ids in enumerate(batches)]

    def _page(self, url: str) -> dict:
        for attempt in range(TRIES):
            try:
                with urlopen(url, timeout=60) as answer:
                    return json.load(answer)
            except URLError as error:
                passing = not isinstance(error, HTTPError) or error.code in PASSING
                if not passing or attempt + 1 == TRIES:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError("unreachable")

    def read(self, partition: Batch) -> Iterator[tuple]:
        cursor, page, seen = self.first, 0, set()
        while cursor is not None and cursor is not False and cursor != "" and cursor not in seen:  # a number is a cursor too, and 0 is one
            seen.add(cursor)
            body = self._page(self.url.replace("{ids}", quote(self.joint.join(partition.ids), safe="")).replace("{cursor}", quote(str(cursor), safe="")))
            records = body.get(self.results) or []
            for n, record in enumerate(records):
                yield partition.number, page, n, json.dumps(record)
            cursor = reduce(lambda at, key: (at or {}).get(key), self.next.split("."), body) if records else None
            page += 1


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "batch int, page int, n int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, url: str, ids: list[str] | None = None, **options: str) -> DataFrame:
    """(batch, page, n, record): the records, as JSON texts, of a service's pages.

    url holds {ids} (a batch of them, joined) and {cursor}. A batch ends with a page that has no records or names no cursor, or one
    that was followed before. A page that fails for a while is tried again; the task fails with one that goes on failing, and
    Spark reads its batch anew. Null ids are left out; from_json gives records their columns.
    """
    spark.dataSource.register(PagedJson)
    wanted = json.dumps([i for i in ids or [] if i is not None])
    return spark.read.format("paged_json").options(url=url, ids=wanted, **options).load()
