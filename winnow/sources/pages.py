"""Paged search results as a data source: a partition for each page, fetched where it is read."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How often a page is asked for, and the seconds before the second time; each wait is twice the last.
TRIES, WAIT = 20, 1.0


class Page(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


def fetched(get: Callable[[int, int], str], start: int, count: int, tries: int, wait: float, longest: float = 60.0) -> str:
    """One page, asked for until it comes, ``tries`` times in all; the last failure is raised."""
    for attempt in range(tries):
        try:
            return get(start, count)
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(min(longest, wait * 2**attempt))
    raise ValueError("a page has to be asked for at least once")


def read_pages(spark: SparkSession, get: Callable[[int, int], str], total: int, page: int = 200, limit: int | None = None, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(start, value): the texts of ``get(start, count)`` over a result of ``total`` records, or of its
    first ``limit``, the last page cut to what is left.

    ``get`` goes to the executors, so it has to pickle and to find its service from there.  A page that
    can't be had after all tries fails the read rather than be left out.  No pages are no rows."""
    if page < 1:
        raise ValueError("a page holds at least one record")
    most = total if limit is None else min(total, limit)

    class Reader(DataSourceReader):
        def partitions(self) -> list[Page]:
            return [Page(start, min(page, most - start)) for start in range(0, most, page)]

        def read(self, partition: Page) -> Iterator[tuple[int, str]]:
            yield partition.start, fetched(get, partition.start, partition.count, tries, wait)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "winnow_pages"

        def schema(self) -> str:
            return "start long, value string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    if most <= 0:
        return spark.createDataFrame([], "start long, value string")
    spark.dataSource.register(Pages)  # the last one registered is read; a frame keeps its own
    return spark.read.format("winnow_pages").load()
