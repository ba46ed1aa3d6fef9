"""A paged interface with continuation tokens as a stream: the token is the stream's offset, so a stopped read goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: given a token (None: the beginning), the rows of its page and the token of the next one (None: there is none)
Fetch = Callable[[str | None], tuple[list[tuple], str | None]]


class _Pages(SimpleDataSourceStreamReader):
    """Offsets are {page, token, last}: how many pages were read, the token of the next one, whether there is none."""

    def __init__(self, fetch: Fetch, pages_per_batch: int):
        self.fetch, self.pages_per_batch = fetch, pages_per_batch

    def initialOffset(self) -> dict:
        return {"page": 0, "token": None, "last": False}

    def _pages(self, at: dict, until: int) -> tuple[list[tuple], dict]:
        rows: list[tuple] = []
        while at["page"] < until and not at["last"]:
            page, token = self.fetch(at["token"])
            rows += page
            at = {"page": at["page"] + 1, "token": token, "last": token is None}
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._pages(start, start["page"] + self.pages_per_batch)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that comes again after a failure: the same pages by the same tokens."""
        return iter(self._pages(start, end["page"])[0])


def paged_stream(spark: SparkSession, name: str, schema: str, fetch: Fetch, pages_per_batch: int = 10) -> DataFrame:
    """Rows of all pages as a stream; ``fetch`` is injected and asked for one page after the other, as each token comes with the page before.

    A batch holds at most ``pages_per_batch`` pages. A page is asked for again only when its batch failed; pages that appear behind a
    last page are not looked for.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Pages(fetch, pages_per_batch)

    spark.dataSource.register(Paged)
    return spark.readStream.format(name).load()


def read_pages(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Reads until no page is left; how many rows came. One batch a run, so the checkpoint stands after every ``pages_per_batch`` pages."""
    total = 0
    while True:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        came = sum(p.numInputRows for p in query.recentProgress)
        total += came
        if not came:
            return total
