"""A paged list as a data source: one page is one partition.

    spark.dataSource.register(PagedList)
    spark.read.format("paged_list").option("url", "file:///saved/list?limit={limit}&offset={offset}").option("total", 250).option("limit", 100).load()

gives (page, offset, body). The address is any that the standard library opens; without a total the whole list is one page.
"""

from __future__ import annotations

import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What one page asks for if it is to be the whole list.
WHOLE = 99_999


class Page(InputPartition):
    def __init__(self, number: int, offset: int, limit: int):
        super().__init__(number)
        self.number, self.offset, self.limit = number, offset, limit


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.limit, self.total = options["url"], int(options.get("limit", WHOLE)), int(options.get("total", 0))

    def partitions(self) -> list[Page]:
        return [Page(k, k * self.limit, self.limit) for k in range(max(1, -(-self.total // self.limit)))]

    def read(self, page: Page):
        with urllib.request.urlopen(self.url.replace("{limit}", str(page.limit)).replace("{offset}", str(page.offset))) as f:
            yield page.number, page.offset, f.read().decode("utf-8")


class PagedList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return "page int, offset long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
