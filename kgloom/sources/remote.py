"""A paged remote table as a data source: one partition a page, with retries.

Register with `spark.dataSource.register(PagedSource)`, then
`spark.read.format("paged").option("pages", n).option("size", k).option("replay", folder).load()`.
The replay back end reads page files (`page_00000.json`: {"results": {"bindings": [...]}})
from a folder that the cluster shares; the http back end asks `url` with limit and offset.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(int(self.options.get("pages", 1)))]

    def fetch(self, number: int) -> list[dict]:
        folder = self.options.get("replay")
        if folder:
            path = os.path.join(folder, f"page_{number:05d}.json")
            if not os.path.exists(path):
                return []
            with open(path, encoding="utf-8-sig") as f:
                return json.load(f).get("results", {}).get("bindings", [])
        import urllib.parse
        import urllib.request

        size = int(self.options.get("size", 100))
        query = urllib.parse.urlencode({"query": f"{self.options['query']} LIMIT {size} OFFSET {number * size}", "format": "json"})
        with urllib.request.urlopen(f"{self.options['url']}?{query}", timeout=60) as r:
            return json.load(r).get("results", {}).get("bindings", [])

    def read(self, partition: Page) -> Iterator[tuple]:
        tries, base = int(self.options.get("retries", 3)), float(self.options.get("backoff", 2))
        for attempt in range(tries + 1):
            try:
                rows = self.fetch(partition.number)
                break
            except OSError:
                if attempt == tries:
                    raise
                time.sleep(base**attempt)
        for i, b in enumerate(rows):
            yield partition.number, i, {k: str(v.get("value", "")) for k, v in b.items()}


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, row int, bindings map<string,string>"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def summary_address(base: str, title: str) -> str:
    """The address of the summary of an article; blanks of the title are underscores, all else is quoted."""
    import urllib.parse

    return f"{base.rstrip('/')}/{urllib.parse.quote(title.strip().replace(' ', '_'), safe='')}"


def summaries(titles, base: str, replay: str | None = None, timeout: int = 60, retries: int = 3, backoff: float = 2.0):
    """(entity_id, title, extract, error) of rows (entity_id, title), asked for where the rows stand; a failed one is an error of its row.

    replay: a folder of saved answers (`<quoted title>.json`) that the cluster shares.
    """
    import urllib.error
    import urllib.request

    import pandas as pd

    def ask(title: str) -> str | None:
        address = summary_address(base, title)
        if replay:
            with open(os.path.join(replay, address.rpartition("/")[2] + ".json"), encoding="utf-8-sig") as f:
                return json.load(f).get("extract")
        with urllib.request.urlopen(address, timeout=timeout) as r:
            return json.load(r).get("extract")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, t in zip(rows.entity_id, rows.title):
                for attempt in range(retries + 1):
                    try:
                        out.append((i, t, ask(t) if t else None, None))
                        break
                    except FileNotFoundError:
                        out.append((i, t, None, "missing"))
                        break
                    except (OSError, ValueError) as e:
                        if attempt == retries:
                            out.append((i, t, None, str(e)[:200]))
                        else:
                            time.sleep(backoff**attempt)
            yield pd.DataFrame(out, columns=["entity_id", "title", "extract", "error"])

    return titles.select("entity_id", "title").mapInPandas(run, "entity_id string, title string, extract string, error string")
