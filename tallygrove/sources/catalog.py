"""Catalogs over HTTP as a data source: a row an element of each JSON answer, or a row that says why there is none.

``spark.dataSource.register(CatalogSource)`` once, then ``spark.read.format("catalog").schema(...).option("urls", ...)``. Each url is
a partition, so tasks fetch side by side and a lost one fetches again. A stream takes the urls of a list file as they are
appended; its offset is the number of lines taken.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: First bytes of what is compressed, whatever the headers say.
GZIP = b"\x1f\x8b"


class Url(InputPartition):
    def __init__(self, url: str) -> None:
        super().__init__(url)
        self.url = url


def fetch(url: str, tries: int, wait: float, timeout: float) -> tuple[list, str | None]:
    """(elements, error): a list's elements, or an object alone. What isn't there (404) isn't asked for again; an empty answer has no element."""
    error = None
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "gzip"}), timeout=timeout) as answer:
                body = answer.read()
            if body.startswith(GZIP):
                body = gzip.decompress(body)
            got = json.loads(body) if body.strip() else []
            return got if isinstance(got, list) else [got], None
        except (OSError, ValueError, EOFError) as e:  # the network's, compression's and JSON's
            error = f"{type(e).__name__}: {e}"[:120]
            if isinstance(e, urllib.error.HTTPError) and e.code in (401, 403, 404, 410):
                break
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return [], error


class _Fetching:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.how = int(options.get("tries", "3")), float(options.get("wait", "0.5")), float(options.get("timeout", "30"))
        self.options = options

    def read(self, partition: Url) -> Iterator[tuple]:
        rows, error = fetch(partition.url, *self.how)
        for r in rows:
            # values as the catalog has them, as text; what is no object has none
            r = r if isinstance(r, dict) else {}
            told = {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in r.items()} | {"url": partition.url, "error": None}
            yield tuple(told.get(n) for n in self.names)
        if error is not None:
            yield tuple({"url": partition.url, "error": error}.get(n) for n in self.names)


class CatalogReader(_Fetching, DataSourceReader):
    def partitions(self) -> list[Url]:
        return [Url(u) for u in self.options.get("urls", "").split()]


class CatalogStream(_Fetching, DataSourceStreamReader):
    def _urls(self) -> list[str]:
        with open(self.options["list"], encoding="utf-8") as f:  # the driver's alone; tasks get urls
            return f.read().split()

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": len(self._urls())}

    def partitions(self, start: dict, end: dict) -> list[Url]:
        return [Url(u) for u in self._urls()[start["line"] : end["line"]]]


class CatalogSource(DataSource):
    """Columns are the catalog's fields by name, as text, and ``url`` and ``error``."""

    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return "url string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CatalogReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CatalogStream(schema, self.options)
