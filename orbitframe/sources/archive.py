"""A remote STAC archive: cursor pages through an injected client, and byte ranges of products."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UnreadableProduct
from ..functions.geometry import to_geojson
from ..plans.spec import SearchSpec

Post = Callable[[str, dict], dict]


def interval(start: date | None, end: date | None) -> str | None:
    if start is None and end is None:
        return None
    text = lambda d, t: f"{d.isoformat()}T{t}Z" if d else ".."
    return f"{text(start, '00:00:00')}/{text(end, '23:59:59')}"


def request(spec: SearchSpec) -> dict:
    """The body of a search: a box or a polygon, the interval, and a page size of at most 500."""
    s = spec.validated()
    body: dict = {"limit": min(s.limit, 500) if s.limit else 100}
    if s.rings:
        body["intersects"] = to_geojson(s.rings)
    elif s.bbox:
        body["bbox"] = list(s.bbox)
    if when := interval(s.start, s.end):
        body["datetime"] = when
    if s.ids:
        body["ids"] = list(s.ids)
    return body


def pages(post: Post, url: str, body: dict) -> Iterator[dict]:
    """Features page by page; a `next` link brings its own body, merged with the one before if it says so."""
    while True:
        reply = post(url, body)
        yield from reply.get("features") or []
        link = next((x for x in reply.get("links") or [] if x.get("rel") == "next" and x.get("href")), None)
        if link is None:
            return
        own = link.get("body") or {}
        url, body = link["href"], {**body, **own} if link.get("merge") else own or body


def archive(spark: SparkSession, post: Post, url: str, spec: SearchSpec) -> DataFrame:
    """doc and href of an archive's features.  A cursor can't be split: one partition reads, the rest of the plan doesn't mind.

    Filters that the archive doesn't know (products, names, angles) belong on the acquisitions made from the documents.
    """
    body = request(spec)

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            for feature in pages(post, url, body):
                own = next((x.get("href") for x in feature.get("links") or [] if x.get("rel") == "self"), None)
                yield json.dumps(feature), own

    class Archive(DataSource):
        @classmethod
        def name(cls) -> str:
            return "stac_archive"

        def schema(self) -> str:
            return "doc string, href string"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Archive)
    return spark.read.format("stac_archive").load()


class RangeReader:
    """Byte ranges of a remote product.  fetch(url, first, last) gives (status, body, size); 404 and 410 mean that it is gone.

    A server that ignores ranges answers 200 with all bytes, of which the wanted ones are cut out.
    """

    def __init__(self, url: str, fetch: Callable[[str, int, int], tuple[int, bytes, int | None]]):
        self.url, self.fetch, self.bytes_read, self.size = url, fetch, 0, None

    def __call__(self, offset: int, length: int) -> bytes:
        status, body, size = self.fetch(self.url, offset, offset + length - 1)
        if status in (404, 410):
            raise UnreadableProduct("the product is absent")
        if status not in (200, 206):
            raise UnreadableProduct(f"status {status}")
        self.bytes_read += len(body)
        self.size = size if size is not None else self.size
        return body[offset : offset + length] if status == 200 else body
