"""Pages of a MediaWiki by its export form, with an exchangeable fetcher."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dictionary as dic
from ..plans.tables import ensure_checkpoint_dir

Fetch = Callable[[Sequence[str]], str]


def http_fetch(base: str = "https://en.wikipedia.org/wiki/Special:Export", timeout: float = 3.05) -> Fetch:
    """A fetcher that posts titles to an export form."""

    def fetch(titles: Sequence[str]) -> str:
        form = urllib.parse.urlencode({"pages": "\n".join(titles), "curonly": "1"}).encode()
        with urllib.request.urlopen(urllib.request.Request(base, form), timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    return fetch


def exports(titles: DataFrame, fetch: Fetch, batch: int = 25) -> DataFrame:
    """(xml) of the titles (title), ``batch`` at a time; one retry, then left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = [t for t in rows.column(0).to_pylist() if t]
            for k in range(0, len(names), batch):
                for _ in range(2):
                    try:
                        yield pa.RecordBatch.from_arrays([pa.array([fetch(names[k : k + batch])], pa.string())], names=["xml"])
                        break
                    except OSError:
                        continue

    return titles.select("title").mapInArrow(task, "xml string")


def crawl(spark: SparkSession, topics: Sequence[str], fetch: Fetch, batch: int = 25) -> DataFrame:
    """(title, body) of the topics, of the pages they link to, and of redirects' aims.

    All links are fetched. Pages that are named twice are fetched once.
    """
    start = spark.createDataFrame([(t,) for t in dict.fromkeys(topics)], "title string")
    ensure_checkpoint_dir(spark)
    first = dic.wiki_pages(exports(start, fetch, batch)).checkpoint()  # fetched once, whatever is lost
    links = first.select(F.explode(dic.wiki_links(F.col("body"))).alias("title")).distinct()
    second = dic.wiki_pages(exports(links.join(start, "title", "left_anti").coalesce(4), fetch, batch))
    pages = first.unionByName(second).dropDuplicates(["title"])
    return dic.wiki_redirects(pages).select("title", "body")


def topic_dictionary(spark: SparkSession, topics: Sequence[str], fetch: Fetch, base: DataFrame | None = None, large: bool = False) -> DataFrame:
    """(word, freq) trained on the pages of some topics, merged with a base.

    Unless ``large``, the result has the usual cap of words.
    """
    found = dic.train(crawl(spark, topics, fetch).select(dic.wiki_text(text.fold(F.col("body"))).alias("text")))
    found = dic.merge(found, base) if base is not None else found
    return found if large else dic.cap(found)
