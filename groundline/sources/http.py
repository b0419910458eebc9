"""A paged HTTP connector as a Spark data source: one partition, since rate limits hold for a client as a whole."""

from __future__ import annotations

import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from groundline.config import AcquisitionError

# Answers worth another try, tries, and the waits between them.
RETRIED, TRIES, FIRST_WAIT, LONGEST_WAIT = frozenset([429, 500, 502, 503, 504]), 4, 2.0, 16.0


class Slots:
    """Time cut to slots of 1/rate seconds, a call to each: a call takes the first slot not yet begun or taken."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.taken = rate, clock, sleep, -1

    def take(self) -> None:
        now = self.clock()
        self.taken = max(self.taken + 1, math.ceil(now * self.rate))
        if (ahead := self.taken / self.rate - now) > 0:
            self.sleep(ahead)


def fetch(url: str, headers: dict[str, str], slots: Slots, opener: Callable = urllib.request.urlopen) -> str:
    """Body of a page, tried again with growing waits where that may help."""
    wait = FIRST_WAIT
    for left in range(TRIES - 1, -1, -1):
        slots.take()
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=30) as answer:
                return answer.read().decode("utf-8", errors="replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or not left:
                raise AcquisitionError(f"{url}: {e}") from e
        except urllib.error.URLError as e:
            if not left:
                raise AcquisitionError(f"{url}: {e}") from e
        slots.sleep(wait)
        wait = min(wait * 2, LONGEST_WAIT)
    raise AssertionError


class PagesSource(DataSource):
    """``spark.read.format("pages").option("urls", "a b c").option("agent", "name mail@host").option("rate", 8)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        if "@" not in options.get("agent", ""):
            raise ValueError("the agent must name a contact address")
        self.urls, self.agent, self.rate = options.get("urls", "").split(), options["agent"], float(options.get("rate", 8))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        slots = Slots(self.rate)
        for url in self.urls:
            yield url, fetch(url, {"User-Agent": self.agent}, slots)


def read_pages(spark: SparkSession, urls: list[str], agent: str, rate: float = 8) -> DataFrame:
    """Payloads of addresses, in one task, since a rate holds for a client as a whole: url, payload."""
    register(spark)
    return spark.read.format("pages").options(urls=" ".join(urls), agent=agent, rate=rate).load()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)
