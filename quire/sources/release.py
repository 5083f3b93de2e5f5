"""The latest release from a web service, as a data source to read once or to poll."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from quire.functions import naming as N
from quire.workers import ship

#: Seconds to wait, the version of an application that names none.
TIMEOUT = 8
NO_VERSION = "0"


def latest(url: str, accept: str, timeout: float) -> tuple[str | None, str | None]:
    """Tag and page of the latest release; both null after any failure, and where either is no string."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept}), timeout=timeout) as answer:
            found = json.loads(answer.read())
        tag, page = found["tag_name"], found["html_url"]
    except Exception:  # whatever goes wrong, there is no news
        return None, None
    return (tag, page) if isinstance(tag, str) and isinstance(page, str) else (None, None)


class _Once(DataSourceReader):
    def __init__(self, options: dict):
        self.how = (options["url"], options.get("accept", "application/json"), float(options.get("timeout", TIMEOUT)))

    def read(self, partition) -> Iterator[tuple]:
        yield latest(*self.how)


class _Polled(SimpleDataSourceStreamReader):
    """Each batch asks once; what it was told is kept with the batch's number."""

    def __init__(self, options: dict):
        self.how = (options["url"], options.get("accept", "application/json"), float(options.get("timeout", TIMEOUT)))
        self.told: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"asked": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.told[start["asked"]] = latest(*self.how)
        return iter([self.told[start["asked"]]]), {"asked": start["asked"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.told[i] if i in self.told else latest(*self.how) for i in range(start["asked"], end["asked"])])


class ReleaseSource(DataSource):
    """format("release"): option url; accept and timeout (seconds) as wished. One row (tag, page) for each time it is asked."""

    @classmethod
    def name(cls) -> str:
        return "release"

    def schema(self) -> str:
        return "tag string, page string"

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Polled(self.options)


def releases(spark: SparkSession, url: str, stream: bool = False, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ReleaseSource)
    return (spark.readStream if stream else spark.read).format("release").option("url", url).options(**options).load()


def news(found: DataFrame, current: Column | None = None) -> DataFrame:
    """(version, page) of each answer: both null unless the tag is a later version than the current one and the page a URL."""
    known = F.coalesce(F.lit(None).cast("string") if current is None else current, F.lit(NO_VERSION))
    page = N.url_or_null(F.col("page"))
    newer = F.coalesce(N.version_newer(F.col("tag"), known) & page.isNotNull(), F.lit(False))
    return found.select(F.when(newer, F.col("tag")).alias("version"), F.when(newer, page).alias("page"))
