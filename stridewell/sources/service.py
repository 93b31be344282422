"""Activities of a tracking service, fetched page by page by Spark's tasks.

``fetch_activities`` reads a paged REST endpoint that answers with a JSON array per
page.  How many pages there are is asked once; then pages are dealt to input
partitions.  A request that fails for a passing reason is repeated after a pause.
Pages that were fetched can be kept in a folder, so a fetch that broke off goes on
where it stopped.  The access token is read where a request is made, from the
environment or a file: it is in no option, plan or log.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .exports import EXPORT
from .files import store

#: Answers that another try may change.
PASSING = {408, 425, 429, 500, 502, 503, 504}
PAGES = T.StructType([T.StructField("page", T.IntegerType(), False), T.StructField("position", T.IntegerType(), False),
                      T.StructField("value", T.StringType())])


class Client:
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("perpage", 100))
        self.token_env, self.token_file = options.get("tokenenv"), options.get("tokenfile")
        self.retries, self.pause = int(options.get("retries", 5)), float(options.get("pause", 1.0))
        self.timeout, self.total = float(options.get("timeout", 60)), options.get("totalheader", "X-Total-Count")

    def token(self) -> str | None:
        if self.token_file:
            with open(self.token_file) as f:
                return f.read().strip()
        if self.token_env:
            if self.token_env not in os.environ:
                raise ValueError(f"the environment has no {self.token_env}")
            return os.environ[self.token_env]
        return None

    def get(self, page: int) -> tuple[list, dict]:
        """A page's activities and the answer's headers."""
        parts = urllib.parse.urlsplit(self.url)
        asked = urllib.parse.parse_qsl(parts.query) + [("page", page), ("per_page", self.size)]
        request = urllib.request.Request(urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(asked))))
        if token := self.token():
            request.add_unredirected_header("Authorization", f"Bearer {token}")
        for attempt in range(self.retries + 1):
            wait = self.pause * 2 ** attempt
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    rows = json.loads(answer.read())
                    if not isinstance(rows, list):
                        raise ValueError(f"page {page} is no array")
                    return rows, dict(answer.headers)
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or attempt == self.retries:
                    raise RuntimeError(f"page {page}: the service answers {e.code}") from None
                told = e.headers.get("Retry-After", "")
                wait = float(told) if told.isdigit() else wait
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                if attempt == self.retries:
                    raise RuntimeError(f"page {page}: {type(e).__name__} after {attempt + 1} tries") from None
            time.sleep(wait)
        raise AssertionError

    def pages(self) -> int:
        """How many pages there are: by the header that tells the number of activities,
        else by asking for pages of doubling number and halving between."""
        rows, headers = self.get(1)
        told = next((v for k, v in headers.items() if k.lower() == self.total.lower()), "")
        if told.isdigit():
            return -(-int(told) // self.size)
        if len(rows) < self.size:
            return bool(rows)
        full, empty = 1, 2
        while self.get(empty)[0]:
            full, empty = empty, empty * 2
        while empty - full > 1:
            middle = (full + empty) // 2
            full, empty = (middle, empty) if self.get(middle)[0] else (full, middle)
        return full


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.each, self.kept = Client(options), int(options.get("pagespertask", 4)), options.get("kept")

    def partitions(self):
        n = int(self.keep("count", lambda: self.client.pages()))
        return [PageRange(i, min(i + self.each, n + 1)) for i in range(1, n + 1, self.each)] or [PageRange(1, 1)]

    def keep(self, name: str, make: Callable):
        """What ``make`` gives, from the folder of kept pages if it was made before.  A
        file appears there only when it is whole."""
        if not self.kept:
            return make()
        system, folder = store(self.kept)
        path = f"{folder}/{name}.json"
        if system.get_file_info(path).is_file:
            with system.open_input_stream(path) as f:
                return json.loads(f.read())
        made = make()
        system.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as f:
            f.write(json.dumps(made).encode())
        system.move(own, path)
        return made

    def read(self, partition: PageRange):
        for page in range(partition.first, partition.last):
            for i, row in enumerate(self.keep(f"page-{page:08d}", lambda page=page: self.client.get(page)[0])):
                yield page, i, json.dumps(row)


class PageSource(DataSource):
    """Rows ``page, position, value`` (an activity's JSON) of a paged service."""

    @classmethod
    def name(cls) -> str:
        return "activity_pages"

    def schema(self):
        return PAGES

    def reader(self, schema):
        return PageReader(dict(self.options))


def fetch_activities(spark: SparkSession, url: str, schema: T.StructType = EXPORT, *, token_env: str | None = None, token_file: str | None = None,
                     kept: str | None = None, per_page: int = 100, pages_per_task: int = 4, retries: int = 5, pause: float = 1.0) -> DataFrame:
    """A service's activities with ``schema``'s columns, all pages of them.

    ``token_env`` names the environment variable of driver and executors, or
    ``token_file`` the file, that holds the access token.  Answers 408, 425, 429 and
    5xx and broken connections are tried ``retries`` times more, after the time the
    service asks for or ``pause`` seconds, doubled each time; other answers fail the
    read at once.  With a shared folder ``kept`` each page is fetched once ever: a
    later read of that folder asks only for the pages that it lacks.  Values of
    another type than the schema's are null.  A service without activities gives no
    rows.
    """
    spark.dataSource.register(PageSource)
    source = spark.read.format("activity_pages").option("url", url).option("perPage", per_page).option("pagesPerTask", pages_per_task)
    source = source.option("retries", retries).option("pause", pause)
    for name, value in (("tokenEnv", token_env), ("tokenFile", token_file), ("kept", kept)):
        source = source.option(name, value) if value else source
    return source.load().select(F.from_json("value", schema).alias("a")).select("a.*")
