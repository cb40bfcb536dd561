"""Pages over HTTP: a fetch of a table of URLs, one host after the other in a task."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

FETCHED = "url string, html string, status int, error string"
# Content types of pages.
PAGE_TYPES = ("text/html", "application/xhtml")

Opener = Callable[[str, float], tuple[int, str, bytes]]


def open_url(url: str, timeout: float) -> tuple[int, str, bytes]:
    """Status, content type and body; redirects are followed, other failures raise."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "corpusloom"}), timeout=timeout) as r:  # noqa: S310
        return r.status, r.headers.get("Content-Type", ""), r.read()


def fetch_one(url: str, opener: Opener, timeout: float, attempts: int, wait: tuple[float, float]) -> tuple[str | None, int | None, str | None]:
    """html, status, error of one URL.

    Every attempt but the last is followed by a pause that doubles between
    the two bounds.  A page of another content type is an error at once.
    """
    pause, status, error = wait[0], None, None
    for k in range(attempts):
        try:
            status, kind, body = opener(url, timeout)
            if status >= 400:
                raise urllib.error.HTTPError(url, status, "refused", None, None)
            if not any(t in kind for t in PAGE_TYPES):
                return None, status, f"not a page: {kind}"
            charset = kind.partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
            try:
                return body.decode(charset, "replace"), status, None
            except LookupError:
                return body.decode("utf-8", "replace"), status, None
        except urllib.error.HTTPError as e:
            status, error = e.code, f"HTTP {e.code}"
        except Exception as e:  # noqa: BLE001  whatever the network raises belongs to this page
            error = f"{type(e).__name__}: {e}"[:200]
        if k < attempts - 1:
            time.sleep(pause)
            pause = min(wait[1], 2 * pause)
    return None, status, error


def fetch_pages(urls: DataFrame, opener: Opener = open_url, timeout: float = 30.0, attempts: int = 2, wait: tuple[float, float] = (1.0, 5.0), delay: float = 1.0) -> DataFrame:
    """FETCHED columns for every row of urls; a failure is a row with an error.

    URLs of a host go to one task, which leaves `delay` seconds between them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for url, host in zip(pdf["url"], pdf["host"], strict=True):
                early = last.get(host, 0.0) + delay - time.monotonic()
                if host in last and early > 0:
                    time.sleep(early)
                rows.append((url, *fetch_one(url, opener, timeout, attempts, wait)))
                last[host] = time.monotonic()
            out = pd.DataFrame(rows, columns=["url", "html", "status", "error"])
            yield out.astype({"status": "Int32"})

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.select("url", U.domain(F.col("url")).alias("host")).repartition(n, "host").mapInPandas(run, FETCHED)
