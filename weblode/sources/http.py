"""HTTP fetch as a per-partition map over a table of URLs."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_BODY = 50 << 20
MAX_REDIRECTS = 10
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; weblode)", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}
SCHEMA = "line long, url string, status int, content_type string, body binary, error string"


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS


def get(url: str, timeout: float) -> dict:
    """One GET: body cut at MAX_BODY, MIME type without parameters; an error leaves the body null."""
    try:
        opener = urllib.request.build_opener(_Redirects)
        with opener.open(urllib.request.Request(url, headers=HEADERS), timeout=timeout if timeout > 0 else 30) as answer:
            mime = (answer.headers.get("Content-Type") or "").split(";")[0].strip().lower()
            return {"url": url, "status": answer.status, "content_type": mime or None, "body": answer.read(MAX_BODY), "error": None}
    except (urllib.error.URLError, OSError, ValueError) as failed:
        return {"url": url, "status": getattr(failed, "code", None), "content_type": None, "body": None, "error": str(failed)}


def fetch(urls: DataFrame, timeout: float = 10) -> DataFrame:
    """(line, url, status, content_type, body, error) of every (line, url), fetched where its partition runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([get(u, timeout) for u in batch["url"]], columns=["url", "status", "content_type", "body", "error"])
            rows.insert(0, "line", batch["line"].to_numpy())
            yield rows.astype({"status": "Int32"})

    return urls.select("line", "url").mapInPandas(run, SCHEMA)
