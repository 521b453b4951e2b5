"""Fetching pages: retries, rate limits, body caps, address policy.

``fetch_pages`` puts all URLs of a host into one partition, so the host's rate holds
without talk between tasks. The transport is a plain function, so everything is
tested without a network; the default one uses urllib and follows redirects itself
to judge every hop.
"""

from __future__ import annotations

import random
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.urls import host
from docquarry.sources.addresses import allowed
from docquarry.sources.config import MOST_RATE, PAGE_BYTES, RATE
from docquarry.sources.robots import AGENT, Robots, of_response

# Fixed values.
ATTEMPTS, REDIRECTS = 4, 5
FIRST_WAIT, MOST_RETRY_AFTER = 0.5, 300.0


@dataclass(frozen=True)
class Response:
    """status None: no answer."""

    status: int | None
    headers: dict[str, str]
    body: bytes
    error: str | None = None


Transport = Callable[[str, dict[str, str], float, int], Response]


def wait_before(attempt: int, response: Response) -> float | None:
    """Seconds to wait before the next attempt (``attempt`` counts from 0); None: final.

    No answer and 5xx are tried again after 0.5, 1, 2 s; 429 and 503 wait for their
    Retry-After (at most 300 s) if that is longer; other 4xx never are."""
    s = response.status
    if attempt >= ATTEMPTS - 1 or not (s is None or s >= 500 or s == 429):
        return None
    pause = FIRST_WAIT * 2**attempt
    after = response.headers.get("retry-after", "")
    return max(pause, min(float(after), MOST_RETRY_AFTER)) if s in (429, 503) and after.isdigit() else pause


def gap(rate: float, delay: float | None) -> float:
    """Seconds between two requests to a host."""
    return max(1 / min(max(rate, 1e-6), MOST_RATE), delay or 0.0)


def resolve_allowed(url: str, allow_private: bool) -> bool:
    """Every address of the URL's host may be fetched from."""
    p = urlsplit(url)
    if p.scheme not in ("http", "https") or not p.hostname:
        return False
    try:
        found = {x[4][0] for x in socket.getaddrinfo(p.hostname, p.port or 443, type=socket.SOCK_STREAM)}
    except OSError:
        return False
    return bool(found) and all(allowed(a, allow_private) for a in found)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):  # noqa: ARG002
        return None


def urllib_transport(url: str, headers: dict[str, str], timeout: float, most: int, allow_private: bool = False) -> Response:
    """One request with up to five redirects, each hop's address judged first."""
    opener = urllib.request.build_opener(_Stay)
    for _ in range(REDIRECTS + 1):
        if not resolve_allowed(url, allow_private):
            return Response(None, {}, b"", "address not allowed")
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": AGENT, **headers}), timeout=timeout) as r:
                return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most + 1))
        except urllib.error.HTTPError as e:
            got = {k.lower(): v for k, v in e.headers.items()}
            if e.code in (301, 302, 303, 307, 308) and "location" in got:
                url = urljoin(url, got["location"])
                continue
            return Response(e.code, got, b"")
        except OSError as e:
            return Response(None, {}, b"", str(e))
    return Response(None, {}, b"", "too many redirects")


def fetch(url: str, transport: Transport = urllib_transport, etag: str | None = None, modified: str | None = None, timeout: float = 30.0, most: int = PAGE_BYTES, sleep: Callable[[float], None] = time.sleep) -> Response:
    """The final answer after retries. A body above ``most`` bytes is an error, never cut;
    304 means that what is held is still current."""
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    for attempt in range(ATTEMPTS):
        r = transport(url, headers, timeout, most)
        pause = wait_before(attempt, r)
        if pause is None:
            break
        sleep(pause * random.uniform(1.0, 1.1))
    return Response(r.status, r.headers, b"", f"body above {most} bytes") if len(r.body) > most else r


_SHAPE = "url string, status int, content_type string, etag string, last_modified string, body binary, error string"


def fetch_pages(urls: DataFrame, url: str = "url", rate: float = RATE, timeout: float = 30.0, most: int = PAGE_BYTES, respect_robots: bool = True, transport: Transport = urllib_transport, etag: str | None = None, modified: str | None = None) -> DataFrame:
    """A row per distinct URL: status, content type, validators, body, error. One task per
    group of hosts; robots.txt is asked once per host and task."""
    cols = [F.col(url).alias("url"), (F.col(etag) if etag else F.lit(None).cast("string")).alias("etag"), (F.col(modified) if modified else F.lit(None).cast("string")).alias("modified"), host(url).alias("host")]
    todo = urls.select(*cols).where("url is not null").dropDuplicates(["url"]).repartition("host").sortWithinPartitions("host", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, Robots] = {}
        next_at: dict[str, float] = {}
        for b in batches:
            rows = []
            for u, tag, since, h in zip(*(c.to_pylist() for c in b.columns)):
                p = urlsplit(u)
                if respect_robots and h not in rules:
                    r = fetch(f"{p.scheme}://{p.netloc}/robots.txt", transport, timeout=timeout, most=1 << 20)
                    rules[h] = of_response(r.status, r.body.decode("utf8", "replace"))
                if respect_robots and not rules[h].allows(p.path or "/"):
                    rows.append((u, None, None, None, None, None, "disallowed by robots.txt"))
                    continue
                pause = next_at.get(h, 0.0) - time.monotonic()
                if pause > 0:
                    time.sleep(pause)
                next_at[h] = time.monotonic() + gap(rate, rules[h].delay if h in rules else None)
                r = fetch(u, transport, tag, since, timeout, most)
                rows.append((u, r.status, r.headers.get("content-type"), r.headers.get("etag"), r.headers.get("last-modified"), r.body or None, r.error))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _SHAPE.split(", ")])

    return todo.mapInArrow(run, _SHAPE)


def usable(fetched: DataFrame) -> DataFrame:
    """Answers that are pages: status 200 and, if a type is named, an html one."""
    return fetched.where((F.col("status") == 200) & F.col("error").isNull() & (F.col("content_type").isNull() | F.lower("content_type").contains("html")))


def failures(fetched: DataFrame) -> DataFrame:
    """The error side of a fetch: url, status, error."""
    return fetched.where(F.col("error").isNotNull() | F.col("status").isNull() | ((F.col("status") != 200) & (F.col("status") != 304))).select("url", "status", "error")
