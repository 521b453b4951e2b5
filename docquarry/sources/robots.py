"""robots.txt: parsing, matching, and what an unavailable one means."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
AGENT = "docquarry"
MOST_BYTES = 500 * 1024
MOST_DELAY = 60.0


@dataclass(frozen=True)
class Robots:
    """The rules (allow, pattern) that hold for us, and the crawl delay."""

    rules: tuple[tuple[bool, str], ...] = ()
    delay: float | None = None

    def allows(self, path: str) -> bool:
        """The longest matching rule wins, allow before disallow; none: allowed."""
        if path == "/robots.txt":
            return True
        fits = [(len(p), allow) for allow, p in self.rules if pattern(p).match(path)]
        return max(fits)[1] if fits else True


NOTHING = Robots(((False, "/"),))
EVERYTHING = Robots()


def pattern(rule: str) -> re.Pattern:
    """``*`` is any run, a final ``$`` the end, everything else itself from the start on."""
    end = rule.endswith("$")
    return re.compile(".*".join(map(re.escape, rule.removesuffix("$").split("*"))) + (r"\Z" if end else ""), re.S)


def parse(text: str, agent: str = AGENT) -> Robots:
    """Rules of the group with the longest agent name that is ours, else of ``*``."""
    text = text.encode()[:MOST_BYTES].decode(errors="ignore")
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    naming = False
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not naming:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
        elif groups and name in ("allow", "disallow") and value:
            groups[-1][1].append((name == "allow", value))
        elif groups and name == "crawl-delay" and re.fullmatch(r"\d+(\.\d*)?|\.\d+", value):
            groups[-1][2].append(min(float(value), MOST_DELAY))
        naming = name == "user-agent"
    best, best_fit = None, -1
    for g in groups:
        for a in g[0]:
            fit = 0 if a == "*" else len(a) if a and (a in agent or agent in a) else -1
            if fit > best_fit:
                best, best_fit = g, fit
    return EVERYTHING if best is None else Robots(tuple(best[1]), best[2][-1] if best[2] else None)


def of_response(status: int | None, text: str | None, agent: str = AGENT) -> Robots:
    """2xx is parsed, 4xx allows all, anything else (5xx, no answer) disallows all.
    Redirects are to be followed before."""
    if status is not None and 200 <= status < 300:
        return parse(text or "", agent)
    return EVERYTHING if status is not None and 400 <= status < 500 else NOTHING


def verdicts(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, path, allowed) for ``urls`` (host, path) under ``robots`` (host, status, text).

    Rules are parsed once per host; paths meet them by host in an equi-join. A host
    without a robots row is unavailable, so disallowed. Null paths count as ``/``.
    """
    met = urls.select("host", F.coalesce("path", F.lit("/")).alias("path")).join(robots.select("host", "status", "text", F.lit(True).alias("known")), "host", "left").sortWithinPartitions("host").select("host", "path", "status", "text", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rules = None, NOTHING
        for b in batches:
            out = []
            for host, path, status, text, known in zip(*(c.to_pylist() for c in b.columns)):
                if last != (host, status, text):
                    last, rules = (host, status, text), of_response(status, text, agent) if known else NOTHING
                out.append(rules.allows(path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["host", "path", "allowed"])

    return met.mapInArrow(run, "host string, path string, allowed boolean")
