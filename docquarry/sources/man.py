"""Manual pages: finding, rendering, cross references."""

from __future__ import annotations

import gzip
import os
import re
import subprocess
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_FOLDER = re.compile(r"man([1-9])[a-z]*")
_FILE = re.compile(r"(?P<name>.+)\.(?P<section>[1-9])(?P<suffix>[a-z]*)(?:\.gz)?")
_XREF = re.compile(r'<a class="Xr">([^<()]+)\((\d)[a-z]*\)</a>')


def discover(folders: Iterable[str], sections: Iterable[int] = ()) -> list[tuple[int, str, str]]:
    """(section, name, file) of the pages below ``folders``, sorted, the first of doubles.

    Pages lie in folders ``manN`` and end in ``.N`` or ``.N.gz``."""
    wanted, found = set(sections), {}
    for folder in folders:
        for sub in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
            m = _FOLDER.fullmatch(sub)
            if not m or (wanted and int(m[1]) not in wanted):
                continue
            for f in sorted(os.listdir(os.path.join(folder, sub))):
                n = _FILE.fullmatch(f)
                if n and n["section"] == m[1]:
                    found.setdefault((int(m[1]), n["name"]), os.path.join(folder, sub, f))
    return [(s, n, p) for (s, n), p in sorted(found.items())]


def mandoc(source: bytes) -> str:
    """Html of a page by the mandoc program; no output is an error."""
    done = subprocess.run(["mandoc", "-T", "html", "-O", "fragment"], input=source, capture_output=True, timeout=60, check=False)
    if not done.stdout.strip():
        raise ValueError(done.stderr.decode("utf8", "replace")[:200] or "no output")
    return done.stdout.decode("utf8", "replace")


def link_references(html: str, known: set[tuple[str, int]]) -> str:
    """References ``name(section)`` get a link if that page is known."""

    def link(m: re.Match) -> str:
        name, section = m[1].strip(), int(m[2])
        return m[0].replace('class="Xr"', f'class="Xr" href="{name}.{section}.html"') if (name, section) in known else m[0]

    return _XREF.sub(link, html)


def pages(spark: SparkSession, folders: Iterable[str], sections: Iterable[int] = (), render: Callable[[bytes], str] = mandoc) -> DataFrame:
    """(path, section, name, html, error) of all pages, rendered in parallel. A page that
    can't be rendered has an error and counts as an ambiguous failure."""
    found = discover(folders, sections)
    known = {(n, s) for s, n, _ in found}
    files = spark.createDataFrame(found, "section int, name string, file string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            html, errors = [], []
            for f in b.column("file").to_pylist():
                try:
                    with open(f, "rb") as h:
                        raw = h.read()
                    html.append(link_references(render(gzip.decompress(raw) if f.endswith(".gz") else raw), known))
                    errors.append(None)
                except (OSError, ValueError, EOFError, subprocess.SubprocessError) as e:
                    html.append(None)
                    errors.append(str(e) or type(e).__name__)
            path = [f"{n}.{s}.html" for n, s in zip(b.column("name").to_pylist(), b.column("section").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(path), b.column("section"), b.column("name"), pa.array(html, pa.string()), pa.array(errors, pa.string())], ["path", "section", "name", "html", "error"])

    return files.repartition(8).mapInArrow(run, "path string, section int, name string, html string, error string")
