"""Source configurations: YAML files, one per source, the file's stem being the id."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import yaml
from pyspark.sql import DataFrame, SparkSession

from docquarry.functions.ids import SOURCE_ID
from docquarry.sources.htmltree import Selector

# Limits and defaults.
MOST_RATE, RATE, TIMEOUT, PAGE_BYTES = 4.0, 2.0, 30, 250 * 1024 * 1024
ASSET_BYTES, ASSETS_BYTES = 10 * 1024 * 1024, 250 * 1024 * 1024
DEPTH, PAGES = 4, 5000
SCHEMA_VERSION = 1
CATEGORY = "Uncategorized"
MAN_SECTIONS = range(1, 9)
NETWORK_TYPES = frozenset(["readthedocs", "rustdoc", "mdbook", "generic"])
STRATEGIES = frozenset(["manual", "on_launch", "scheduled", "watch"])
SCHEDULES = frozenset(["daily", "weekly", "monthly"])

# The sections of a file, their keys and the kinds of value.
NUMBER = (int, float)
SECTIONS: dict[str, dict[str, type | tuple | str]] = {
    "": {"schema_version": int, "name": str, "source": dict, "fetch": dict, "version": str, "category": str, "display": dict, "attribution": dict, "sync": dict, "enrich": dict},
    "source": {"type": str, "url": str, "path": str, "generic": dict, "man": dict},
    "source.generic": {"entry_points": list, "max_depth": int, "max_pages": int, "include_patterns": list, "exclude_patterns": list, "content_selector": str, "title_selector": str, "nav_selector": str},
    "source.man": {"paths": list, "sections": list},
    "fetch": {"respect_robots": bool, "rate_limit_rps": NUMBER, "timeout_seconds": int, "allow_insecure": bool, "max_asset_bytes": int},
    "display": {"icon": str, "accent_color": str},
    "attribution": {"homepage": str, "licence": str},
    "sync": {"strategy": str, "schedule": str, "watch_source": str, "pin_version": bool},
    "enrich": {"link_to_source": bool, "tldr_summaries": bool},
}
#: Members of the source section that a type has; the first one is required.
MEMBERS = {"readthedocs": ["url"], "rustdoc": ["url"], "mdbook": ["url"], "generic": ["url", "generic"], "man": ["man"], "local": ["path"], "docset": ["path"]}


class ConfigError(ValueError):
    """A configuration that can't be used, with the reason."""


@dataclass(frozen=True)
class Fetch:
    rate: float = RATE
    timeout: float = TIMEOUT
    max_page_bytes: int = PAGE_BYTES
    max_asset_bytes: int = ASSETS_BYTES
    respect_robots: bool = True
    allow_insecure: bool = False


@dataclass(frozen=True)
class Sync:
    strategy: str = "manual"
    schedule: str | None = None
    watch_source: str | None = None
    pin_version: bool = False


@dataclass(frozen=True)
class Source:
    id: str
    name: str
    type: str
    category: str = CATEGORY
    url: str | None = None
    path: str | None = None
    version: str | None = None
    entry_points: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_depth: int = DEPTH
    max_pages: int = PAGES
    content_selector: str | None = None
    title_selector: str | None = None
    nav_selector: str | None = None
    man_paths: tuple[str, ...] = ()
    man_sections: tuple[int, ...] = ()
    icon: tuple[str, str] | None = None
    accent_color: str | None = None
    homepage: str | None = None
    licence: str | None = None
    fetch: Fetch = field(default_factory=Fetch)
    sync: Sync = field(default_factory=Sync)


def _section(raw: dict, name: str) -> dict:
    """The members of a section that have a value, of known names and kinds."""
    keys = SECTIONS[name]
    for k, v in raw.items():
        if k not in keys:
            raise ConfigError(f"unknown key in {name or 'the file'}: {k}")
        if v is not None and (not isinstance(v, keys[k]) or (isinstance(v, bool) and keys[k] is not bool)):
            raise ConfigError(f"{name}.{k} has a value of the wrong kind".lstrip("."))
    return {k: v for k, v in raw.items() if v is not None}


def _absolute(text: str, where: str) -> str:
    p = urlsplit(text)
    if not p.scheme or not p.hostname:
        raise ConfigError(f"{where} is no absolute url")
    return text


def _generic(raw: dict) -> dict:
    g = _section(raw, "source.generic")
    out: dict = {"entry_points": tuple(map(str, g.get("entry_points", ())))}
    for member, key in (("include", "include_patterns"), ("exclude", "exclude_patterns")):
        out[member] = tuple(map(str, g.get(key, ())))
        for p in out[member]:
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"source.generic.{key} has a bad pattern {p}: {e}") from e
    for key in ("content_selector", "title_selector", "nav_selector"):
        out[key] = g.get(key)
        if key in g:
            try:
                Selector(g[key])
            except ValueError as e:
                raise ConfigError(f"source.generic.{key}: {e}") from e
    for key, default in (("max_depth", DEPTH), ("max_pages", PAGES)):
        out[key] = g.get(key, default)
        if out[key] < 1:
            raise ConfigError(f"source.generic.{key} is at least 1")
    return out


def _man(raw: dict) -> dict:
    m = _section(raw, "source.man")
    sections = tuple(m.get("sections", MAN_SECTIONS))
    if not m.get("paths"):
        raise ConfigError("source.man.paths names at least one folder")
    if any(x not in MAN_SECTIONS for x in sections):
        raise ConfigError("source.man.sections are 1 to 8")
    return {"man_paths": tuple(map(str, m["paths"])), "man_sections": sections}


def _spec(raw: dict, fetch: Fetch) -> dict:
    """What the source section says."""
    spec, kind = _section(raw, "source"), raw.get("type")
    if kind not in MEMBERS:
        raise ConfigError(f"unknown type: {kind}")
    odd = sorted(set(spec) - {"type", *MEMBERS[kind]})
    if odd:
        raise ConfigError(f"source.{odd[0]} doesn't apply to the type {kind}")
    if MEMBERS[kind][0] not in spec:
        raise ConfigError(f"a {kind} source needs source.{MEMBERS[kind][0]}")
    if kind == "man":
        return _man(spec["man"])
    if kind not in NETWORK_TYPES:
        return {"path": spec["path"]}
    scheme = urlsplit(_absolute(spec["url"], "source.url")).scheme.lower()
    if scheme not in ("https", "http") or (scheme == "http" and not fetch.allow_insecure):
        raise ConfigError("source.url is https, or http with fetch.allow_insecure")
    return {"url": spec["url"]} | (_generic(spec.get("generic", {})) if kind == "generic" else {})


def _fetch(raw: dict) -> Fetch:
    f = _section(raw, "fetch")
    rate, timeout = f.get("rate_limit_rps", RATE), f.get("timeout_seconds", TIMEOUT)
    if not 0 < rate < float("inf"):
        raise ConfigError("fetch.rate_limit_rps is above 0 and finite")
    if timeout < 1:
        raise ConfigError("fetch.timeout_seconds is at least 1")
    return Fetch(min(rate, MOST_RATE), timeout, max_asset_bytes=f.get("max_asset_bytes", ASSETS_BYTES), respect_robots=f.get("respect_robots", True), allow_insecure=f.get("allow_insecure", False))


def _sync(raw: dict) -> Sync:
    s = Sync(**_section(raw, "sync"))
    if s.strategy not in STRATEGIES:
        raise ConfigError(f"unknown strategy: {s.strategy}")
    for member, strategy in (("schedule", "scheduled"), ("watch_source", "watch")):
        if (getattr(s, member) is not None) != (s.strategy == strategy):
            raise ConfigError(f"sync.{member} belongs to the strategy {strategy}, and that needs it")
    if s.schedule is not None and s.schedule not in SCHEDULES:
        raise ConfigError(f"unknown schedule: {s.schedule}")
    return s


def icon_of(text: str) -> tuple[str, str]:
    """remote for a URL, file for a path, else emoji."""
    return ("remote" if text.startswith(("http://", "https://")) else "file" if "/" in text else "emoji", text)


def parse(source_id: str, text: str) -> Source:
    """A checked configuration, or ConfigError."""
    if not re.fullmatch(SOURCE_ID, source_id):
        raise ConfigError(f"invalid id: {source_id}")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"no YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("a configuration is a mapping")
    top = _section(raw, "")
    if top.get("schema_version") != SCHEMA_VERSION:
        raise ConfigError(f"schema_version is {SCHEMA_VERSION}; a larger one is of a newer format")
    if not top.get("name", "").strip():
        raise ConfigError("a configuration needs a name")
    if "source" not in top:
        raise ConfigError("a configuration needs a source section")
    fetch = _fetch(top.get("fetch", {}))
    own = _spec(top["source"], fetch)
    shown, credit = _section(top.get("display", {}), "display"), _section(top.get("attribution", {}), "attribution")
    _section(top.get("enrich", {}), "enrich")  # read, and not used
    color = shown.get("accent_color")
    if color is not None and not re.fullmatch("#[0-9A-Fa-f]{6}", color):
        raise ConfigError("display.accent_color is #rrggbb")
    if "homepage" in credit:
        _absolute(credit["homepage"], "attribution.homepage")
    icon = icon_of(shown["icon"]) if "icon" in shown else None
    return Source(source_id, top["name"], top["source"]["type"], top.get("category", CATEGORY), version=top.get("version"), icon=icon, accent_color=color, homepage=credit.get("homepage"), licence=credit.get("licence"), fetch=fetch, sync=_sync(top.get("sync", {})), **own)


def parse_file(path: str) -> Source:
    with open(path, encoding="utf8") as f:
        return parse(os.path.basename(path).rsplit(".", 1)[0], f.read())


def scan(folder: str) -> tuple[list[Source], list[str]]:
    """The configurations of a folder by id, and a warning for each file that is none."""
    found, warnings = [], []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".yaml"):
            try:
                found.append(parse_file(os.path.join(folder, name)))
            except ConfigError as e:
                warnings.append(f"{name}: {e}")
    return found, warnings


def registry(text: str) -> list[dict]:
    """Entries of a registry index; a config path must be relative and stay inside."""
    raw = yaml.safe_load(text) or {}
    out = []
    for e in raw.get("sources") or []:
        path = str(e.get("config") or "")
        if not path or path.startswith("/") or ".." in path.split("/") or "\\" in path:
            raise ConfigError(f"bad config path: {path}")
        out.append({k: None if e.get(k) is None else str(e[k]) for k in ("id", "name", "category", "homepage", "licence", "config", "verified")})
    return out


def to_frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Configurations as a table."""
    rows = [(s.id, s.name, s.type, s.category, s.url, s.version, s.max_depth, s.max_pages, s.fetch.rate, s.sync.strategy, s.sync.schedule, s.sync.pin_version) for s in sources]
    return spark.createDataFrame(rows, "id string, name string, kind string, category string, url string, version string, max_depth int, max_pages int, rate double, strategy string, schedule string, pin_version boolean")
