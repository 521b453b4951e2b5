"""Nested JSON records to flat parent-child tables, on Arrow buffers.

A batch of JSON texts is never parsed record by record. The kernel looks at the
string column's data buffer as one byte array, finds the structural characters
of all records at once, and derives list offsets and parent indices level by
level, as Arrow's ``list_parent_indices`` / ``list_flatten`` do for typed
columns of a known depth. Record keys are then propagated with ``take``. The
depth of the nesting is not bounded by any schema.

Defined results: a null, empty, cut-off or otherwise malformed text is unreadable and
gives no rows: kinds of brackets, order of tokens, scalars, escapes and control
characters are judged on the same buffer, as a parser would;
text after the first value makes a record unreadable too; a value encoded as a
JSON string (even several times) counts as its content; absent, null and empty
child lists are alike; one object where a list is meant is a list of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.model.ast import CHILD_KEYS, read_json

_QUOTE, _BACK, _COLON, _OBJ, _ARR = 34, 92, 58, 123, 91
_LUT = np.zeros(256, np.bool_)
_LUT[[_QUOTE, _OBJ, 125, _ARR, 93, _COLON, 44]] = True
_DELTA = np.zeros(256, np.int32)
_DELTA[[_OBJ, _ARR]] = 1
_DELTA[[125, 93]] = -1
#: Bytes of JSON the kernel takes at once; a longer single record goes alone.
SLICE_BYTES = 8 << 20


@dataclass
class Flat:
    """Objects of a batch in position order: arrays of equal length."""

    row: np.ndarray
    obj_no: np.ndarray
    parent_no: np.ndarray
    key: pa.Array
    fields: dict[str, pa.Array]
    readable: np.ndarray


def _gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Slices of a byte buffer as one binary array, by offsets."""
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    at = np.arange(off[-1], dtype=np.int64) + np.repeat(start - off[:-1], length)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def _unwrap(col: pa.Array) -> pa.Array:
    """Records whose value is a JSON string, replaced by their content."""
    wrapped = pc.fill_null(pc.starts_with(pc.utf8_ltrim(col, characters=" \t\r\n﻿"), '"'), False)
    if not pc.any(wrapped).as_py():
        return col
    inner = []
    for s in col.filter(wrapped).to_pylist():
        v = read_json(s)
        inner.append(None if v is None else json.dumps(v, ensure_ascii=False))
    return pc.replace_with_mask(col, wrapped, pa.array(inner, pa.large_string()))


def _last_before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(values, at) - 1


#: Classes of tokens: braces, brackets, colon, comma, and the two ends of a string as key or value.
_O, _o, _A, _a, _C, _M, _KQ, _KE, _VQ, _VE = range(10)
_CLASS = np.zeros(256, np.int64)
_CLASS[[_OBJ, 125, _ARR, 93, _COLON, 44]] = [_O, _o, _A, _a, _C, _M]
#: Whether a token may follow another (rows: token, in an object or not), and whether with a scalar between.
_NEXT = np.zeros((2, 10, 10), np.bool_)
_SCALAR_BETWEEN = np.zeros((2, 10, 10), np.bool_)
for _c in (0, 1):
    _NEXT[_c, _O, [_KQ, _o]] = True
    _NEXT[_c, _A, [_VQ, _O, _A, _a]] = True
    _NEXT[_c, _C, [_VQ, _O, _A]] = True
    _NEXT[_c, _KQ, _KE] = _NEXT[_c, _KE, _C] = _NEXT[_c, _VQ, _VE] = True
    for _p in (_VE, _o, _a):
        _NEXT[_c, _p, [_M, _o, _a]] = True
    _SCALAR_BETWEEN[_c, _A, [_M, _a]] = _SCALAR_BETWEEN[_c, _C, [_M, _o]] = True
_NEXT[1, _M, _KQ] = True
_NEXT[0, _M, [_VQ, _O, _A]] = True
_SCALAR_BETWEEN[0, _M, [_M, _a]] = True
_SCALAR = r"^[ \t\r\n]*(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)[ \t\r\n]*$"
_BLANK = np.zeros(256, np.bool_)
_BLANK[[32, 9, 10, 13]] = True
_ESCAPES = np.zeros(256, np.bool_)
_ESCAPES[[ord(x) for x in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, np.bool_)
_HEX[[ord(x) for x in "0123456789abcdefABCDEF"]] = True


def _malformed(buf: np.ndarray, off: np.ndarray, pos: np.ndarray, ch: np.ndarray, row: np.ndarray, depth: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Rows whose tokens, of balanced depth, are no JSON. ``escapes`` are the backslashes that escape."""
    n, bad = len(pos), []
    if not n:
        return np.zeros(0, np.int64)
    delta = _DELTA[ch]
    # the opener around each comma and of each closer: the last one of its depth
    level = depth + (delta < 0)
    marks = np.flatnonzero((delta != 0) | (ch == 44))
    order = marks[np.argsort(level[marks].astype(np.int16) if level.max() < 32_767 else level[marks], kind="stable")]
    held = np.maximum.accumulate(np.where(delta[order] == 1, np.arange(len(order)), 0))
    around = np.zeros(n, np.int64)
    around[order] = order[held]
    closers = np.flatnonzero(delta < 0)
    bad.append(row[closers[ch[closers] != ch[around[closers]] + 2]])
    in_object = np.zeros(n, np.int64)
    in_object[marks] = ch[around[marks]] == _OBJ
    # strings: a key stands after a brace or an object's comma
    kind = _CLASS[ch]
    quote = np.flatnonzero(ch == _QUOTE)
    ends = quote.reshape(-1, 2)  # each row has an even number
    before = np.maximum(ends[:, 0] - 1, 0)
    is_key = (ch[before] == _OBJ) | ((ch[before] == 44) & (in_object[before] == 1))
    kind[ends[:, 0]] = np.where(is_key, _KQ, _VQ)
    kind[ends[:, 1]] = np.where(is_key, _KE, _VE)
    # what stands between neighbours
    solid = np.concatenate([[0], np.cumsum(~_BLANK[buf], dtype=np.int64 if len(buf) > 2**31 - 2 else np.int32)])
    same = row[1:] == row[:-1]
    gap = (solid[pos[1:]] - solid[pos[:-1] + 1] > 0) & ~((kind[:-1] == _KQ) | (kind[:-1] == _VQ))
    fits = np.where(gap, _SCALAR_BETWEEN[in_object[:-1], kind[:-1], kind[1:]], _NEXT[in_object[:-1], kind[:-1], kind[1:]])
    bad.append(row[:-1][same & ~fits])
    at = np.flatnonzero(same & gap & fits)
    literal = _gather(buf, pos[at] + 1, pos[at + 1] - pos[at] - 1)
    coded = literal.dictionary_encode()
    good = np.array([re.match(_SCALAR, x.decode("utf8", "replace")) is not None for x in coded.dictionary.to_pylist()] + [False], np.bool_)
    bad.append(row[at[~good[np.asarray(coded.indices)]]] if len(at) else at)
    # before the first token and after the last
    head, tail = np.flatnonzero(np.concatenate([[True], ~same])), np.flatnonzero(np.concatenate([~same, [True]]))
    r = row[head]
    bad.append(r[(solid[pos[head]] > solid[off[r]]) | (delta[head] != 1) | (solid[off[r + 1]] > solid[pos[tail] + 1]) | (delta[tail] != -1)])
    # inside strings
    if len(escapes):
        nxt = buf[np.minimum(escapes + 1, len(buf) - 1)]
        wrong = ~_ESCAPES[nxt]
        wide = np.flatnonzero(nxt == ord("u"))
        for i in range(2, 6):
            wrong[wide] |= ~_HEX[buf[np.minimum(escapes[wide] + i, len(buf) - 1)]]
        bad.append(np.searchsorted(off, escapes[wrong], "right") - 1)
    control = np.flatnonzero(buf < 32)
    if len(control):
        bad.append(row[ends[:, 0]][np.searchsorted(control, pos[ends[:, 0]]) != np.searchsorted(control, pos[ends[:, 1]])])
    return np.unique(np.concatenate(bad))


def flatten_batch(col: pa.Array, order: Sequence[str] = CHILD_KEYS, fields: Sequence[str] = ()) -> Flat:
    """All JSON objects of a string column, numbered within their record.

    ``order`` ranks the keys that hold objects: siblings are numbered by that
    rank, then by position; keys not named come last. ``fields`` are scalar
    members returned per object as strings (null if absent, null or nested).
    """
    col = _unwrap(col.cast(pa.large_string()))
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    raw = col.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]

    pos = np.flatnonzero(_LUT[buf])
    back = np.flatnonzero(buf == _BACK)
    escapes = back
    if len(back):
        starts = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        run = back - back[starts][np.cumsum(np.isin(np.arange(len(back)), starts)) - 1] + 1
        escapes = back[run % 2 == 1]
        quoted = np.zeros(len(buf) + 1, np.bool_)
        odd = back[run % 2 == 1] + 1
        quoted[odd] = True
        pos = pos[~(quoted[pos] & (buf[pos] == _QUOTE))]
    ch = buf[pos]
    row = np.searchsorted(off, pos, "right") - 1
    first = np.searchsorted(pos, off)

    def per_row(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums within each row, and the rows' totals."""
        c = np.concatenate([[0], np.cumsum(x)])
        return c[1:] - c[first[row]], c[first[1:]] - c[first[:-1]]

    is_q = ch == _QUOTE
    quotes, quote_sum = per_row(is_q)
    readable = quote_sum % 2 == 0
    keep = is_q | (quotes % 2 == 0)
    pos, ch, row = pos[keep], ch[keep], row[keep]
    first = np.searchsorted(pos, off)
    depth, last_depth = per_row(_DELTA[ch])
    readable &= last_depth == 0
    readable[row[depth < 0]] = False
    top = (_DELTA[ch] == 1) & (depth == 1)
    tops = np.bincount(row[top], minlength=n)
    readable &= tops <= 1
    lone = tops == 0  # no container: only a scalar can be a readable value
    if lone.any():
        readable[np.flatnonzero(lone)] = [read_json(s) is not None for s in col.filter(pa.array(lone)).to_pylist()]
    if col.null_count:
        readable &= ~np.asarray(col.is_null())

    ok = readable[row]
    pos, ch, row, depth = pos[ok], ch[ok], row[ok], depth[ok]
    odd = _malformed(buf, off, pos, ch, row, depth, escapes)
    if len(odd):
        readable[odd[~lone[odd]]] = False
        ok = readable[row]
        pos, ch, row, depth = pos[ok], ch[ok], row[ok], depth[ok]
    opener = np.flatnonzero(_DELTA[ch] == 1)
    o_depth, o_pos, o_row, is_obj = depth[opener], pos[opener], row[opener], ch[opener] == _OBJ
    total = len(opener)
    parent = np.full(total, -1, np.int64)
    holder = np.full(total, -1, np.int64)  # nearest enclosing object
    by_depth = np.argsort(o_depth, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(o_depth))]) if total else np.zeros(2, np.int64)
    levels = [by_depth[bounds[d] : bounds[d + 1]] for d in range(1, len(bounds) - 1)]
    # The key of a container stands right before it; items of a list inherit the list's.
    t = opener
    has_key = np.zeros(total, np.bool_)
    far = t >= 3
    has_key[far] = ch[t[far] - 1] == _COLON
    k_at = np.where(has_key, t - 3, 0)
    key_bytes = _gather(buf, np.where(has_key, pos[k_at] + 1, 0), np.where(has_key, pos[np.minimum(k_at + 1, max(len(pos) - 1, 0))] - pos[k_at] - 1, 0)) if total else pa.array([], pa.large_binary())
    coded = key_bytes.dictionary_encode() if total else None
    key = np.where(has_key, np.asarray(coded.indices, dtype=np.int64), -1) if total else np.zeros(0, np.int64)
    for prev, cur in zip(levels, levels[1:]):
        up = prev[_last_before(o_pos[prev], o_pos[cur])]
        parent[cur] = up
        holder[cur] = np.where(is_obj[up], up, holder[up])
        key[cur] = np.where(is_obj[up], key[cur], key[up])

    obj = np.flatnonzero(is_obj)
    m = len(obj)
    dense = np.full(total + 1, -1, np.int64)
    dense[obj] = np.arange(m)
    p = dense[holder[obj]]
    r = o_row[obj]
    names = [b.decode("utf8", "replace") for b in coded.dictionary.to_pylist()] if total else []
    rank_of = {name: i for i, name in enumerate(order)}
    ranks = np.array([rank_of.get(x, len(order)) for x in names] + [0], np.int64)
    rank = ranks[key[obj]]
    group = np.where(p >= 0, p, -1 - r)
    start = np.searchsorted(r, np.arange(n))
    at_row = np.arange(m) - start[r] if m else np.zeros(0, np.int64)
    calm = np.argsort(group, kind="stable")
    g, k = group[calm], rank[calm]
    if m and np.any((g[1:] == g[:-1]) & (k[1:] < k[:-1])):
        size = np.ones(m, np.int64)
        level = np.zeros(m, np.int64)
        obj_levels = []
        for lv in levels:
            cur = dense[lv]
            cur = cur[cur >= 0]
            if len(cur):
                obj_levels.append(cur)
        for cur in reversed(obj_levels):
            up = p[cur]
            np.add.at(size, up[up >= 0], size[cur][up >= 0])
        srt = np.lexsort((np.arange(m), rank, group))
        gs, sz = group[srt], size[srt]
        run = np.cumsum(sz) - sz
        head = np.concatenate([[True], gs[1:] != gs[:-1]])
        base = run[np.flatnonzero(head)][np.cumsum(head) - 1]
        offset = np.empty(m, np.int64)
        offset[srt] = run - base
        obj_no = np.empty(m, np.int64)
        for cur in obj_levels:
            up = p[cur]
            obj_no[cur] = np.where(up >= 0, obj_no[up] + 1, 0) + offset[cur]
        del level
    else:
        obj_no = at_row
    parent_no = np.where(p >= 0, obj_no[p], -1) if m else np.zeros(0, np.int64)
    names_arr = pa.array(names + [None], pa.string())
    key_out = names_arr.take(pa.array(np.where(key[obj] >= 0, key[obj], len(names)))) if m else pa.array([], pa.string())
    out = Flat(r.astype(np.int64), obj_no.astype(np.int32), parent_no.astype(np.int32), key_out, {}, readable)
    if fields:
        out.fields = _members(buf, pos, ch, depth, levels, o_pos, dense, m, fields)
    return out


def _members(buf, pos, ch, depth, levels, o_pos, dense, m, fields) -> dict[str, pa.Array]:
    """Scalar members of the objects, by the name's bytes."""
    empty = {f: pa.nulls(m, pa.string()) for f in fields}
    colon = np.flatnonzero(ch == _COLON)
    colon = colon[colon >= 2]
    if not len(colon) or not m:
        return empty
    names = _gather(buf, pos[colon - 2] + 1, pos[colon - 1] - pos[colon - 2] - 1)
    want = np.asarray(pc.fill_null(pc.index_in(names, pa.array([f.encode() for f in fields], pa.large_binary())), -1))
    nxt = np.minimum(colon + 1, len(ch) - 1)
    scalar = (want >= 0) & (_DELTA[ch[nxt]] != 1)
    colon, want, nxt = colon[scalar], want[scalar], nxt[scalar]
    owner = np.full(len(colon), -1, np.int64)
    d = depth[colon]
    for i, lv in enumerate(levels):
        here = np.flatnonzero(d == i + 1)
        if len(here):
            owner[here] = dense[lv[_last_before(o_pos[lv], pos[colon[here]])]]
    is_str = ch[nxt] == _QUOTE
    s_from = np.where(is_str, pos[nxt], pos[colon] + 1)
    s_to = np.where(is_str, pos[np.minimum(nxt + 1, len(pos) - 1)] + 1, pos[nxt])
    res = {}
    for i, f in enumerate(fields):
        mine = np.flatnonzero((want == i) & (owner >= 0))
        lit = _gather(buf, s_from[mine], s_to[mine] - s_from[mine]).cast(pa.large_string())
        raw_escape = np.asarray(pc.match_substring(lit, "\\"), dtype=bool)
        plain = pc.utf8_trim(lit, characters=" \t\r\n")
        quoted = is_str[mine]
        text = pc.if_else(pa.array(quoted), pc.utf8_slice_codeunits(plain, 1, -1), plain)
        hard = quoted & raw_escape
        if hard.any():  # one call decodes the escapes of the whole batch
            text = pc.replace_with_mask(text, pa.array(hard), pa.array(json.loads("[" + ",".join(lit.filter(pa.array(hard)).to_pylist()) + "]", strict=False), pa.large_string()))
        text = pc.if_else(pa.array(~quoted & np.asarray(pc.equal(plain, "null"), dtype=bool)), None, text)
        at = np.full(m, -1, np.int64)
        at[owner[mine]] = np.arange(len(mine))
        res[f] = text.take(pa.array(at, mask=at < 0)).cast(pa.string())
    return res


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about SLICE_BYTES."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cell = np.cumsum(size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flatten_json(df: DataFrame, json_col: str, keys: dict[str, str], order: Sequence[str] = CHILD_KEYS, fields: Sequence[str] = (), with_key: bool = False) -> DataFrame:
    """One row per JSON object of ``df[json_col]``.

    Output: the ``keys`` columns (name -> SQL type) of the record, ``obj_no``
    (0-based, each object before those inside it), ``parent_no`` (-1 at the top),
    ``member`` (the key under which the object lies) if ``with_key``, and
    ``fields`` as strings. Columns of ``df`` not named are not read. Narrow: no
    shuffle, one pass over the scan.
    """
    names = list(keys)
    schema = ", ".join([f"`{k}` {v}" for k, v in keys.items()] + ["obj_no int", "parent_no int"] + ["member string"] * with_key + [f"`{f}` string" for f in fields])
    wanted, ranks, members = tuple(fields), tuple(order), with_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "__json"):
                flat = flatten_batch(batch.column("__json"), ranks, wanted)
                take = pa.array(flat.row)
                cols = [batch.column(k).take(take) for k in names]
                heads = [*names, "obj_no", "parent_no"]
                cols += [pa.array(flat.obj_no), pa.array(flat.parent_no)]
                if members:
                    heads.append("member")
                    cols.append(flat.key)
                heads += wanted
                cols += [flat.fields[f] for f in wanted]
                yield pa.RecordBatch.from_arrays(cols, heads)

    return df.select(*[F.col(f"`{k}`").cast(v) for k, v in keys.items()], F.col(f"`{json_col}`").alias("__json")).mapInArrow(run, schema)


#: Scalar members of the tree's nodes, and of table-of-contents entries.
NODE_FIELDS = ("type", "level", "id", "value", "code", "language", "alt", "src", "href", "title", "kind", "ordered", "start")
TOC_FIELDS = ("title", "path", "fragment")
