"""HTML extraction by wrapper inference: union-free regular expressions from aligned pages of one host.

A page is a list of items: [name, count, children] for an element and ["#", count, texts] for a text, where the
count is "" (once), "?" (optional), "+" (repeated) or "*" (both). A group without a name of its own, ["", count, items],
holds a repeated run of several items. A wrapper is such a list too, with a slot for each text.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, sent_whole_if_small

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'\s>]+)""", re.I)
BLANKS = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that a start tag of the same set ends, if it is open in the same container.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BOXES = frozenset("html body div section article main nav aside header footer ul ol dl table tbody thead td th form".split())


def any_depth(f):
    """Lets f recurse as deep as a page goes: calls between Python functions take no stack of the process."""

    @wraps(f)
    def run(*args, **named):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 50_000_000))
        try:
            return f(*args, **named)
        finally:
            sys.setrecursionlimit(before)

    return run


@any_depth
def parse(page: str) -> list:
    """The items of a page, folded. Comments, scripts, styles and declarations go."""
    root: list = ["", "", []]
    stack = [(root, "")]

    def add_text(value: str) -> None:
        value = BLANKS.sub(" ", entities.unescape(value)).strip()
        if value:
            inside = stack[-1][0][2]
            if inside and inside[-1][0] == "#":
                inside[-1][2][-1] += " " + value
            else:
                inside.append(["#", "", [value]])

    for m in TOKEN.finditer(page):
        name = m[3]
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                add_text(m[0])
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == name:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k][1] in BOXES:
                break
        kind = CLASS.search(m[4]) if m[4] else None
        item = [f"{name}.{kind[1]}" if kind else name, "", []]
        stack[-1][0][2].append(item)
        if name not in VOID and not m[4].endswith("/"):
            stack.append((item, name))
    return fold(root[2])


def key(item: list):
    """What items that may be merged have in common: their name, or for a group its first and last item."""
    return item[0] or ("", key(item[2][0]), key(item[2][-1]))


def many(a: str, b: str, repeated: bool = False, optional: bool = False) -> str:
    """The count that allows what both do."""
    o = optional or a in ("?", "*") or b in ("?", "*")
    r = repeated or a in ("+", "*") or b in ("+", "*")
    return ("*" if r else "?") if o else ("+" if r else "")


def merge(a: list, b: list, repeated: bool = False) -> list:
    inside = a[2] + b[2] if a[0] == "#" else align(a[2], b[2])
    return [a[0], many(a[1], b[1], repeated), inside]


def _skipped(item: list) -> list:
    return [item[0], many(item[1], "", optional=True), item[2]]


def _group(units: list[list]) -> list:
    """Units that follow each other as one repeated item."""
    one = units[0]
    for other in units[1:]:
        one = align(one, other)
    count = "+" if len(units) > 1 else ""
    return [one[0][0], many(one[0][1], "", len(units) > 1), one[0][2]] if len(one) == 1 else ["", count, one]


def _unit_at(items: list, keys: list, at: int, unit: list, loose: bool) -> int:
    """Where a run that the unit allows, with its first and last item, ends that begins at a place; -1 if none does. A loose one may have items besides, but no second first one."""
    end = at
    for u in unit:
        if loose and u is not unit[0]:
            stop = next((k for k in range(end, len(items)) if keys[k] in (key(u), keys[at])), len(items))
            end = stop if stop < len(items) and keys[stop] == key(u) else end
        matched = end < len(items) and keys[end] == key(u)
        if matched:
            end += 1
        elif u is unit[0] or u[1] not in ("?", "*"):
            return -1
    return end if matched and end - at > 1 else -1


def collapse(items: list, unit: list, loose: bool = False) -> list:
    """items with each longest run of the unit as a group, be it repeated or not."""
    keys, out, at = [key(i) for i in items], [], 0
    while at < len(items):
        units, end = [], at
        while keys[end : end + 1] == [key(unit[0])] and (stop := _unit_at(items, keys, end, unit, loose)) > 0:
            units.append(items[end:stop])
            end = stop
        if units:
            out.append(_group(units) if len(units) > 1 else ["", "", units[0]])
        else:
            out.append(items[at])
            end = at + 1
        # Groups of one unit that come to lie next to each other are one.
        if len(out) > 1 and not out[-1][0] and key(out[-2]) == key(out[-1]):
            out[-2:] = [merge(out[-2], out[-1], True)]
        at = end
    return out


def _square(keys: list) -> tuple[int, int] | None:
    """(place, period) of the first run of the least period that follows itself."""
    names: dict = {}
    code = np.array([names.setdefault(k, len(names)) for k in keys])
    if len(names) == len(code):
        return None
    for period in range(1, len(code) // 2 + 1):
        same = code[:-period] == code[period:]
        if period > 1:
            total = np.concatenate([[0], np.cumsum(same)])
            same = total[period:] - total[:-period] == period
        at = int(same.argmax()) if len(same) else 0
        if len(same) and same[at]:
            return at, period
    return None


def fold(items: list) -> list:
    """Resolves repeats: a run of items that follows itself, of whatever length, becomes one repeated group, shorter runs first, from the inside out."""
    items = [i if i[0] == "#" else [i[0], i[1], fold(i[2])] for i in items]
    while found := _square([key(i) for i in items]):
        at, period = found
        if period > 1:
            items = collapse(items, items[at : at + period])
            continue
        out: list = []
        for i in items:  # all repeats of single items at once
            if out and key(out[-1]) == key(i):
                out[-1] = merge(out[-1], i, True)
            else:
                out.append(i)
        items = out
    return items


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, by one long integer for a row of the table."""
    masks: dict = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.frombuffer((full & ~v).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)], dtype=np.int64)])


def _table(a: list, b: list) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], a[i]
        for k in range(m - 1, -1, -1):
            row[k] = below[k + 1] + 1 if own == b[k] else max(below[k], row[k + 1])
    pairs, i, k = [], 0, 0
    while i < n and k < m:
        if a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        elif best[i + 1][k] >= best[i][k + 1]:
            i += 1
        else:
            k += 1
    return pairs


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists of keys. Long lists are halved where the two sides' lengths sum to most, so memory grows with their sum."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    inner_a, inner_b = a[lo:x], b[lo:y]
    if len(inner_a) < 2 or len(inner_a) * len(inner_b) <= 4096:
        inner = _table(inner_a, inner_b) if inner_a and inner_b else []
    else:
        half = len(inner_a) // 2
        cut = int((_row(inner_a[:half], inner_b) + _row(inner_a[half:][::-1], inner_b[::-1])[::-1]).argmax())
        inner = common(inner_a[:half], inner_b[:cut]) + [(half + i, cut + k) for i, k in common(inner_a[half:], inner_b[cut:])]
    return [(i, i) for i in range(lo)] + [(lo + i, lo + k) for i, k in inner] + [(x + k, y + k) for k in range(len(a) - x)]


def _units(gap: list, first, last) -> list[list] | None:
    """The gap cut before each item of the key `first`, if each part ends with one of the key `last`."""
    if not gap or key(gap[0]) != first:
        return None
    units: list[list] = []
    for item in gap:
        if key(item) == first and (not units or key(units[-1][-1]) == last):
            units.append([])
        units[-1].append(item)
    return units if all(key(u[-1]) == last for u in units) else None


def _as_units(items: list) -> list[list]:
    return [items[0][2]] if len(items) == 1 and not items[0][0] else [items]


def _iterated(out: list, gap: list, after: list) -> tuple[list, list, list] | None:
    """Resolves a gap on one side as a repeat of what both sides have beside it: the square that ends with the item before the gap, or that begins with the one after it. (out, what is left of the gap, after), or None if it's no repeat."""
    if out:
        unit = out[-1][2] if not out[-1][0] else None
        last = key(unit[-1]) if unit else key(out[-1])
        first = key(unit[0]) if unit else key(gap[0])
        ends = [k for k, g in enumerate(gap) if key(g) == last]
        starts = [len(out) - 1] if unit else [k for k, o in enumerate(out) if key(o) == first]
        if ends and starts:
            units = _units(gap[: ends[-1] + 1], first, last)
            if units:
                at = starts[-1]
                old = out[at:]
                made = _group([*_as_units(old), *units])
                made[1] = many(made[1], old[0][1] if len(old) == 1 else "", True)
                return [*out[:at], made], gap[ends[-1] + 1 :], after
    if after:
        unit = after[0][2] if not after[0][0] else None
        first = key(unit[0]) if unit else key(after[0])
        last = key(unit[-1]) if unit else key(gap[-1])
        starts = [k for k, g in enumerate(gap) if key(g) == first]
        ends = [0] if unit else [k for k, o in enumerate(after) if key(o) == last]
        if ends and starts:
            units = _units(gap[starts[0] :], first, last)
            if units:
                old = after[: ends[0] + 1]
                made = _group([*units, *_as_units(old)])
                made[1] = many(made[1], old[0][1] if len(old) == 1 else "", True)
                return out, gap[: starts[0]], [made, *after[ends[0] + 1 :]]
    return None


def _unified(a: list, b: list) -> tuple[list, list]:
    """Both lists with what the other has as a repeated group as a group too. A list without any run of a group is searched for one with items besides."""
    for _ in range(2):
        for group in [g for g in b if not g[0]]:
            a = collapse(a, group[2])
            if all(key(i) != key(group) for i in a):
                a = collapse(a, group[2], True)
        a, b = b, a
    return a, b


def _rotated(pairs: list[tuple[int, int]], ka: list, kb: list) -> list[tuple[int, int]]:
    """The same alignment with each gap as far to the front as the keys allow."""
    pairs = [*pairs, (len(ka), len(kb))]
    for n in range(len(pairs) - 1, -1, -1):
        while True:
            x, y = pairs[n]
            px, py = pairs[n - 1] if n else (-1, -1)
            if n and x - px > 1 and y - py == 1 and ka[x - 1] == ka[px]:
                pairs[n - 1] = (x - 1, py)
            elif n and y - py > 1 and x - px == 1 and kb[y - 1] == kb[py]:
                pairs[n - 1] = (px, y - 1)
            else:
                break
            break
    return pairs[:-1]


def align(a: list, b: list) -> list:
    """Merges two lists: what both have in the same order is merged; where they differ, a run on one side that repeats what is beside it becomes a repeated group, and what is left becomes optional."""
    if not a or not b:
        return [_skipped(q) for q in a or b]
    a, b = _unified(a, b)
    ka, kb = [key(q) for q in a], [key(q) for q in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    pairs = _rotated(common(ka, kb), ka, kb)
    # Matched items and gaps in turn: the gap before pair n is parts[n][0] of a and parts[n][1] of b.
    out: list = []
    i, k = 0, 0
    merged = {n: merge(a[x], b[y]) for n, (x, y) in enumerate(pairs)}
    n = 0
    ends = [*pairs, (len(a), len(b))]
    while n <= len(pairs):
        x, y = ends[n]
        gaps = [g for g in (a[i:x], b[k:y]) if g]
        stop = n
        while stop < len(pairs) and (stop == n or ends[stop] == (ends[stop - 1][0] + 1, ends[stop - 1][1] + 1)):
            stop += 1
        after = [merged[q] for q in range(n, stop)]
        for gap in gaps:
            found = _iterated(out, gap, after)
            if found:
                out, gap, after = found
            out = out + [_skipped(q) for q in gap]
        out = out + after
        if stop == n:
            break
        i, k = ends[stop - 1][0] + 1, ends[stop - 1][1] + 1
        n = stop
    return _joined(out)


def _joined(items: list) -> list:
    """items with repeats of one key next to each other, of which alignment may leave some, as one."""
    out: list = []
    for i in items:
        if out and key(out[-1]) == key(i) and i[0] != "#":
            both_optional = out[-1][1] in ("?", "*") and i[1] in ("?", "*")
            one = merge(out[-1], i, True)
            out[-1] = [one[0], "*" if both_optional else "+", one[2]]
        else:
            out.append(i)
    return out


def bare(items: list) -> list:
    """Items without their texts: the shape of a page."""
    return [[i[0], i[1], [] if i[0] == "#" else bare(i[2])] for i in items]


def texts_of(items: list) -> list[list[str]]:
    """The texts of each text item, in the order in which items begin."""
    out, stack = [], [iter(items)]
    while stack:
        for i in stack[-1]:
            if i[0] == "#":
                out.append(i[2])
            else:
                stack.append(iter(i[2]))
                break
        else:
            stack.pop()
    return out


def dumps(items: list) -> str:
    """Items without their texts as a flat list of name, count and number of children, at any depth."""
    flat, stack = [len(items)], [iter(items)]
    while stack:
        for name, count, inside in stack[-1]:
            flat += (name, count, 0 if name == "#" else len(inside))
            if name != "#" and inside:
                stack.append(iter(inside))
                break
        else:
            stack.pop()
    return json.dumps(flat, separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> list:
    flat = json.loads(text)
    root: list = []
    stack, at = [[root, flat[0]]], 1
    while stack:
        into, left = stack[-1]
        if not left:
            stack.pop()
            continue
        stack[-1][1] -= 1
        item = [flat[at], flat[at + 1], []]
        into.append(item)
        if flat[at + 2]:
            stack.append([item[2], flat[at + 2]])
        at += 3
    return root


def numbered(items: list) -> list:
    """A shape whose text items hold their number in the order in which items begin."""
    for n, inside in enumerate(texts_of(items)):
        inside.append(n)
    return items


def _place(wrapper: list, items: list, slots: dict[int, int], at: int) -> int:
    for unit in [g[2] for g in wrapper if not g[0]]:
        items = collapse(items, unit)
    pairs = dict(common([key(w) for w in wrapper], [key(i) for i in items]))
    for k, w in enumerate(wrapper):
        item = items[pairs[k]] if k in pairs else None
        if w[0] == "#":
            for n in item[2] if item else ():
                slots[n] = at
            at += 1
        else:
            at = _place(w[2], item[2] if item else [], slots, at)
    return at


def place(wrapper: list, shape: list) -> list[int]:
    """The slot of each text item of a shape; slots are numbered in the order of the wrapper's texts, and a text that finds none has slot -1."""
    items = numbered(shape)
    slots: dict[int, int] = {}
    total = len(texts_of(items))
    _place(wrapper, items, slots, 0)
    return [slots.get(n, -1) for n in range(total)]


@any_depth
def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags, with #k for slot k."""
    number = iter(range(1 << 60))

    def write(items: list) -> str:
        out = ""
        for name, count, inside in items:
            body = f"#{next(number)}" if name == "#" else write(inside) if not name else f"<{name}>{write(inside)}</{name}>"
            out += f"({body}){count}" if count else body
        return out

    return write(wrapper)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, "(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: trees of Python objects are many times larger than their pages."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


@any_depth
def _read(page: str) -> tuple[str, list[list[str]]]:
    items = parse(page)
    return dumps(items), texts_of(items)


PARSED = "page_id long, host string, shape string, key binary, texts array<array<string>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import md5

    for batch in _parts(batches):
        found = [_read(h or "") for h in batch.column(2).to_pylist()]
        shapes = [s for s, _ in found]
        keys = [md5(s.encode("utf-8", "surrogatepass")).digest() for s in shapes]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(shapes, pa.string()), pa.array(keys, pa.binary()), pa.array([t for _, t in found], pa.list_(pa.list_(pa.string())))], names=["page_id", "host", "shape", "key", "texts"])


@any_depth
def aligned(shapes: list[str]) -> str:
    """One wrapper of several shapes: the longest first, then by text, so the result doesn't depend on the order of arrival."""
    shapes = sorted(shapes, key=lambda s: (-len(s), s))
    wrapper = loads(shapes[0])
    for s in shapes[1:]:
        wrapper = align(wrapper, loads(s))
    return dumps(wrapper)


def _fold_shapes(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": rows["host"].iloc[:1], "shape": [aligned(list(rows["shape"]))]})


def infer(shapes: DataFrame, scratch: Scratch, group: int = 64) -> DataFrame:
    """(host, wrapper): one wrapper for each host, from every row of shapes (host, shape), each different.

    Pages of one shape are one from the start. A host's shapes are aligned `group` at a time, then the wrappers of
    these, until one is left, so no task has all shapes of a large host to itself.
    """
    rows, step = shapes, 0
    while True:
        size = rows.groupBy("host").agg(F.count("*").alias("n"))
        if (size.agg(F.max("n").alias("n")).first().n or 0) <= 1:
            return rows.withColumnRenamed("shape", "wrapper")
        step += 1
        parts = F.ceil(F.col("n") / group)
        split = rows.join(size, "host").select("host", "shape", F.pmod(F.xxhash64("shape"), parts).alias("part"))
        done = split.groupBy("host", "part").applyInPandas(_fold_shapes, "host string, shape string").distinct()
        rows = scratch.save(done, f"wrappers-{step}")
        scratch.drop(f"wrappers-{step - 1}")


@lru_cache(64)
def _loaded(wrapper: str) -> list:
    return loads(wrapper)


@any_depth
def _slots_of(wrapper: str, shape: str) -> list[int]:
    return place(_loaded(wrapper), loads(shape))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        found = [_slots_of(w, s) for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["host", "key", "slots"])


FIELDS = "array<struct<slot:int,text:string>>"
_FIELDS = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        out = []
        for texts, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found: dict[int, list[str]] = {}
            for k, t in zip(slots, texts):
                found.setdefault(k, []).extend(t)
            out.append([{"slot": k, "text": "\n".join(v)} for k, v in sorted(found.items())])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, _FIELDS)], names=["page_id", "host", "fields"])


def extract(pages: DataFrame, group: int = 64, template_share: float = 0.5) -> DataFrame:
    """(page_id, host, fields, text): one row for each row of pages.

    A host's wrapper is inferred from all of its pages: their streams of tags and texts are aligned one after another.
    Where two differ, a run of items that repeats what is beside it becomes a repeated group, what is
    missing on one side becomes optional, and each text a slot. fields has the texts of the page's slots in order,
    those of a repeated slot on lines of their own. A slot that holds the same text on every page that has it is part of
    the template and left out, if it's on at least two of the host's different pages and on `template_share` of them; text
    is the rest on lines. Texts for which the wrapper has no place come first, as slot -1: none is lost.

    Each page is parsed once, to its shape and texts; wrappers and slots are worked out on different shapes only.
    A null or empty page has no field and an empty text; a null or unreadable URL counts as host ''; rows that
    repeat each have a row, and count as one page; other columns aren't read. Shapes are aligned in order of length and text, so ties don't matter.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), _host(F.col("url")).alias("host"), "html")
    parsed = scratch.save(own.mapInArrow(_parsed, PARSED), "parsed", "zstd")
    shapes = scratch.save(parsed.groupBy("host", "key").agg(F.first("shape").alias("shape")), "shapes", "zstd")
    wrappers = infer(shapes.select("host", "shape"), scratch, group)
    wrappers = sent_whole_if_small(wrappers, F.length("wrapper") + F.length("host"))
    slots = shapes.join(wrappers, "host").select("host", "key", "shape", "wrapper").mapInArrow(_placed, "host string, key binary, slots array<int>")
    slots = sent_whole_if_small(scratch.save(slots, "slots"), F.length("host") + 4 * F.size("slots") + 48)
    scratch.drop("shapes")
    found = parsed.join(slots, ["host", "key"]).select("page_id", "host", "texts", "slots").mapInArrow(_fields, f"page_id long, host string, fields {FIELDS}")
    page = found.select("host", F.xxhash64("fields").alias("page"), F.transform("fields", lambda x: F.struct(x["slot"].alias("slot"), F.xxhash64(x["text"]).alias("h"), F.length(x["text"]).alias("n"))).alias("f"))
    page = scratch.save(page.groupBy("host", "page").agg(F.first("f").alias("f")), "pages")
    many_pages = page.groupBy("host").agg(F.count("*").alias("pages"))
    same = page.select("host", F.explode("f").alias("f")).groupBy("host", "f.slot").agg(F.count("*").alias("have"), F.min(F.struct("f.h", "f.n")).alias("low"), F.max(F.struct("f.h", "f.n")).alias("high"))
    same = same.where("have > 1 and low = high and slot >= 0").join(many_pages, "host").where(F.col("have") >= template_share * F.col("pages"))
    same = same.groupBy("host").agg(F.collect_set("slot").alias("fixed"))
    # A host's few numbers go to the texts, as long as all of them are small, not the texts to the numbers.
    same = sent_whole_if_small(scratch.save(same, "fixed"), F.length("host") + 4 * F.size("fixed") + 16)
    scratch.drop("pages")
    kept = F.when(F.col("fixed").isNull(), F.col("fields")).otherwise(F.filter("fields", lambda x: ~F.array_contains("fixed", x["slot"])))
    return found.join(same, "host", "left").withColumn("fields", kept).select("page_id", "host", "fields", F.array_join(F.transform("fields", lambda x: x["text"]), "\n").alias("text"))
