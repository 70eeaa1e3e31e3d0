"""Pages as a table of elements, a row each: the tree is links between rows, so selectors are filters, joins and windows.

A stack machine over Arrow batches reads each page once.  Elements that HTML lets stand open (p, li, dt, dd, td, th, tr,
option) end where the next one begins; what is never closed ends with its parent; elements without content hold nothing;
scripts and styles hold raw text that counts as nobody's text.  Elements nested deeper than MAX_DEPTH become children of
the last one above, as in browsers.

A null page has no rows.  A row repeats its page's key; pages that share a key share their rows' keys too, so give each
page its own.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 512
#: page; node: 0 for the whole page, then elements as they begin; place: among the elements of the same parent;
#: path: the element's ancestors from the outermost on, and itself at the end; raw: of scripts.
SCHEMA = "page long, node int, parent int, place int, tag string, attributes map<string,string>, path array<struct<node:int,tag:string,kind:string>>, text string, raw string"
_NAMES = ["page", "node", "parent", "place", "tag", "attributes", "path", "text", "raw"]
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(["script", "style", "textarea", "title", "noscript"])
_SILENT = frozenset(["script", "style"])
#: What an opening tag ends, if it stands open; and what it is looked for in.
_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_ENDS |= {t: ("p", ("button", "table")) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_BATCH_ROWS = 5_000
#: Bytes of a batch of pages, and characters of rows that wait for theirs: a worker's memory follows neither.
_BATCH_BYTES = 4 << 20


def elements(html: str) -> list[list]:
    """Rows of _NAMES without the page, the whole page first."""
    rows = [[0, None, 0, "#page", {}, [], None, None]]
    begins, children = [0], [0]
    stack, said, length = [0], [], 0

    def say(raw: str) -> None:
        nonlocal length
        if raw:
            said.append(unescape(raw))
            length += len(said[-1])

    def close(upto: int) -> None:
        while len(stack) > upto:
            row = stack.pop()
            rows[row][6] = (begins[row], length)

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        if not token:
            say(html[at:])
            break
        say(html[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if rows[stack[depth]][3] == tag:
                    close(depth)
                    break
            continue
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                name = rows[stack[depth]][3]
                if name in within:
                    break
                if name in ended.split():
                    close(depth)
                    if tag != "tr":
                        break
        attributes = {}
        for name, double, single, bare in _ATTRIBUTE.findall(token[3]):
            attributes.setdefault(name.lower(), unescape(double or single or bare))
        parent, row = stack[-1], len(rows)
        path = [*rows[parent][5], (row, tag, attributes.get("class", ""))]
        rows.append([row, parent, children[parent], tag, attributes, path, None, None])
        children[parent] += 1
        begins.append(length)
        children.append(0)
        if tag in _EMPTY or token[3].endswith("/"):
            rows[row][6] = (length, length)
        elif tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>|$", re.I).search(html, at)
            raw, at = html[at : stop.start()], stop.end()
            if tag in _SILENT:
                rows[row][7] = raw
            else:
                say(raw)
            rows[row][6] = (begins[row], length)
        elif len(stack) > MAX_DEPTH:
            rows[row][6] = (length, length)
        else:
            stack.append(row)
    close(0)
    text = "".join(said)
    for row in rows:
        row[6] = text[slice(*row[6])]
    return rows


def nodes(pages: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """pages: one row a page with a whole number as key."""

    def run(batches):
        for batch in batches:
            out, waiting = [], 0
            for page, source in zip(batch.column(0), batch.column(1), strict=True):
                if source.is_valid:
                    rows = elements(source.as_py())
                    out += [[page.as_py(), *row] for row in rows]
                    waiting += sum(len(row[6]) for row in rows)
                if len(out) >= _BATCH_ROWS or waiting >= _BATCH_BYTES:
                    yield _packed(out)
                    out, waiting = [], 0
            yield _packed(out)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, SCHEMA)


#: A page and its elements of some tags, in their order.
FOUND = "page long, found array<struct<tag:string,attributes:map<string,string>,text:string>>"


def elements_of(pages: DataFrame, tags: list[str], key: str = "page", html: str = "html") -> DataFrame:
    """A row a page, null pages too: what is asked of elements one by one needs no row of its own, and so no shuffle."""
    wanted = frozenset(tags)

    def run(batches):
        for batch in batches:
            out, waiting = [], 0
            for page, source in zip(batch.column(0), batch.column(1), strict=True):
                rows = [row for row in elements(source.as_py()) if row[3] in wanted] if source.is_valid else None
                out.append([page.as_py(), rows])
                waiting += 1 + sum(200 + len(row[6]) for row in rows or [])
                if len(out) >= _BATCH_ROWS or waiting >= _BATCH_BYTES:
                    yield _listed(out)
                    out, waiting = [], 0
            yield _listed(out)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, FOUND)


def _listed(pages: list[list]) -> pa.RecordBatch:
    rows = [row for _, found in pages for row in found or []]
    ends = list(accumulate((len(found or []) for _, found in pages), initial=0))
    starts = [None if found is None else at for (_, found), at in zip(pages, ends, strict=False)] + ends[-1:]
    each = pa.StructArray.from_arrays([pa.array([r[3] for r in rows], pa.string()), _maps([r[4] for r in rows]), pa.array([r[6] for r in rows], pa.string())], ["tag", "attributes", "text"])
    return pa.RecordBatch.from_arrays([pa.array([page for page, _ in pages], pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)], ["page", "found"])


def _offsets(many: list) -> pa.Array:
    return pa.array(list(accumulate(map(len, many), initial=0)), pa.int32())


def _maps(attributes: list[dict]) -> pa.MapArray:
    keys, values = [k for a in attributes for k in a], [v for a in attributes for v in a.values()]
    return pa.MapArray.from_arrays(_offsets(attributes), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _packed(rows: list[list]) -> pa.RecordBatch:
    page, node, parent, place, tag, attributes, path, text, raw = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    steps = list(zip(*chain.from_iterable(path), strict=True)) or [[]] * 3
    steps = pa.StructArray.from_arrays([pa.array(steps[0], pa.int32()), pa.array(steps[1], pa.string()), pa.array(steps[2], pa.string())], ["node", "tag", "kind"])
    columns = [pa.array(page, pa.int64()), *(pa.array(c, pa.int32()) for c in (node, parent, place)), pa.array(tag, pa.string())]
    columns += [_maps(attributes), pa.ListArray.from_arrays(_offsets(path), steps), pa.array(text, pa.string()), pa.array(raw, pa.string())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def kind() -> Column:
    """The class attribute, '' without one."""
    return F.coalesce(attribute("class"), F.lit(""))


def ancestors() -> Column:
    """The path without the element itself."""
    return F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))


def closest(test) -> Column:
    """The number of the nearest of the element and its ancestors that passes test(step of the path); null if none does."""
    return F.try_element_at(F.filter("path", test), F.lit(-1))["node"]
