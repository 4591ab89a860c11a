"""HTML pages as a node table, and selectors as joins over it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions import scalars as S

#: Elements without content, and those that a following sibling of the set closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_PART = {"thead", "tbody", "tfoot", "tr", "td", "th"}
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "thead": _PART, "tbody": _PART, "tfoot": _PART, "div": {"p"}, "ul": {"p"}, "h1": {"p"}, "h2": {"p"}}
SCHEMA = "page_id long, node_id int, parent_id int, depth int, child_ix int, tag string, id string, classes array<string>, href string, text string, ancestors array<int>, path array<string>, attrs map<string,string>, hidden boolean, last_id int"

#: How many rows a task gathers before it hands them on, and how many pages it takes out of a batch at once.
ROWS, PAGES = 4096, 64

# Markup that any tokenizer reads alike: plain start and end tags, each with the text behind it. A page with anything else (the last group) goes to the standard library's.
_PLAIN = re.compile(r"""(?:<([a-z][a-z0-9]*)((?:[ \t\n]+[a-z]+=(?:"[^"&]*"|'[^'&]*'|[^\s"'<>=`&/]+))*)>|</([a-z][a-z0-9]*)>|(?=[^<&]))([^<&]*)|(.)""")
_PLAIN_ATTR = re.compile(r"""([a-z]+)=(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_RAW = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math)\b")


def _plain_attrs(attrs: str) -> dict[str, str]:
    return {k: a or b or c for k, a, b, c in _PLAIN_ATTR.findall(attrs)}


#: The same for short ones, most of which repeat each other.
SHORT = 100
_short_attrs = lru_cache(4096)(_plain_attrs)


class Tree(HTMLParser):
    """A page while it is read: the ids and tags of open elements, and the number of nodes so far. What is kept of it a subclass says in ``start``, ``add``, ``add_text`` and ``found``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.start()

    def start(self) -> None:
        self.open: list[int] = []
        self.path: list[str] = []
        self.count = 0

    def add(self, tag: str, attrs: dict) -> None:
        """An element, before it is open."""

    def add_text(self, text: str) -> None:
        """A text that is not blank."""

    def close_to(self, upto: int) -> None:
        """Closes open elements but the first ``upto``."""
        del self.open[upto:], self.path[upto:]

    def found(self) -> list:
        """The rows of a page that has been read."""
        return []

    def read(self, html: str) -> list:
        """The rows of one page."""
        self.start()
        if not (self._read_plain(html) if not _RAW.search(html) else False):
            self.start()
            self.reset()
            self.feed(html)
            self.close()
        self.close_to(0)
        return self.found()

    def _read_plain(self, html: str) -> bool:
        """Reads a page of plain markup; False, with some of it read, where it holds anything else."""
        start, end, data = self.handle_starttag, self.handle_endtag, self.handle_data
        for tag, attrs, ended, text, odd in _PLAIN.findall(html):
            if tag:
                start(tag, (_short_attrs if len(attrs) <= SHORT else _plain_attrs)(attrs) if attrs else ())
            elif ended:
                end(ended)
            elif odd:
                return False
            if text:
                data(text)
        return True

    def handle_starttag(self, tag, attrs):
        path = self.path
        if tag in CLOSES:
            closes, upto = CLOSES[tag], len(path)
            while upto and path[upto - 1] in closes:
                upto -= 1
            if upto < len(path):
                self.close_to(upto)
        self.add(tag, dict(attrs) if attrs else {})
        if tag not in VOID:
            self.open.append(self.count)
            path.append(tag)
        self.count += 1

    def handle_endtag(self, tag):
        path = self.path
        if path and path[-1] == tag:
            self.close_to(len(path) - 1)
        elif tag in path:
            at = len(path) - 1
            while path[at] != tag:
                at -= 1
            self.close_to(at)

    def handle_data(self, data):
        if data == " " or not data.isspace():
            self.add_text(data)
            self.count += 1


class _Nodes(Tree):
    """Pre-order rows; ``last_id`` is the last descendant, so that a subtree is a range of node ids. Script and style text is hidden."""

    def start(self) -> None:
        super().start()
        self.rows: list[list] = []
        self.children: dict[int, int] = {}

    def found(self) -> list[list]:
        return self.rows

    def add_text(self, text: str) -> None:
        self.add("", {}, text)

    def add(self, tag: str, attrs: dict, text: str | None = None) -> None:
        rows, above = self.rows, self.open
        k, parent = self.count, above[-1] if above else -1
        ix = self.children.get(parent, 0)
        self.children[parent] = ix + 1
        hidden = bool(above) and self.path[-1] in ("script", "style")
        if attrs:
            rows.append([k, parent, len(above), ix, tag, attrs.get("id"), (attrs.get("class") or "").split(), attrs.get("href"), text, above.copy(), self.path.copy(), [(a, v or "") for a, v in attrs.items()], hidden, k])
        else:
            rows.append([k, parent, len(above), ix, tag, None, [], None, text, above.copy(), self.path.copy(), [], hidden, k])

    def close_to(self, upto: int) -> None:
        for k in self.open[upto:]:
            self.rows[k][-1] = self.count - 1
        super().close_to(upto)


def read_pages(pages: DataFrame, reader: Callable[[], Tree], schema: StructType, kept: Callable[[list], list] | None = None, at: list[int] | None = None) -> DataFrame:
    """What ``reader`` finds in each page (page_id, html), parsed page by page inside tasks. ``kept`` takes rows of a page out of those found, ``at`` gives their places for columns of ``schema`` (-1: page_id)."""
    arrow = to_arrow_schema(schema)
    at = list(range(-1, len(schema) - 1)) if at is None else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = reader()
        ids: list[int] = []
        out: list = []
        for b in batches:
            for first in range(0, b.num_rows, PAGES):
                part = b.slice(first, PAGES)
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows = parser.read(html or "")
                    out += rows if kept is None else kept(rows)
                    ids += [page] * (len(out) - len(ids))
                    if len(out) >= ROWS:
                        yield from batch(ids, out)
                        ids, out = [], []
        if out:
            yield from batch(ids, out)

    def batch(ids: list[int], out: list) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(out), ROWS):
            values = list(zip(*out[first : first + ROWS], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + ROWS] if k < 0 else values[k], f.type) for k, f in zip(at, arrow, strict=True)], schema=arrow)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def nodes(pages: DataFrame, columns: list[str] | None = None, tags: tuple[str, ...] | None = None) -> DataFrame:
    """One row per element or text node, parsed page by page inside tasks; of them only ``columns`` and rows of ``tags`` ('' for texts), where given."""
    wanted = [(k, f) for k, f in enumerate(StructType.fromDDL(SCHEMA)) if columns is None or f.name in columns]
    kept = None if tags is None else (lambda rows: [r for r in rows if r[4] in tags])
    return read_pages(pages, _Nodes, StructType([f for _, f in wanted]), kept, [k - 1 for k, _ in wanted])


def text_content(tree: DataFrame) -> DataFrame:
    """page_id, node_id, tag, text: the text of each element's subtree in document order, script and style left out."""
    above = F.explode(F.arrays_zip("ancestors", "path")).alias("a")
    words = tree.filter("tag = '' and not hidden").select("page_id", F.col("node_id").alias("t"), F.col("text").alias("piece"), above)
    pieces = F.array_sort(F.collect_list(F.struct("t", "piece")))
    text = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    return words.groupBy("page_id", F.col("a.ancestors").alias("node_id"), F.col("a.path").alias("tag")).agg(text.alias("text"))


def select_child(tree: DataFrame, ancestor: str, tag: str) -> DataFrame:
    """Nodes of ``tag`` with an ``ancestor`` above them (the selector ``ancestor tag``), with the nearest one."""
    up = F.filter(F.arrays_zip("ancestors", "path"), lambda a: a["path"] == ancestor)
    return tree.filter(F.col("tag") == tag).select("page_id", "node_id", F.element_at(F.transform(up, lambda a: a["ancestors"]), -1).alias("ancestor_id")).filter("ancestor_id is not null")


# What a parser does not read as tags, start tags of links with their attributes, and one attribute of them.
_SKIPPED = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_ANCHOR = r"""(?is)<a(?=[\s/])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_HREF = r"""(?is)(?:^|[\s/"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links(pages: DataFrame) -> DataFrame:
    """page_id, seq (from 1), href of the links of each page with an address, in any spelling that a parser reads; by expressions alone, without a tree."""
    html = F.regexp_replace("html", _SKIPPED, "")
    of = lambda a: F.when(a.rlike(_HREF), S.unescape_html(F.concat(*[F.regexp_extract(a, _HREF, k) for k in (1, 2, 3)])))
    found = F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)), of))
    return pages.select("page_id", F.posexplode(found).alias("seq", "href")).select("page_id", (F.col("seq") + 1).alias("seq"), "href")
