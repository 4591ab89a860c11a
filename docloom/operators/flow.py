"""Runs to words, words to lines, rows of tables to pages, and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import folds

# Width of a sign without metrics, in font sizes; where the base line is; least height of a table row besides its padding.
SIGN_WIDTH, ASCENT, LEAST_ROW = 0.5, 0.8, 12.0
_WORD = re.compile(r"[^ \t]+")


class _Open:
    """A word that runs are being read into: its texts by style, its width, the size of its first run and its largest one."""

    __slots__ = ("parts", "width", "first", "size")

    def __init__(self):
        self.parts, self.width, self.first, self.size = [], 0.0, None, None

    def read(self, text: str | None, look: tuple, size: float) -> Iterator[tuple]:
        """The words that end in a run, as (parts, text, width, space, size)."""
        for m in _WORD.finditer(text or ""):
            if m.start() and self.parts:
                yield from self.ended()
            piece, parts = m.group(), self.parts
            if not parts and m.end() < len(text):
                yield [(look, piece)], piece, len(piece) * size * SIGN_WIDTH, size * SIGN_WIDTH, size
                continue
            if not parts:
                self.first = self.size = size
            if not parts or parts[-1][0] != look:
                parts.append((look, []))
            parts[-1][1].append(piece)
            self.width += len(piece) * size * SIGN_WIDTH
            self.size = max(self.size, size)
        if text and text[-1] in " \t":
            yield from self.ended()

    def ended(self) -> Iterator[tuple]:
        if self.parts:
            parts = [(look, "".join(texts)) for look, texts in self.parts]
            word = (parts, "".join([text for _, text in parts]), self.width, self.first * SIGN_WIDTH, self.size)
            self.parts, self.width = [], 0.0
            yield word


class _Line:
    """Where a line that is being filled ends, and its number and number of words."""

    __slots__ = ("line", "x", "words")

    def __init__(self, indent: float):
        self.line, self.x, self.words = 1, indent, 0

    def place(self, word: float, space: float, width: float) -> float:
        """Where a word starts, on this line or on the next one."""
        x = self.x + (space if self.words else 0.0)
        if self.words and x + word > width:
            self.line, self.words, x = self.line + 1, 0, 0.0
        self.x, self.words = x + word, self.words + 1
        return x


def words(runs: DataFrame, keys: list[str], order: str, style: list[str]) -> DataFrame:
    """keys, word (from 1), parts (array of struct of the style columns and text), text, width, space, size of the words of runs (keys, order, text, size, style...).

    A word ends at a blank or tab, not at the end of a run; neighbouring runs of one style are one part. Signs are taken to be half a font size wide.
    """
    columns = [*keys, order, "text", *style, *(["size"] if "size" not in style else [])]
    n, at_text = len(keys), len(keys) + 1
    size_at = columns.index("size")
    kinds = dict(runs.dtypes)

    def rows(state: dict, key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        for parts, *rest in found:
            state["word"] += 1
            yield (*key, state["word"], [dict(zip((*style, "text"), (*look, text), strict=True)) for look, text in parts], *rest)

    def step(state: dict, *row) -> Iterator[tuple]:
        return rows(state, row[:n], state["open"].read(row[at_text], row[at_text + 1 : at_text + 1 + len(style)], row[size_at]))

    looks = "".join(f"`{c}`: {kinds[c]}, " for c in style)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", word int, parts array<struct<{looks}text: string>>, text string, width double, space double, size {kinds['size']}"
    return folds.fold_sorted(runs.select(*columns), keys, [order], lambda: {"word": 0, "open": _Open()}, step, schema, end=lambda state, *key: rows(state, key, state["open"].ended()))


def wrap(rows: DataFrame, keys: list[str], width: float, indent: float = 0.0, most: int = 0, ordered: bool = False) -> DataFrame:
    """Words (keys, word, width, space, ...) with line (from 1), and x, where they start in it. A word that is wider than a line has one of its own.

    The first line is indented. With ``most`` lines, the words that are left over have neither line nor x. ``ordered``: rows stand as ``words`` gave them.
    """
    columns = [*keys, "word", *[c for c in rows.columns if c not in (*keys, "word")]]
    w, s = columns.index("width"), columns.index("space")

    def step(state: _Line, *row) -> list[tuple]:
        x = state.place(row[w], row[s], width) if not state.line > most > 0 else 0.0
        return [(*row, None, None) if state.line > most > 0 else (*row, state.line, x)]

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", line int, x double"
    return folds.fold_sorted(rows, keys, ["word"], lambda: _Line(indent), step, schema, ordered=ordered)


def run_lines(runs: DataFrame, keys: list[str], order: str, width: float, indent: float = 0.0) -> DataFrame:
    """What ``lines`` gives for the wrapped words of runs (keys, order, text, size), and words, their number: in one pass over the sorted runs, from which only lines come.

    A task holds a word and a line; words are neither shuffled nor handed from step to step.
    """
    n = len(keys)
    kinds = dict(runs.dtypes)

    def ended(state: dict, key: tuple) -> tuple:
        return (*key, state["line"], " ".join(state["texts"]), state["width"], state["height"], state["height"] * ASCENT, len(state["texts"]))

    def rows(state: dict, key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        at, texts = state["at"], state["texts"]
        for _, text, word, space, size in found:
            at.place(word, space, width)
            if texts and at.words == 1:
                yield ended(state, key)
                texts.clear()
            if texts:
                state["width"], state["height"] = max(state["width"], at.x), max(state["height"], size)
            else:
                state["line"], state["width"], state["height"] = at.line, at.x, size
            texts.append(text)

    def step(state: dict, *row) -> Iterator[tuple]:
        return rows(state, row[:n], state["open"].read(row[n + 1], (), row[n + 2]))

    def end(state: dict, *key) -> Iterator[tuple]:
        yield from rows(state, key, state["open"].ended())
        if state["texts"]:
            yield ended(state, key)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", line int, text string, width double, height {kinds['size']}, ascent double, words int"
    return folds.fold_sorted(runs.select(*keys, order, "text", "size"), keys, [order], lambda: {"open": _Open(), "at": _Line(indent), "texts": []}, step, schema, end=end)


def lines(wrapped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, text, width, height (its largest font size) and ascent of wrapped words."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda p: p["text"]), " ")
    rows = wrapped.filter("line is not null").groupBy(*keys, "line").agg(texts.alias("text"), F.max(F.col("x") + F.col("width")).alias("width"), F.max("size").alias("height"))
    return rows.withColumn("ascent", F.col("height") * ASCENT)


def row_heights(cells: DataFrame, keys: list[str], padding: float) -> DataFrame:
    """keys, row, height: the highest content of a row's cells (keys, row, content; null for none) with its padding, or a least height."""
    return cells.groupBy(*keys, "row").agg(F.coalesce(F.max("content") + 2 * padding, F.lit(2 * padding + LEAST_ROW)).alias("height"))


def table_flow(rows: DataFrame, keys: list[str], room: float, headers: int = 1) -> DataFrame:
    """keys, row, page (from 1), y, height, repeated: where the rows (keys, row from 0, height) of tables stand on pages with ``room``.

    A row that does not fit opens a page, on which the first ``headers`` rows come again. A row that does not fit behind them either runs over its page.
    """
    n = len(keys)

    def step(state: dict, *row) -> list[tuple]:
        key, at, height = row[:n], row[n], row[n + 1]
        out = []
        if state["y"] + height > room and state["filled"]:
            state["page"], state["y"] = state["page"] + 1, 0.0
            for head, size in state["heads"]:
                out.append((*key, head, state["page"], state["y"], size, True))
                state["y"] += size
            state["filled"] = False
        out.append((*key, at, state["page"], state["y"], height, False))
        state["y"] += height
        if at < headers:
            state["heads"].append((at, height))
        else:
            state["filled"] = True
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", row int, page int, y double, height double, repeated boolean"
    plain = rows.select(*keys, F.col("row").cast("int").alias("row"), F.col("height").cast("double").alias("height"))
    return folds.fold_sorted(plain, keys, ["row"], lambda: {"page": 1, "y": 0.0, "heads": [], "filled": False}, step, schema)


def list_items(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """page_id, list_id, item (from 1), depth (of lists, from 1), marker and text of every item of the lists of ``dom.nodes``.

    The text is that of ``styles.text_runs`` in the item itself; lists inside it are lists of their own. Ordered lists are numbered, others have a bullet.
    """
    lists = nodes.filter(F.col("tag").isin("ul", "ol")).select("page_id", F.col("node_id").alias("list_id"), F.col("tag").alias("kind"), (F.size(F.filter("path", lambda t: t.isin("ul", "ol"))) + 1).alias("depth"))
    items = nodes.filter("tag = 'li'").select("page_id", "node_id", F.col("parent_id").alias("list_id")).join(lists, ["page_id", "list_id"])
    items = items.withColumn("item", F.row_number().over(Window.partitionBy("page_id", "list_id").orderBy("node_id")))
    texts = runs.groupBy("page_id", F.col("block").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"]), "").alias("text"))
    marker = F.when(F.col("kind") == "ol", F.concat(F.col("item"), F.lit(". "))).otherwise("• ")
    return items.join(texts, ["page_id", "node_id"], "left").select("page_id", "list_id", "item", "depth", marker.alias("marker"), F.coalesce("text", F.lit("")).alias("text"))
