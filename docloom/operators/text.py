"""Search, redaction and replacement over document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import folds

CONTEXT = 40


def lines(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keys, line_no (from 1), line."""
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def search(docs: DataFrame, needle: str, ids: tuple[str, ...] = ("doc_id",), more: tuple[str, ...] = ("source",)) -> DataFrame:
    """Non-overlapping matches, whatever their case: ids, more, line_no, col (bytes, from 1), context. ``ids`` tell texts apart, as a document and a page do.

    The line is cut at its matches once; where each starts is a running sum over the match rows of the line. A blank needle is an error.
    """
    if not needle.strip():
        raise ValueError("a search needs something to look for")
    pattern = "(?iu)\\Q" + needle + "\\E"
    keys = (*ids, *more)
    found = lines(docs, keys).filter(F.col("line").rlike(pattern))
    pieces, hits = F.split("line", pattern, -1), F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    after = F.slice(pieces, F.lit(2), F.size(pieces))
    zipped = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("h"), after.alias("a")), lambda z: z["h"].isNotNull())
    near = F.transform(zipped, lambda z: F.struct((F.octet_length(z["p"])).alias("gap"), F.octet_length(z["h"]).alias("size"), z["p"].alias("before"), z["h"].alias("hit"), z["a"].alias("after")))
    rows = found.select(*keys, "line_no", F.posexplode(near).alias("k", "m")).select(*keys, "line_no", "k", "m.*")
    order = Window.partitionBy(*ids, "line_no").orderBy("k")
    col = F.sum(F.col("gap") + F.col("size")).over(order) - F.col("size") + 1
    # Context may reach over neighbouring matches: up to CONTEXT characters on either side, from a few pieces and matches.
    wide = CONTEXT // max(len(needle), 1) + 1
    left = F.array_join(F.collect_list(F.concat("before", "hit")).over(order.rowsBetween(-wide, -1)), "")
    right = F.array_join(F.collect_list(F.concat("hit", "after")).over(order.rowsBetween(1, wide)), "")
    context = F.concat(F.right(F.concat(left, "before"), F.lit(CONTEXT)), "hit", F.left(F.concat("after", right), F.lit(CONTEXT)))
    return rows.select(*keys, "line_no", col.cast("int").alias("col"), F.trim(context).alias("context"))


def redact(text: Column, needles: list[str]) -> Column:
    """Every needle becomes as many blanks."""
    for n in needles:
        text = F.replace(text, F.lit(n), F.lit(" " * len(n)))
    return text


def translate(text: Column, dictionary: dict[str, str]) -> Column:
    """Replaces keys one after the other, the longest (in bytes) first, so that results can be replaced again."""
    for k in sorted(dictionary, key=lambda k: (-len(k.encode()), k)):
        text = F.replace(text, F.lit(k), F.lit(dictionary[k]))
    return text


def between(text: Column, start: str, end: str) -> Column:
    """The first text between two delimiters, trimmed; empty without them."""
    rest = F.when(text.contains(start), F.substring(text, F.locate(start, text) + len(start), F.length(text)))
    return F.coalesce(F.when(rest.contains(end), F.trim(F.substring_index(rest, end, 1))), F.lit(""))


def line_kind(line: Column) -> Column:
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike(r"^#{1,6}[ \t]"), "heading").when(t.rlike(r"^([-*+]|[0-9]+[.)])[ \t]"), "list")
        .when(t.rlike(r"^\|.*\|$"), "table").when(t.contains(" | "), "cells").when(t.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule").otherwise("text")
    )


def unique_slugs(rows: DataFrame, doc: str, order: str, base: str, ordered: bool = False) -> DataFrame:
    """Adds ``slug``: a heading's own where no heading of its document above has it, else numbered from 2 on until it is free; an empty one is "section"."""
    columns = [doc, order, *[c for c in rows.columns if c not in (doc, order)]]
    at = columns.index(base)

    def step(state: dict[str, int], *row) -> list[tuple]:
        name = slug = row[at] or "section"
        while slug in state:
            state[name] += 1
            slug = f"{name}-{state[name]}"
        state[slug] = 1
        return [(*row, slug)]

    kinds = dict(rows.dtypes)
    return folds.fold_sorted(rows, [doc], [order], dict, step, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", slug string", ordered=ordered)


def front_matter(text: Column) -> Column:
    """map of the keys (lower case) and values between two --- lines at the start; the last value of a key counts. Empty without a closing line."""
    block = F.regexp_extract(text, r"\A[ \t]*---[ \t]*\n((?s).*?)(?:^|\n)[ \t]*---[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    strip = lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def definitions(text: Column) -> Column:
    """struct of links (name, url, title) and notes (name, note) that lines define."""
    lines_of = F.split(text, "\n")
    link, note = r'^\s{0,3}\[([^\]^][^\]]*)\]:\s*(\S+)(?:\s+"([^"]*)")?\s*$', r"^\s{0,3}\[\^([^\]]+)\]:\s*(.*)$"
    links = F.transform(F.filter(lines_of, lambda x: x.rlike(link)), lambda x: F.struct(
        F.regexp_extract(x, link, 1).alias("name"), F.regexp_replace(F.regexp_extract(x, link, 2), "^[<>]+|[<>]+$", "").alias("url"), F.regexp_extract(x, link, 3).alias("title")))
    notes = F.transform(F.filter(lines_of, lambda x: x.rlike(note)), lambda x: F.struct(F.regexp_extract(x, note, 1).alias("name"), F.trim(F.regexp_extract(x, note, 2)).alias("note")))
    return F.struct(links.alias("links"), notes.alias("notes"))


def built_text(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: spans (keys, at, y, text) in their order; a new line starts where y is more than 1 from that of the line's first span."""
    rows = spans.select(*keys, "at", F.col("y").cast("double").alias("y"), "text")
    n = len(keys)

    def step(state: list, *row) -> list[tuple]:
        y, piece = row[n + 1], row[n + 2]
        if state[0] is None:
            state[0] = y
        elif abs(state[0] - y) > 1:
            state[0], piece = y, "\n" + piece
        return [(*row[: n + 1], piece)]

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "at")) + ", piece string"
    pieces = folds.fold_sorted(rows, keys, ["at"], lambda: [None], step, schema)
    joined = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(joined, lambda p: p["piece"]), "").alias("text"))
