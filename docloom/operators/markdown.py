"""Inline Markdown as HTML or plain text, by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import scalars as S

# Inline patterns, in the order in which they are replaced. HTML is escaped first.
IMAGE = r'!\[([^\]]*)\]\(([^\s)]+)(?:\s+"([^"]*)")?\)'
LINK = r'\[([^\]]+)\]\(([^\s)]+)(?:\s+"([^"]*)")?\)'
REFERENCE = r"\[([^\]]+)\]\[([^\]]*)\]"
AUTO_LINK = r"&lt;(https?://[^\s]+|mailto:[^\s]+)&gt;"
FOOTNOTE = r"\[\^([^\]]+)\]"
CODE, STRONG, EMPHASIS, STRIKE = r"`([^`]+)`", r"\*\*([^*]+)\*\*|__([^_]+)__", r"\*([^*]+)\*|_([^_]+)_", r"~~([^~]+)~~"


def _references(text: Column, refs: Column | None, known, unknown) -> Column:
    """Each [text][name] by ``known(text, ref)`` where ``refs`` (lower-case name to struct<url, title>) has the name, or the text if that is empty; else ``unknown(match, text)``."""
    if refs is None:
        return text

    def one(m: Column) -> Column:
        # Neither part holds a closing bracket, so a match is cut where the first ends.
        label, name = F.substring_index(F.substring(m, F.lit(2), F.length(m)), "]", 1), F.substring_index(F.substring_index(m, "][", -1), "]", 1)
        ref = refs[F.lower(F.when(name == "", label).otherwise(name))]
        return F.when(ref.isNotNull(), known(label, ref)).otherwise(unknown(m, label))

    def joined(x: Column) -> Column:
        pieces = F.split(x["text"], REFERENCE, -1)
        return F.when(F.size(x["found"]) > 0, F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.transform(x["found"], one).alias("m")), lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit("")))), "")).otherwise(x["text"])

    # In lists of one, so that neither the text, which is itself an expression, nor the search is repeated.
    searched = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)).alias("found")))
    return F.transform(searched, joined)[0]


def inline_html(text: Column, refs: Column | None = None) -> Column:
    """Images, links, references, footnote marks, code, emphasis and line breaks of escaped text. Unknown references stay as they are."""
    out = S.html_escape(text)
    out = F.regexp_replace(out, IMAGE, '<img src="$2" alt="$1" loading="lazy">')
    out = F.regexp_replace(out, LINK, '<a href="$2">$1</a>')

    def known(label: Column, ref: Column) -> Column:
        title = F.when(F.coalesce(ref["title"], F.lit("")) != "", F.concat(F.lit(' title="'), S.html_escape(ref["title"]), F.lit('"'))).otherwise("")
        return F.concat(F.lit('<a href="'), S.html_escape(ref["url"]), F.lit('"'), title, F.lit(">"), label, F.lit("</a>"))

    out = _references(out, refs, known, lambda m, label: m)
    out = F.regexp_replace(out, AUTO_LINK, '<a href="$1">$1</a>')
    out = F.regexp_replace(out, FOOTNOTE, '<sup id="fnref-$1"><a href="#fn-$1">$1</a></sup>')
    for pattern, tag, groups in ((CODE, "code", "$1"), (STRONG, "strong", "$1$2"), (EMPHASIS, "em", "$1$2"), (STRIKE, "del", "$1")):
        out = F.regexp_replace(out, pattern, f"<{tag}>{groups}</{tag}>")
    return F.replace(out, F.lit("  \n"), F.lit("<br>"))


def inline_plain(text: Column, refs: Column | None = None) -> Column:
    """The text of inline Markdown: links with their address in brackets, images by their description, no marks. Unknown references leave their text."""
    out = F.regexp_replace(F.regexp_replace(text, IMAGE, "$1"), LINK, "$1 ($2)")
    out = _references(out, refs, lambda label, ref: F.concat(label, F.lit(" ("), ref["url"], F.lit(")")), lambda m, label: label)
    return F.regexp_replace(F.regexp_replace(out, FOOTNOTE, "$1"), r"\*\*|__|`|~~|\*|_", "")


def references(definitions: Column) -> Column:
    """What ``text.definitions`` found as the map that these functions take; of equal names the last counts."""
    links = F.transform(definitions, lambda d: F.struct(F.lower(d["name"]).alias("k"), F.struct(d["url"].alias("url"), d["title"].alias("title")).alias("v")))
    last = F.filter(links, lambda e, i: ~F.exists(F.slice(links, i + 2, F.size(links)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)
