"""Selectors over a node table: predicates on a node, and combinators as joins.

A tree is rows (page_id, node_id, parent_id, tag, id, classes, attrs, ancestors); node ids are in document order, text
nodes have an empty tag, ``ancestors`` are node ids from the root down. Order among siblings comes from windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Simple:
    """What one node must be: tag ("" or * for any), id, classes, attribute tests (name, operator, value), pseudo-classes; ``none_of`` is :not, ``any_of`` is :is."""

    tag: str = ""
    id: str = ""
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    pseudo: tuple[str, ...] = ()
    none_of: tuple[Simple, ...] = ()
    any_of: tuple[Simple, ...] = ()


@dataclass(frozen=True)
class Chain:
    """``first`` and then (combinator, Simple) pairs; combinators are " ", ">", "+" and "~"."""

    first: Simple
    rest: tuple[tuple[str, Simple], ...] = field(default=())

    def then(self, combinator: str, simple: Simple) -> Chain:
        return replace(self, rest=(*self.rest, (combinator, simple)))


def attribute_test(attrs: Column, name: str, op: str, value: str = "") -> Column:
    """op: "" (there), =, ~= (a word), |= (itself or before a hyphen), ^=, $=, *=. A missing attribute passes none."""
    got = attrs[name]
    tests = {
        "": got.isNotNull(), "=": got == value, "~=": F.array_contains(F.split(got, r"\s+"), value) & F.lit(value != ""), "|=": (got == value) | got.startswith(value + "-"),
        "^=": got.startswith(value), "$=": got.endswith(value), "*=": got.contains(value),
    }
    return F.coalesce(tests[op], F.lit(False))


#: Columns of ``with_siblings``, and those that a pseudo-class reads.
SIBLINGS = ("el_ix", "el_n", "type_ix", "type_n", "prev_id", "n_children")
_READS = {"first-child": ("el_ix",), "last-child": ("el_ix", "el_n"), "only-child": ("el_n",), "empty": ("n_children",), "first-of-type": ("type_ix",), "last-of-type": ("type_ix", "type_n")}


def sibling_columns(chains: Iterable[Chain]) -> tuple[str, ...]:
    """Those of ``SIBLINGS`` that matching ``chains`` reads."""
    reads: set[str] = set()

    def add(s: Simple) -> None:
        for p in s.pseudo:
            reads.update(("el_ix",) if p.startswith("nth-child(") else _READS.get(p, ()))
        for inner in (*s.none_of, *s.any_of):
            add(inner)

    for chain in chains:
        add(chain.first)
        for combinator, s in chain.rest:
            add(s)
            if combinator == "+":
                reads.add("prev_id")
    return tuple(c for c in SIBLINGS if c in reads)


def with_siblings(tree: DataFrame, columns: Iterable[str] = SIBLINGS) -> DataFrame:
    """The elements of ``tree`` with el_ix, el_n (place and number among element siblings, from 0), type_ix, type_n, prev_id and n_children (text counts).

    Of these only ``columns``, as each costs a sort or, as n_children, a second pass over the tree.
    """
    elements = tree.filter("tag <> ''")
    same = Window.partitionBy("page_id", "parent_id")
    kind = Window.partitionBy("page_id", "parent_id", "tag")
    places = {
        "el_ix": F.row_number().over(same.orderBy("node_id")) - 1, "prev_id": F.lag("node_id").over(same.orderBy("node_id")),
        "el_n": F.count("*").over(same), "type_ix": F.row_number().over(kind.orderBy("node_id")) - 1, "type_n": F.count("*").over(kind),
    }
    if wanted := {c: place for c, place in places.items() if c in columns}:
        elements = elements.withColumns(wanted)
    if "n_children" not in columns:
        return elements
    children = tree.groupBy("page_id", F.col("parent_id").alias("_p")).agg(F.count("*").alias("n_children"))
    elements = elements.join(children.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.col("node_id") == F.col("_p")), "left")
    return elements.drop("_page", "_p").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def pseudo_test(pseudo: str) -> Column:
    """On rows of ``with_siblings``. Unknown ones, and those of a pointer (hover, active, focus), match nothing."""
    at, n = F.col("el_ix"), F.col("el_n")
    child_of_element = F.col("parent_id") >= 0
    tests = {
        "first-child": at == 0, "last-child": at == n - 1, "only-child": n == 1, "empty": F.col("n_children") == 0,
        "first-of-type": child_of_element & (F.col("type_ix") == 0), "last-of-type": child_of_element & (F.col("type_ix") == F.col("type_n") - 1),
        "link": (F.col("tag") == "a") & (F.coalesce(F.col("attrs")["href"], F.lit("")) != ""),
    }
    tests["visited"] = tests["link"]
    if pseudo.startswith("nth-child("):
        which = pseudo[len("nth-child(") :].partition(")")[0].strip().lower()
        if which in ("odd", "even"):
            return (at + 1) % 2 == int(which == "odd")
        return at + 1 == int(which) if which.lstrip("-+").isdigit() else F.lit(False)
    return tests.get(pseudo, F.lit(False))


def simple_test(s: Simple) -> Column:
    out = F.lit(True)
    if s.tag not in ("", "*"):
        out = out & (F.col("tag") == s.tag)
    if s.id:
        out = out & F.coalesce(F.col("id") == s.id, F.lit(False))
    for c in s.classes:
        out = out & F.array_contains("classes", c)
    for name, op, value in s.attrs:
        out = out & attribute_test(F.col("attrs"), name, op, value)
    for p in s.pseudo:
        out = out & pseudo_test(p)
    for inner in s.none_of:
        out = out & ~simple_test(inner)
    if s.any_of:
        one = F.lit(False)
        for inner in s.any_of:
            one = one | simple_test(inner)
        out = out & one
    return out


def select(elements: DataFrame, chain: Chain) -> DataFrame:
    """page_id, node_id of the matches of ``chain`` in ``elements`` (of ``with_siblings``, best written out, as each step reads them)."""
    found = elements.filter(simple_test(chain.first)).select("page_id", "node_id", "parent_id")
    for combinator, s in chain.rest:
        own = elements.filter(simple_test(s))
        left = found.select("page_id", F.col("node_id").alias("_n"), F.col("parent_id").alias("_p"))
        if combinator == " ":
            hits = own.select("page_id", "node_id", "parent_id", F.explode("ancestors").alias("_n")).join(left, ["page_id", "_n"]).select("page_id", "node_id", "parent_id").distinct()
        elif combinator == ">":
            hits = own.join(left, (own["page_id"] == left["page_id"]) & (own["parent_id"] == F.col("_n")), "left_semi")
        elif combinator == "+":
            hits = own.join(left, (own["page_id"] == left["page_id"]) & (own["prev_id"] == F.col("_n")), "left_semi")
        else:
            # Some match stands before, if the first one of the same parent does.
            first = left.groupBy(F.col("page_id").alias("_page"), "_p").agg(F.min("_n").alias("_n"))
            hits = own.join(first, (own["page_id"] == F.col("_page")) & (own["parent_id"] == F.col("_p")) & (F.col("_n") < own["node_id"]), "left_semi")
        found = hits.select("page_id", "node_id", "parent_id")
    return found.select("page_id", "node_id")


def specificity(chain: Chain) -> tuple[int, int, int, int]:
    """(0, ids, classes with attributes and pseudo-classes, tags), which compare as tuples do."""
    parts = [chain.first, *(s for _, s in chain.rest)]
    return (
        0, sum(bool(p.id) for p in parts), sum(len(p.classes) + len(p.attrs) + len(p.pseudo) + len(p.none_of) + bool(p.any_of) for p in parts),
        sum(p.tag not in ("", "*") for p in parts),
    )


def cascade(elements: DataFrame, rules: list[tuple[Chain, str, str, bool]]) -> DataFrame:
    """page_id, node_id, property, value: of the rules (chain, property, value, important) that match, the important, most specific, last one wins.

    All rules without combinators are tested in one pass over the elements; only the others are joins. No rules give no rows.
    """
    def entry(k: int) -> Column:
        chain, name, value, important = rules[k]
        weight = F.struct(F.lit(int(important)).alias("i"), *[F.lit(x).alias(f"s{j}") for j, x in enumerate(specificity(chain))], F.lit(k).alias("k"))
        return F.struct(F.lit(name).alias("property"), F.lit(value).alias("value"), weight.alias("weight"))

    single = [F.when(simple_test(chain.first), entry(k)) for k, (chain, *_) in enumerate(rules) if not chain.rest]
    every = elements.select("page_id", "node_id", F.explode(F.array_compact(F.array(*single))).alias("e")) if single else None
    # Rules of one chain share its joins.
    chains: dict[Chain, list[int]] = {}
    for k, (chain, *_) in enumerate(rules):
        if chain.rest:
            chains.setdefault(chain, []).append(k)
    for chain, own in chains.items():
        hits = select(elements, chain).select("page_id", "node_id", F.explode(F.array(*[entry(k) for k in own])).alias("e"))
        every = hits if every is None else every.unionByName(hits)
    if every is None:
        return elements.sparkSession.createDataFrame([], elements.select("page_id", "node_id").schema.add("property", "string").add("value", "string"))
    return every.select("page_id", "node_id", "e.*").groupBy("page_id", "node_id", "property").agg(F.max_by("value", "weight").alias("value"))


_TOKEN = re.compile(r"""\s*(?P<comma>,)\s*|\s*(?P<mark>[>+~])\s*|(?P<space>\s+)|(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<bare>[^\]\s]*))\s*)?\]|::?(?P<pseudo>[\w-]+)(?P<open>\()?""", re.X)


def parse_selectors(text: str) -> list[Chain]:
    """The chains of a selector list such as ``ul > li.new, a[href^='/']``. Raises ValueError for what it cannot read."""
    chains, at = [], 0
    links: list[tuple[str, Simple]] = []
    one, wait, text = Simple(), " ", text.strip()
    fresh = True  # nothing read of the simple selector that comes next

    def close() -> None:
        nonlocal one, fresh
        if fresh:
            raise ValueError(f"a selector is missing in {text!r}")
        links.append((wait, one))
        one, fresh = Simple(), True

    def chain() -> Chain:
        return Chain(links[0][1], tuple(links[1:]))

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["comma"]:
            close()
            chains.append(chain())
            links, wait = [], " "
            continue
        if m["mark"] or m["space"]:
            close()
            wait = m["mark"] or " "
            continue
        fresh = False
        if m["tag"]:
            one = replace(one, tag=m["tag"].lower())
        elif m["id"]:
            one = replace(one, id=m["id"])
        elif m["cls"]:
            one = replace(one, classes=(*one.classes, m["cls"]))
        elif m["attr"]:
            value = next((m[g] for g in ("q", "a", "bare") if m[g] is not None), "")
            one = replace(one, attrs=(*one.attrs, (m["attr"].lower(), m["op"] or "", value)))
        else:
            name, inner = m["pseudo"].lower(), ""
            if m["open"]:
                depth, start = 1, at
                while at < len(text) and depth:
                    depth += (text[at] == "(") - (text[at] == ")")
                    at += 1
                if depth:
                    raise ValueError(f"a bracket is open in {text!r}")
                inner = text[start : at - 1].strip()
            if name in ("not", "is", "where"):
                parts = parse_selectors(inner)
                if any(p.rest for p in parts):
                    raise ValueError(f"no combinators inside :{name}()")
                simples = tuple(p.first for p in parts)
                one = replace(one, none_of=(*one.none_of, *simples)) if name == "not" else replace(one, any_of=(*one.any_of, *simples))
            else:
                one = replace(one, pseudo=(*one.pseudo, f"{name}({inner})" if m["open"] else name))
    close()
    return [*chains, chain()]
