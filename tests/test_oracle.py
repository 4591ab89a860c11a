"""Every query with oracle SQL against DuckDB; the others against brute force."""

import datetime
import math
import re
from collections import Counter

import duckdb
import pytest

from docloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, db, name):
    got = QUERIES[name](spark, data)
    cur = db.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    want = Counter(tuple(_plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    have = Counter(tuple(_plain(r[c]) for c in order) for r in got.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


def _bins(sizes, width):
    n, used = 0, None
    for s in sizes:
        if used is None or used + 1 + s > width:
            n, used = n + 1, s
        else:
            used += 1 + s
    return n


def test_word_wrap(spark, data, db):
    got = {r["doc_id"]: r["n_lines"] for r in QUERIES["word_wrap"](spark, data).collect()}
    for i, text in db.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        assert got[i] == sum(max(1, _bins([len(w) for w in re.findall(r"[^ \t]+", line)], 80)) for line in text.split("\n"))


def test_dom(spark, data):
    rows = QUERIES["dom_nodes"](spark, data).collect()
    links = Counter(r["page_id"] for r in rows if r["tag"] == "a")
    by = {(r["page_id"], r["node_id"]): r for r in rows}
    for r in rows:
        if r["parent_id"] >= 0:
            up = by[r["page_id"], r["parent_id"]]
            assert up["depth"] == r["depth"] - 1 and up["node_id"] < r["node_id"] <= up["last_id"]
    hits = QUERIES["selector_match"](spark, data).collect()
    assert hits and all(by[h["page_id"], h["ancestor_id"]]["tag"] == "nav" for h in hits) and len(hits) <= sum(links.values())
    text = {(r["page_id"], r["tag"]): r["text"] for r in QUERIES["dom_text"](spark, data).collect() if r["tag"] in ("title", "h1")}
    assert all(text[p, "title"] for p, _ in text)


def test_text_and_selectors_of_pages(spark, data):
    rows = QUERIES["dom_nodes"](spark, data).collect()
    by = {(r["page_id"], r["node_id"]): r for r in rows}
    want = {}
    for r in sorted(rows, key=lambda r: (r["page_id"], r["node_id"])):
        if r["tag"] == "" and not r["hidden"]:
            for a in r["ancestors"]:
                want[r["page_id"], a] = want.get((r["page_id"], a), "") + r["text"]
    got = {(r["page_id"], r["node_id"]): r["text"] for r in QUERIES["dom_text"](spark, data).collect()}
    assert got == want
    tag = lambda r: r["tag"]
    up = lambda r: by.get((r["page_id"], r["parent_id"]))
    elements = [r for r in rows if r["tag"]]
    above = lambda r: [by[r["page_id"], a] for a in r["ancestors"]]
    before = lambda r: [o for o in elements if o["page_id"] == r["page_id"] and o["parent_id"] == r["parent_id"] and o["node_id"] < r["node_id"]]
    tests = {
        "nav a": lambda r: tag(r) == "a" and any(tag(a) == "nav" for a in above(r)), "ul > li": lambda r: tag(r) == "li" and up(r) is not None and tag(up(r)) == "ul",
        "li + li": lambda r: tag(r) == "li" and bool(before(r)) and tag(before(r)[-1]) == "li", "h1 ~ p": lambda r: tag(r) == "p" and any(tag(o) == "h1" for o in before(r)),
        "a[href^='/']": lambda r: tag(r) == "a" and (r["attrs"].get("href") or "").startswith("/"), "p:first-of-type": lambda r: tag(r) == "p" and r["parent_id"] >= 0 and not any(tag(o) == "p" for o in before(r)),
    }
    elements.sort(key=lambda r: (r["page_id"], r["node_id"]))
    want = {}
    for name, test in tests.items():
        hits = [r["node_id"] for r in elements if test(r)]
        if hits:
            want[name] = (len(hits), min(hits), sum(hits))
    assert {r["rule"]: (r["n_hits"], r["first_node"], r["sum_nodes"]) for r in QUERIES["selector_pages"](spark, data).collect()} == want
