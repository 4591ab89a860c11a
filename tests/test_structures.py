"""Structures of any depth, folds, grids, files and job streams against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import dom, folds, grids, layout, rects, styles, text, trees
from docloom.operators import selectors as X
from docloom.plans.registry import QUERIES
from docloom.session import spread
from docloom.sources import files
from docloom.streaming import jobs


def _one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i int, a {kind}" if not isinstance(values[0], tuple) else kind)
    return [r["x"] for r in rows.select("i", f.alias("x")).orderBy("i").collect()]


# Values


def test_calc(spark):
    cases = {"10pt + 5pt": "15pt", "1.5pt - 2": "", "3 + 2px": "5px", "1em + 2": "", " 10px - 2px ": "8px", "1px - 1px": "0px", "50% + 1%": "51%", "x + 2px": "2px", "2px": "", "0 + 1px": "1px", None: None}
    assert _one(spark, list(cases), S.simple_calc(F.col("a"))) == list(cases.values())


def test_fit_image(spark):
    rows = [(100.0, 50.0, f) for f in ("contain", " COVER ", "fill", "none", "", None, "odd")] + [(0.0, 50.0, "contain"), (0.0, 50.0, "fill"), (0.0, 50.0, "none")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, w double, h double, f string")
    w, h = S.fit_image(F.col("w"), F.col("h"), F.lit(200.0), F.lit(200.0), F.col("f"))
    got = [(r["w2"], r["h2"]) for r in df.select("i", w.alias("w2"), h.alias("h2")).orderBy("i").collect()]
    fits = (200.0, 100.0)
    assert got == [fits, (400.0, 200.0), (200.0, 200.0), (100.0, 50.0), fits, fits, fits, (None, None), (200.0, 200.0), (0.0, 50.0)]


def test_variables(spark):
    names = F.create_map(*[F.lit(x) for x in ("--a", "1px", "--b", "var(--a) 2px", "--loop", "var(--loop)", "--empty", "")])
    cases = {
        "red": "red", "var(--a)": "1px", " var( --a ) ": " 1px ", "x var(--a) y var(--b)": "x 1px y 1px 2px", "var(--no, 3px)": "3px", "var(--no)": "", "var(--no, var(--a))": "1px",
        "var(--no, rgb(1, 2, 3)) z": "rgb(1, 2, 3) z", "var(--empty, 4px)": "", "var(--no, var(--nope, calc(1px + (2px))))": "calc(1px + (2px))", "var(--loop)": "var(--loop)", None: None,
    }
    assert _one(spark, list(cases), S.css_variable(F.col("a"), names)) == list(cases.values())


def test_colors(spark):
    cases = {
        "red": ([1, 0, 0], 1), " Navy ": ([0, 0, 0.502], 1), "#fff": ([1, 1, 1], 1), "#0f08": ([0, 1, 0], 136 / 255), "#336699": ([0.2, 0.4, 0.6], 1), "#33669980": ([0.2, 0.4, 0.6], 128 / 255), "rgb(255, 0, 51)": ([1, 0, 0.2], 1),
        "rgba(100% 0% 50% / 25%)": ([1, 0, 0.5], 0.25), "rgb(300,-5,x)": ([1, 0, 0], 1), "#12": None, "nocolor": None, "transparent": None, "rgb(1,2)": None, None: None, "#zz0000": ([0, 0, 0], 1), "RGBA(0,0,0,.5)": ([0, 0, 0], 0.5),
    }
    got = _one(spark, list(cases), S.css_color(F.col("a")))
    for g, w in zip(got, cases.values(), strict=True):
        assert (g is None) == (w is None)
        if w:
            assert g["rgb"] == pytest.approx(w[0]) and g["alpha"] == pytest.approx(w[1])


def test_text_transform(spark):
    f = lambda how: S.text_transform(F.col("a"), F.lit(how))
    words = ["it's a-b  éa 1st ßx", "", None]
    assert _one(spark, words, f("capitalize")) == ["It'S A-B  Éa 1st ßx", "", None]
    assert _one(spark, words, f("uppercase"))[0].startswith("IT'S A-B") and _one(spark, words, f("none")) == words


def test_blank_spans_write_nothing(spark):
    spans = spark.createDataFrame([(1, 0.0, 5.0, 10.0, 10.0, False, "ab"), (1, 11.0, 5.0, 10.0, 2.0, False, " "), (1, 18.0, 5.0, 10.0, 10.0, False, "cd"), (2, 0.0, 5.0, 10.0, 0.0, False, "  ")], "page int, x double, y double, size double, width double, bold boolean, text string")
    assert {r["page"]: r["text"] for r in layout.lines(spans).collect()} == {1: "ab cd", 2: ""}


def test_unique_slugs(spark):
    own = ["a", "a-2", "a", "a", "", "section", "a-2"]
    rows = spark.createDataFrame([(d, i, s, "x") for d in (1, None) for i, s in enumerate(own)], "doc int, at int, base string, slug2 string").repartition(3)
    got = text.unique_slugs(rows, "doc", "at", "base").orderBy("doc", "at").collect()
    assert [r["slug"] for r in got] == 2 * ["a", "a-2", "a-3", "a-4", "section", "section-2", "a-2-2"] and {r["slug2"] for r in got} == {"x"}


# Selectors


def test_parse_selectors():
    s, c = X.Simple, X.Chain
    assert X.parse_selectors("ul > li.new, a[href^='/']") == [c(s("ul")).then(">", s("li", classes=("new",))), c(s("a", attrs=(("href", "^=", "/"),)))]
    assert X.parse_selectors(" #x  *+P.a.b~q ") == [c(s(id="x")).then(" ", s("*")).then("+", s("p", classes=("a", "b"))).then("~", s("q"))]
    assert X.parse_selectors("li:nth-child(2):not(.a, #b):is(li,x)") == [c(s("li", pseudo=("nth-child(2)",), none_of=(s(classes=("a",)), s(id="b")), any_of=(s("li"), s("x"))))]
    assert X.parse_selectors('[a] [b="x y"][c~=z]') == [c(s(attrs=(("a", "", ""),))).then(" ", s(attrs=(("b", "=", "x y"), ("c", "~=", "z"))))]
    for bad in ("", ">", "a >", "a,,b", "a:not(", "a:not(b c)", "a{", ", a"):
        with pytest.raises(ValueError):
            X.parse_selectors(bad)


PAGES = [
    (1, "<html lang=en><body><div id=a><p>One <b>two</b> <i>thr<b>ee</b></i><br>four</p><a href='/x'>Link <span>in</span>side</a> tail</div><pre> a  b\n</pre></body></html>"),
    (2, "<table><tr><td>cell <p>para</p><a href='/o'><b>out<a href='/i'>in</b></td><td></td></tr></table><script>no()</script><h1>Head</h1>"),
    (3, ""), (4, None), (5, "just text &amp; more"),
    (6, "<div>" * 70 + "deep" + "</div>" * 70),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return dom.nodes(spark.createDataFrame(PAGES, "page_id long, html string").repartition(2)).cache()


def test_cascade_of_many_rules(spark, nodes):
    elements = X.with_siblings(nodes).cache()
    assert X.cascade(elements, []).collect() == [] and X.cascade(elements, []).columns == ["page_id", "node_id", "property", "value"]
    sheet = [("*", "p1", "any", False), ("b", "p1", "bold", False), ("i b", "p1", "inner", False), ("div b", "p1", "important", True), ("b", "p2", "x", False), ("div b", "p2", "y", False), ("p > b", "p2", "z", False)]
    rules = [(c, *rest) for t, *rest in sheet for c in X.parse_selectors(t)]
    got = {(r["page_id"], r["node_id"], r["property"]): r["value"] for r in X.cascade(elements, rules).collect()}
    want = {}
    for k, (chain, name, value, important) in enumerate(rules):
        for r in X.select(elements, chain).collect():
            key, rank = (r["page_id"], r["node_id"], name), (important, X.specificity(chain), k)
            if key not in want or rank > want[key][0]:
                want[key] = (rank, value)
    assert got == {k: v for k, (_, v) in want.items()} and len(got) > 20


def test_links_read_what_a_parser_reads(spark):
    html = [
        '<a href="/a">x</a><A HREF=\'/b\'><a class="x>y" href = /c id=1></a><a\nhref="/d&amp;e"/>', "<!-- <a href='/no'> --><script>'<a href=\"/no\">'</script><a data-href='/no'>t</a><abbr href='/no'>", "<a>none</a><a href=''>empty</a><a href>",
        "<style>a</style><a title='a > b' href=\"it's\">", None, "", "<a href='/open", '<a x="1"href="/tight">',
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = [(r["page_id"], r["seq"], r["href"]) for r in dom.links(pages).orderBy("page_id", "seq").collect()]
    want = [(0, "/a"), (0, "/b"), (0, "/c"), (0, "/d&e"), (2, ""), (3, "it's"), (7, "/tight")]
    assert [(p, h) for p, _, h in got] == want and [s for p, s, _ in got if p == 0] == [1, 2, 3, 4]


# Trees


def _plain_styles(rows, declared):
    """font_size, color, weight of each node, from the root down."""
    by = {(r["page_id"], r["node_id"]): r for r in rows}
    out = {}
    for key in sorted(by):
        r = by[key]
        up = out.get((r["page_id"], r["parent_id"]), {"size": 12.0, "color": (0.2, 0.2, 0.2), "weight": 400, "spacing": 0.0, "height": 1.5, "space": "normal"})
        own = dict(up)
        own["size"] = {"h1": 24.0}.get(r["tag"], up["size"])
        own["weight"] = 700 if r["tag"] in ("b", "h1") else up["weight"]
        own["color"] = (0.067, 0.333, 0.8) if r["tag"] == "a" else up["color"]
        own["space"] = "pre" if r["tag"] == "pre" else up["space"]
        for name, value in declared.get(key, {}).items():
            if name == "font-size":
                own["size"] = float(value[:-2]) * up["size"] if value.endswith("em") else float(value[:-1]) / 100 * up["size"] if value.endswith("%") else float(value[:-2])
            elif name == "letter-spacing":
                own["spacing"] = float(value[:-2]) * up["size"]
        if "line-height" in declared.get(key, {}):
            own["height"] = float(declared[key]["line-height"][:-2]) / own["size"]
        out[key] = own
    return out


def test_computed_styles(spark, nodes):
    rng = random.Random(2)
    rows = nodes.collect()
    declared: dict = {}
    for r in rows:
        if r["tag"] and rng.random() < 0.5:
            choice = {"font-size": rng.choice(["1.5em", "80%", "9pt", "2em"]), "letter-spacing": rng.choice(["0.5em", "2em"]), "line-height": rng.choice(["30pt", "12pt"])}
            declared[r["page_id"], r["node_id"]] = {k: v for k, v in choice.items() if rng.random() < 0.5}
    flat = [(p, n, k, v) for (p, n), own in declared.items() for k, v in own.items()] + [(1, 2, "color", "no colour"), (1, 2, "margin", "3px"), (1, 2, "--v", "1"), (1, 3, "display", "var(--v, x)"), (1, 3, "text-align", "var(--w, right)")]
    got = styles.computed(nodes, spark.createDataFrame(flat, "page_id long, node_id int, property string, value string")).collect()
    want = _plain_styles(rows, declared)
    assert len(got) == len(rows) == len(want)
    for r in got:
        w = want[r["page_id"], r["node_id"]]
        assert (r["font_size"], r["letter_spacing"], r["line_height"]) == pytest.approx((w["size"], w["spacing"], w["height"])), (r, w)
        assert r["color"] == list(w["color"]) and r["font_weight"] == w["weight"] and r["white_space"] == w["space"]
    at = {(r["page_id"], r["node_id"]): r for r in got}
    assert at[1, 2]["other"] == {"margin": "3px"} and at[1, 3]["display"] == "1" and at[1, 3]["text_align"] == "right"
    assert {r["font_size"] for r in styles.computed(nodes).filter("page_id = 6").collect()} == {12.0}


def test_text_runs(spark, nodes):
    got = styles.text_runs(nodes, styles.computed(nodes)).orderBy("page_id", "block", "run").collect()
    runs = [(r["page_id"], r["text"], bool(r["bold"]), bool(r["italic"]), r["link"]) for r in got]
    by_page = {p: [r[1:] for r in runs if r[0] == p] for p in (1, 2, 5, 6)}
    assert ("Link inside", False, False, "/x") in by_page[1] and (" tail", False, False, "") in by_page[1] and (" a  b\n", False, False, "") in by_page[1]
    assert [t for t, b, i, _ in by_page[1] if (b, i) == (True, True)] == ["ee"] and ("\n", False, False, None) in by_page[1]
    assert by_page[2][0] == ("cell para", False, False, "") and ("Head", True, False, "") in by_page[2] and not any("no()" in r[0] for r in by_page[2])
    assert by_page[5] == [("just text & more", False, False, "")] and by_page[6] == [("deep", False, False, "")]


def test_trees(spark):
    rng = random.Random(4)
    rows = []
    for g in ("x", "y"):
        for n in range(120):
            parent = None if n == 0 else n - 1 if n < 70 else rng.randrange(n) if rng.random() < 0.9 else 10_000 + n
            rows.append((g, n, parent, f"v{g}{n}" if rng.random() < 0.1 else None))
    tree = spark.createDataFrame(rows, "g string, n int, up int, v string").repartition(3)
    by = {(g, n): (up, v) for g, n, up, v in rows}

    def walk(g, n):
        while (g, n) in by:
            yield n
            n = by[g, n][0]

    near = {(r["g"], r["n"]): r["v"] for r in trees.nearest(tree, ["g"], "n", "up", "v").collect()}
    assert near == {k: next((by[k[0], a][1] for a in walk(*k) if by[k[0], a][1]), None) for k in by}
    below = Counter((g, a) for g, n in by for a in walk(g, n))
    got = {(r["g"], r["n"]): (r["descendants"], r["depth"]) for r in trees.descendants(tree, ["g"], "n", "up").collect()}
    assert got == {k: (below[k] - 1, len(list(walk(*k))) - 1) for k in by}
    loop = spark.createDataFrame([("x", 1, 2, None), ("x", 2, 3, None), ("x", 3, 1, None), ("x", 4, None, "r")], "g string, n int, up int, v string")
    for f in (lambda: trees.nearest(loop, ["g"], "n", "up", "v"), lambda: trees.descendants(loop, ["g"], "n", "up")):
        with pytest.raises(ValueError, match="cycle"):
            f()
    assert trees.nearest(tree.limit(0), ["g"], "n", "up", "v").collect() == [] and trees.descendants(tree.limit(0), ["g"], "n", "up").collect() == []


def test_reachable(spark):
    edges = spark.createDataFrame([(f, i, i + 1) for f in (1, 2) for i in range(30)] + [(1, 5, 0), (1, 3, 3), (1, 2, 9), (1, 2, 9)], "f int, src int, dst int")
    starts = spark.createDataFrame([(1, 0), (2, 28), (3, 7)], "f int, node int")
    got = {(r["f"], r["node"]): r["depth"] for r in trees.reachable(edges, starts, ["f"], 4).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 9): 3, (1, 4): 4, (1, 10): 4, (2, 28): 0, (2, 29): 1, (2, 30): 2, (3, 7): 0}
    objects = spark.createDataFrame([(1, 4, ["SMask"]), (1, 9, ["SMask"]), (1, 20, ["SMask"]), (2, 30, []), (3, 8, ["SMask"])], "f int, node int, keys array<string>")
    hit = trees.with_key(objects, edges, starts, ["f"], F.array_contains("keys", "SMask"), 4).collect()
    assert [(r["f"], r["node"], r["depth"]) for r in hit] == [(1, 9, 3)]


def test_imports(spark):
    sheets = spark.createDataFrame([
        ("http://h/a.css", "top\n@import 'b.css';\nmid\n@import url(\"sub/c.css\");\n@import 'gone.css';\nend"), ("http://h/b.css", "b1\n@import '/a.css'\nb2"), ("http://h/sub/c.css", "@import '../b.css';\n@import url(c.css);\nc"), ("http://h/e.css", ""),
    ], "url string, css string")
    got = {r["url"]: r["css"] for r in trees.resolved_css(sheets, sheets.select("url")).collect()}
    b = "b1\nb2\n"
    assert got["http://h/a.css"] == "top\n" + b + "\nmid\n" + b + "\nc\n\nend\n" and got["http://h/e.css"] == "\n"
    assert got["http://h/b.css"] == "b1\ntop\nmid\nc\n\nend\n\nb2\n"


# Folds and grids


def test_fold_sorted_keeps_groups_apart(spark):
    rows = spark.createDataFrame([(k, i, i * 2) for k in (1, 2, None) for i in range(5000)], "k int, i int, v int").repartition(4)
    got = folds.fold_sorted(rows, ["k"], ["i"], lambda: [0], lambda s, k, i, v: [(k, i, s.__setitem__(0, s[0] + v) or s[0])] if i % 1000 == 999 else s.__setitem__(0, s[0] + v) or [], "k int, i int, total long").collect()
    assert Counter((r["k"], r["i"], r["total"]) for r in got) == Counter((k, i, i * (i + 1)) for k in (1, 2, None) for i in range(999, 5000, 1000))


def test_cells_fill_the_grid(spark):
    rng = random.Random(3)
    cells = [(1, t, r, r * 100 + c, rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4]), False, "x") for t in range(12) for r in range(6) for c in range(rng.randrange(4))]
    df = spark.createDataFrame(cells, "page_id long, table_id int, row int, node_id int, colspan int, rowspan int, header boolean, text string").repartition(3)
    got = {(r["table_id"], r["row"], r["flow_col"]): r["col"] for r in grids.place(df).collect()}
    used: set = set()
    flow: Counter = Counter()
    for _, t, r, _, w, h, _, _ in cells:
        col = next(c for c in range(1000) if not any((t, r, c + j) in used for j in range(w)))
        used |= {(t, r + i, col + j) for i in range(h) for j in range(w)}
        assert got[t, r, flow[t, r]] == col
        flow[t, r] += w
    html = "<table><tr><td colspan=x rowspan='2'>a<table><tr><td>in</table><th>b<tbody><tr><td>c</td></tr></tbody><thead><tr><td colspan=2>h</thead></table>"
    rows = grids.table_cells(dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()
    outer = min(r["table_id"] for r in rows)
    assert {(r["row"], r["col"], r["text"], r["header"]) for r in rows if r["table_id"] == outer} == {(0, 0, "h", True), (1, 0, "ain", False), (1, 1, "b", True), (2, 1, "c", False)}
    assert [r["text"] for r in rows if r["table_id"] != outer] == ["in"]


def test_cells_of_few_columns_in_one_shuffle(spark, capsys):
    html = "<table><tr></tr><tbody><tr><td>a<td colspan=2>b &amp; <i>c</i></tr></tbody><tfoot><tr><th rowspan=3>f<table><tr><td>g</table></tfoot><div><tr><td>lost</div></table><tr><td>out"
    pages = spark.createDataFrame([(p, html) for p in range(50)], "page_id long, html string").repartition(3)
    few = grids.table_cells(dom.nodes(pages, grids.CELL_COLUMNS, grids.CELL_TAGS))
    few.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    rows = sorted(tuple(r) for r in few.collect())
    assert rows == sorted(tuple(r) for r in grids.table_cells(dom.nodes(pages)).collect())
    assert [r[2:] for r in rows if r[0] == 7] == [(1, 0, 0, 1, 1, False, "a"), (1, 1, 1, 2, 1, False, "b & c"), (2, 0, 0, 1, 3, True, "fg"), (0, 0, 0, 1, 1, False, "g")]


def test_plain_markup_is_read_as_by_the_parser(monkeypatch):
    pages = [h for _, h in PAGES if h] + ["<td class='a b' id=x href=\"/y\" class=z>t</td>", "<TD>a</TD>", "a < b", "<p>x<p>y</div>", "<br/><img src=a>", "<a href=/x/>z</a>", "a & b <i>&lt;</i>", "<p\n a=1>\n </p> <b> </b>", "<!-- <p> --><p>", "<title><b></title>", "<p a=1b=2 c>", "<a\tb='>'>"]
    fast = [dom._Nodes().read(h) for h in pages]
    monkeypatch.setattr(dom._Nodes, "_read_plain", lambda self, html: False)
    assert fast == [dom._Nodes().read(h) for h in pages]


def test_table_widths(spark):
    col = lambda least, wanted, weight: (float(least), float(wanted), float(weight))
    cases = [
        ([col(10, 20, 1), col(10, 20, 0.05)], 100.0, [20 + 60 / 1.05, 20 + 3 / 1.05]), ([col(60, 80, 1), col(30, 40, 1)], 45.0, [30, 15]), ([col(10, 60, 1), col(10, 30, 0.5)], 50.0, [10 + 30 * 50 / 60, 10 + 30 * 10 / 60]),
        ([col(10, 5, 1)], 30.0, [30]), ([col(10, 60, 0), col(10, 60, 0)], 50.0, [25, 25]), ([col(1, 2, 0), col(1, 4, 0)], 10.0, [4, 6]), ([col(1, 2, 1)], 0.0, [0]),
    ]
    rows = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(cases)], "i int, c array<struct<least:double,wanted:double,weight:double>>, t double")
    for r in rows.select("i", S.table_widths(F.col("c"), F.col("t")).alias("w")).collect():
        assert r["w"] == pytest.approx(cases[r["i"]][2])


def test_contents(spark):
    levels = [2, 3, 1, 3, 3, 2, 4, 1]
    heads = spark.createDataFrame([("d", i, v, f"T<{i}>", f"s{i}") for i, v in enumerate(levels)], "doc string, at int, level int, text string, slug string").repartition(2)
    rows = grids.toc(heads, "doc", "at")
    assert [(r["at"], r["parent"], r["number"]) for r in rows.orderBy("at").collect()] == [(0, None, "1"), (1, 0, "1.1"), (2, None, "2"), (3, 2, "2.1"), (4, 2, "2.2"), (5, 2, "2.3"), (7, None, "3")]
    got = grids.toc_html(rows, "doc", "at").first()
    li = lambda i: f'<a href="#s{i}">T&lt;{i}&gt;</a>'
    assert got["flat"].count("<li class=") == 7 and f'<li class="toc-l3">{li(1)}</li>' in got["flat"]
    assert got["nested"].endswith(f"<ol><li>{li(0)}<ol><li>{li(1)}</li></ol></li><li>{li(2)}<ol><li>{li(3)}</li><li>{li(4)}</li><li>{li(5)}</li></ol></li><li>{li(7)}</li></ol></nav>")


def test_points_in_rectangles(spark):
    rng = random.Random(6)
    side = lambda: rng.choice([0.0, 0.3, 5.0, 40.0, 1000.0]) * rng.random()
    boxes = []
    for i in range(150):
        x, y = rng.uniform(-50, 500), rng.uniform(-50, 500)
        boxes.append((i % 3, i, x + side(), y, x, y + side(), f"u{i}"))
    spots = [(i % 3, rng.uniform(-60, 600), rng.uniform(-60, 600)) for i in range(300)] + [(0, boxes[0][2] - 2.0, boxes[0][3] - 2.0), (0, None, 1.0), (0, float("nan"), 1.0)]
    links = spark.createDataFrame([*boxes, (0, 999, None, 0.0, 1.0, 1.0, "no")], "page int, link int, x0 double, y0 double, x1 double, y1 double, url string")
    got = {(r["page"], r["x"], r["y"]): r["url"] for r in rects.link_map(spark.createDataFrame(spots, "page int, x double, y double"), links, "page").collect()}
    want = {}
    for p, x, y in spots:
        for q, _, x0, y0, x1, y1, u in boxes:
            if x is not None and p == q and min(x0, x1) - 2 <= x <= max(x0, x1) + 2 and min(y0, y1) - 2 <= y <= max(y0, y1) + 2:
                want[p, x, y] = u
    assert got == want and len(got) > 30


# Files and streams


def test_inputs(spark, tmp_path):
    for name in ("b.pdf", "a.PNG", "skip.txt", "c.jpg"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"")
    here = str(tmp_path)
    assert {r["name"]: r["length"] for r in files.listing(spark, here).collect()} == {"b.pdf": 5, "a.PNG": 5, "skip.txt": 8, "c.jpg": 5}
    inputs = [files.Input(path="sub/d.pdf"), files.Input(directory=".", sequence=["c.jpg", "b.pdf"]), files.Input(directory="./", include=["?.p*"]), files.Input(directory=".")]
    got = [(r["place"], r["path"].rsplit("/", 1)[-1], r["kind"]) for r in files.expand_inputs(spark, inputs, here).collect()]
    assert got == [(0, "d.pdf", "pdf"), (1, "c.jpg", "image"), (1, "b.pdf", "pdf"), (2, "a.PNG", "image"), (2, "b.pdf", "pdf"), (3, "a.PNG", "image"), (3, "b.pdf", "pdf"), (3, "c.jpg", "image")]
    for bad in (files.Input(), files.Input(path="x.pdf", directory="."), files.Input(directory=".", sort="size")):
        with pytest.raises(ValueError):
            files.expand_inputs(spark, [bad], here)
    with pytest.raises(PySparkException, match="unknown type"):
        files.expand_inputs(spark, [files.Input(path="x.txt")], here).collect()
    assert files.expand_inputs(spark, []).collect() == []


def test_job_stream_with_late_and_expired_jobs(spark, tmp_path):
    minute = 60_000_000
    kinds = ["click", "error", "purchase"]
    rng = random.Random(1)
    batches, rows, n = [], [], 0
    for k in range(5):
        own = []
        for _ in range(60):
            own.append((n, k * 40 * minute + rng.randrange(40 * minute), rng.randrange(8), kinds[n % 3]))
            n += 1
        own += [(10_000 + k, (k + 1) * 40 * minute - 1, 99, "click")]  # brings the watermark to where the batch ends
        batches.append(own)
        rows += own
    late = [(20_000 + k, k * 40 * minute - 15 * minute, 3, "error") for k in range(1, 5)]  # behind the watermark of the batch before
    end = [(30_000, 400 * minute, 99, "click")]
    schema = "event_id long, us long, user_id long, event_type string"
    as_events = lambda r: spark.createDataFrame(r, schema).select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type")
    path = f"{tmp_path}/in"
    for k, own in enumerate([*batches, end]):
        own = own + ([late[k - 1]] if 1 <= k <= 4 else [])
        rng.shuffle(own)
        as_events(own).coalesce(1).write.mode("append").parquet(path)
    got = jobs.finished_jobs(spark, path, str(tmp_path), files_each=1)
    want = jobs.jobs(as_events(rows + end)).filter(F.unix_micros("expires") < 390 * minute)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 20
    assert jobs.jobs(as_events(rows).limit(0)).collect() == []


def test_page_queries(spark, data):
    computed = {(r["page_id"], r["node_id"]): r for r in QUERIES["page_styles"](spark, data).collect()}
    nodes = QUERIES["dom_nodes"](spark, data).collect()
    assert len(computed) == len(nodes)
    tags = {(r["page_id"], r["node_id"]): r["tag"] for r in nodes}
    for r in nodes:
        s, above = computed[r["page_id"], r["node_id"]], [tags[r["page_id"], a] for a in r["ancestors"]]
        if r["tag"] == "a" and "nav" in above:
            assert s["color"] == [0.0, 0.502, 0.502]
        if r["tag"] == "" and "h1" not in above and "p" not in above and "body" in above:
            assert s["font_size"] == 10.0
        if r["tag"] == "p" and "article" in above and "h1" not in above:
            assert s["font_size"] == 12.5 ** (above.count("p") + 1) / 10 ** above.count("p")
    runs = QUERIES["page_runs"](spark, data).collect()
    shown = Counter()
    for r in nodes:
        if r["tag"] == "" and not r["hidden"] and r["text"].strip():
            shown[r["page_id"]] += len(re.sub(r"\s", "", r["text"]))
    assert Counter({p: sum(len(re.sub(r"\s", "", r["text"])) for r in runs if r["page_id"] == p) for p in shown}) == shown


def test_growing_tables_are_not_broadcast(spark):
    """Rows that repeat each other: a file of a few kB, whose joins would send every row to the driver."""
    rows = spark.range(200_000).select((F.col("id") % 1000).alias("page_id"), F.lit("block").alias("display"))
    kept = spread(rows, "repeated")
    joined = spark.range(1000).withColumnRenamed("id", "page_id").repartition(2).join(kept.filter("display = 'block'").select("page_id"), "page_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    climbed = trees.climb(spark.range(1000).select(F.lit(1).alias("g"), "id", (F.col("id") - 1).alias("up")), ["g"], "id", "up", {"v": F.col("id")}, lambda own, up: {"v": up["v"]})
    assert "BroadcastHashJoin" not in climbed.join(climbed.withColumnRenamed("v", "w"), ["g", "id"])._jdf.queryExecution().executedPlan().toString()


def test_thick_links_are_met_last_first(spark):
    """Links one over the other: of 20,000 pairs a place looks at a part, and all rounds count."""
    r = random.Random(7)
    links = [(k % 2, k, (x := r.uniform(0, 40)), y, x + 9, y + r.choice([3, 9]), f"u{k}") for k, y in enumerate(r.uniform(0, 40) for _ in range(2000))]
    links += [(2, k, 100.0, 100.0, 100.0 + 30 / (k + 1), 130.0, f"v{k}") for k in range(300)]  # the last ones are too narrow: later rounds find the first
    spots = [(k % 2, r.uniform(-5, 50), r.uniform(-5, 50)) for k in range(300)] + [(2, 129.0, 115.0), (2, 110.0, 110.0), (2, 115.0, 96.0), (2, 107.0, 129.0)]
    got = {(a, x, y): u for a, x, y, u in rects.link_map(spark.createDataFrame(spots, "page int, x double, y double"), spark.createDataFrame(links, "page int, link int, x0 double, y0 double, x1 double, y1 double, url string"), "page").collect()}
    hit = lambda s, b: s[0] == b[0] and b[2] - 2 <= s[1] <= b[4] + 2 and b[3] - 2 <= s[2] <= b[5] + 2
    assert got == {s: max((b for b in links if hit(s, b)), key=lambda b: b[1])[6] for s in spots if any(hit(s, b) for b in links)}
    seen = rects.hits(spark.createDataFrame([(0, 20.0, 20.0)], "page int, x double, y double"), spark.createDataFrame(links[:10], "page int, rect int, x0 double, y0 double, x1 double, y1 double, url string"), "page")
    assert seen.count() == sum(hit((0, 20.0, 20.0), b) for b in links[:10])
    assert "_nth" not in seen.columns and rects.FIRST_LINKS < 300


def test_imports_are_joined_in_chunks(spark):
    """A sheet of many lines between imports: no task gathers every line of a root."""
    lines = [f".c{k} {{}}" for k in range(25_000)]
    css = "\n".join([*lines[:100], '@import "b.css";', *lines[100:]])
    sheets = spark.createDataFrame([("http://h.org/a.css", css), ("http://h.org/b.css", "b1\nb2")], "url string, css string")
    out = trees.resolved_css(sheets, sheets.select("url"))
    assert {r["url"]: r["css"] for r in out.collect()} == {"http://h.org/a.css": "\n".join([*lines[:100], "b1", "b2", "", *lines[100:], ""]), "http://h.org/b.css": "b1\nb2\n"}
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
