"""Inline Markdown, exported pages, named parts, objects, wrapped text and tables on pages, on small cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import compliance, dom, exports, flow, graphics, markdown, objects, pages, sheets, text
from docloom.operators import layout as L
from docloom.operators import selectors as X


def _values(spark, values, f):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string").select("i", f.alias("x")).orderBy("i").collect()]


def test_inline_markdown(spark):
    defined = text.definitions(F.lit('[Home]: http://h.org/?a&b "T"\n[two]: <x>\n[HOME]: /last'))
    refs = markdown.references(defined["links"])
    cases = {
        "a [x][home] [Two][] [no][y]": ('a <a href="/last">x</a> <a href="x">Two</a> [no][y]', "a x (/last) Two (x) no"), "**b** _i_ `c*d*` ~~s~~": ("<strong>b</strong> <em>i</em> <code>c<em>d</em></code> <del>s</del>", "b i cd s"),
        "![i](a.png) [l](u)[^1]": ('<img src="a.png" alt="i" loading="lazy"> <a href="u">l</a><sup id="fnref-1"><a href="#fn-1">1</a></sup>', "i l (u)1"), "<https://h.org> & 'q'": ('<a href="https://h.org">https://h.org</a> &amp; &#39;q&#39;', "<https://h.org> & 'q'"),
        "one  \ntwo": ("one<br>two", "one  \ntwo"), "": ("", ""), None: (None, None),
    }
    assert _values(spark, list(cases), markdown.inline_html(F.col("a"), refs)) == [h for h, _ in cases.values()]
    assert _values(spark, list(cases), markdown.inline_plain(F.col("a"), refs)) == [p for _, p in cases.values()]
    assert _values(spark, ["[x][home]"], markdown.inline_html(F.col("a"))) == ["[x][home]"]


SPANS = "page int, x double, y double, size double, width double, bold boolean, text string, italic boolean, font string, color array<double>"


def test_page_and_document_html(spark):
    black = [0.0, 0.0, 0.0]
    spans = [(1, 10.0, 800.0, 24.0, 40.0, True, "Head & co", False, "", black), (1, 10.0, 760.0, 10.0, 20.0, False, "left", True, "ABC+Arial", [1.0, 0.0, 0.0]), (1, 80.0, 760.0, 10.0, 0.0, False, "right", False, None, black)]
    spans += [(1, x, 700.0 - 12 * r, 10.0, 10.0, False, f"r{r}c{c}", False, "", black) for r in range(3) for c, x in enumerate((10.0, 60.0))] + [(1, 10.0, 600.0, 10.0, 10.0, False, "end", False, "", black)]
    links = spark.createDataFrame([(1, 1, 9.0, 759.0, 11.0, 761.0, "http://h.org/?a&b")], "page int, link int, x0 double, y0 double, x1 double, y1 double, url string")
    html = exports.page_html(spark.createDataFrame(spans, SPANS).repartition(3), links).first()["html"]
    plain = lambda t, css="font-size:10.0px": f'<span style="{css}">{t}</span>'
    assert html == (
        '<h1 style="margin:0"><span style="font-size:24.0px;font-weight:bold">Head &amp; co</span></h1>\n'
        '<div class="line" style="margin-top:6px"><a href="http://h.org/?a&amp;b">' + plain("left", "font-size:10.0px;font-family:Helvetica, Arial, sans-serif;font-style:italic;color:rgb(255,0,0)") + "</a>" + plain("right", "font-size:10.0px;margin-left:50px") + "</div>\n"
        "<table>\n<tr><th>" + plain("r0c0") + "</th><th>" + plain("r0c1") + "</th></tr>\n<tr><td>" + plain("r1c0") + "</td><td>" + plain("r1c1") + "</td></tr>\n<tr><td>" + plain("r2c0") + "</td><td>" + plain("r2c1") + "</td></tr>\n</table>\n"
        '<div class="line" style="margin-top:40px">' + plain("end") + "</div>\n"
    )
    assert html.index("Head &amp; co") < html.index("<table>") < html.index("end") and html.count("<table>") == 1
    both = spark.createDataFrame([("d", 2, "<p>b</p>\n"), ("d", 1, "<p>a</p>\n"), ("e", 1, "")], "doc string, n int, html string")
    about = spark.createDataFrame([("d", "A < B", "Me")], "doc string, title string, author string")
    got = {r["doc"]: r["html"] for r in exports.document_html(both, "doc", "n", about).collect()}
    assert "<title>A &lt; B</title>" in got["d"] and 'content="Me"' in got["d"] and got["d"].index("<p>a</p>") < got["d"].index("page-break\"></div>") < got["d"].index("<p>b</p>") and "<title>Document</title>" in got["e"]


def test_pages_by_configuration(spark):
    rows = spark.createDataFrame([("a", p, f"a{p}") for p in (1, 2, 3)] + [("b", 1, "b1")], "doc string, page int, text string")
    outputs = lambda *o: spark.createDataFrame(list(o), "doc string, output string, spec string")
    got = pages.split_named(rows, outputs(("a", "x", "3,1-2"), ("a", "y", ""), ("b", "z", " "))).orderBy("output", "new_page").collect()
    assert [(r["output"], r["new_page"], r["text"]) for r in got] == [("x", 1, "a3"), ("x", 2, "a1"), ("x", 3, "a2"), ("y", 1, "a1"), ("y", 2, "a2"), ("y", 3, "a3"), ("z", 1, "b1")]
    for bad, said in ((("a", "x", "3-1"), "invalid page spec"), (("b", "x", "2"), "out of range"), (("a", " ", "1"), "path is empty")):
        with pytest.raises(PySparkException, match=said):
            pages.split_named(rows, outputs(bad)).collect()
    with pytest.raises(PySparkException, match="no pages remain"):
        pages.keep_some(rows, [1]).collect()
    assert pages.keep_some(rows, [3]).count() == 3 and pages.checked(rows, [1]).count() == 4
    with pytest.raises(PySparkException, match="out of range"):
        pages.checked(rows, [2]).collect()
    turned = pages.rotate(pages.rotate(rows, 450), 180, [2])
    assert {(r["doc"], r["page"]): r["rotation"] for r in turned.collect()} == {("a", 1): 90, ("a", 2): 180, ("a", 3): 90, ("b", 1): 90}
    info = spark.createDataFrame([({"/Root": "x", "/Encrypt": "secret", "plain": "y"},)], "m map<string,string>")
    assert info.select(pages.page_map(F.col("m")).alias("m")).first()["m"] == {"Root": "x", "Encrypt": "present", "plain": "y"}


def test_annotations(spark):
    rows = [(1, 1, 2, 1, 0, {"/Subtype": "/Widget", "/Rect": " [1 2.5 x 4] "}), (1, 2, 3, None, 0, {"/T": "name"}), (1, 3, None, None, 0, {"/T": "far", "/FT": "/Btn"}), (1, 4, 99, 2, 1, {"/Subtype": "/Widget", "/Contents": "c"}), (2, 1, None, 1, 0, {})]
    table = spark.createDataFrame(rows, "file_id int, object_id int, parent_id int, page int, place int, attrs map<string,string>")
    got = {(r["file_id"], r["object_id"]): r for r in objects.annotations(table).collect()}
    assert set(got) == {(1, 1), (1, 4), (2, 1)}
    first = got[1, 1]
    assert (first["subtype"], first["name"], first["field"], first["value"], first["rect"]) == ("Widget", "name", "Btn", "", [1.0, 2.5, 0.0, 4.0])
    assert got[1, 4]["name"] == "" and got[1, 4]["content"] == "c" and got[2, 1]["subtype"] == ""
    assert [(r["file_id"], r["object_id"]) for r in objects.form_fields(table).collect()] == [(1, 1)]
    files = spark.createDataFrame([(1, {"/Title": "t"}), (2, {"/Author": "a"})], "file_id int, info map<string,string>")
    new = objects.set_metadata(files, spark.createDataFrame([(1, {"Subject": "s", "/Title": "n"})], "file_id int, info map<string,string>"))
    assert {r["file_id"]: r["m"] for r in new.select("file_id", objects.metadata(F.col("info")).alias("m")).collect()} == {1: {"Subject": "s", "Title": "n"}, 2: {"Author": "a"}}


def test_words_and_lines(spark):
    runs = spark.createDataFrame([(1, 1, "ab c", 10.0, True), (1, 2, "d\te ", 20.0, False), (1, 3, "fgh", 20.0, False), (1, 4, "ij", 20.0, False), (2, 1, "   ", 10.0, True)], "doc int, at int, text string, size double, bold boolean")
    words = flow.words(runs, ["doc"], "at", ["bold", "size"])
    rows = words.orderBy("word").collect()
    assert [(r["text"], r["width"], r["space"], r["size"]) for r in rows] == [("ab", 10.0, 5.0, 10.0), ("cd", 15.0, 5.0, 20.0), ("e", 10.0, 10.0, 20.0), ("fghij", 50.0, 10.0, 20.0)]
    assert [[(p["bold"], p["text"]) for p in r["parts"]] for r in rows] == [[(True, "ab")], [(True, "c"), (False, "d")], [(False, "e")], [(False, "fghij")]]
    wrapped = flow.wrap(words.drop("parts"), ["doc"], 40.0, indent=10.0)
    assert [(r["text"], r["line"], r["x"]) for r in wrapped.orderBy("word").collect()] == [("ab", 1, 10.0), ("cd", 1, 25.0), ("e", 2, 0.0), ("fghij", 3, 0.0)]
    assert [(r["line"], r["text"], r["width"], r["height"], r["ascent"]) for r in flow.lines(wrapped, ["doc"]).orderBy("line").collect()] == [(1, "ab cd", 40.0, 20.0, 16.0), (2, "e", 10.0, 20.0, 16.0), (3, "fghij", 50.0, 20.0, 16.0)]
    assert [r["line"] for r in flow.wrap(words.drop("parts"), ["doc"], 40.0, most=1).orderBy("word").collect()] == [1, 1, None, None]


def test_tables_on_pages(spark):
    rows = spark.createDataFrame([("t", r, h) for r, h in enumerate([10.0, 30.0, 30.0, 95.0, 20.0])] + [("u", 0, 500.0)], "t string, row int, height double")
    got = [(r["t"], r["row"], r["page"], r["y"], r["repeated"]) for r in flow.table_flow(rows, ["t"], 80.0).orderBy("t", "page", "y").collect()]
    assert got == [("t", 0, 1, 0.0, False), ("t", 1, 1, 10.0, False), ("t", 2, 1, 40.0, False), ("t", 0, 2, 0.0, True), ("t", 3, 2, 10.0, False), ("t", 0, 3, 0.0, True), ("t", 4, 3, 10.0, False), ("u", 0, 1, 0.0, False)]
    cells = spark.createDataFrame([("t", 0, 5.0), ("t", 0, 9.0), ("t", 1, None)], "t string, row int, content double")
    assert {r["row"]: r["height"] for r in flow.row_heights(cells, ["t"], 2.0).collect()} == {0: 13.0, 1: 16.0}


def test_values(spark):
    assert _values(spark, ["1234", "12", "A1", "é", "", None], S.code128_symbols(F.col("a"))) == [[105, 12, 34, (105 + 12 + 68) % 103, 106], [105, 12, 117 % 103, 106], [104, 33, 17, (104 + 33 + 34) % 103, 106], None, None, None]
    assert _values(spark, ['"a\\"b"', "null", " 1.50 ", "false", '{"x": 1}', None], S.form_value(F.col("a"))) == ['a"b', "", "1.50", "false", '{"x": 1}', ""]
    assert _values(spark, ["1.5", " 2 ", "x", None], S.number_of(F.col("a"))) == [1.5, 2.0, 0.0, 0.0]
    sizes = {"A4": (595.28, 841.89), "a4 landscape": (841.89, 595.28), "letter portrait": (612, 792), "ledger": (1224, 792), "10cm 2in": (283.465, 144), "72pt": (72, 72), "2in 10in landscape": (720, 144), "B5": (498.9, 708.66)}
    for got, want in zip(_values(spark, list(sizes), S.sheet_size(F.col("a"))), sizes.values(), strict=True):
        assert got == pytest.approx(want)
    assert _values(spark, ["a€é"], F.hex(S.encode_windows(F.col("a")))) == ["6180E9"]


def test_style_sheets(spark):
    css = """@charset "x"; a{color:red}/* b{c:d} */ .x , #y > z { margin: 1px 2px 3px; Padding: 0; --v: A; bad; empty: ; font: 12px/2 "A B", serif }
    @media print { @supports (x: y) { q { border-left: dashed #fff } } @font-face { src: url("a;b{}.ttf"); } u { list-style: square inside } } @media (width: 1px) { no { a: b } }
    e:not({ a: b } f { background: url(x y.png) no-repeat; flex: 2; flex-flow: column wrap; c: d !IMPORTANT } @page :first { size: a5 } last { a: b"""
    sheets_ = spark.createDataFrame([("s", css), ("t", ""), ("u", None)], "sheet string, css string")
    got = [(r["selector"], r["property"], r["value"], r["important"]) for r in sheets.rules(sheets_).orderBy("place", "property").collect()]
    assert got[0] == ("a", "color", "red", False) and ("last", "a", "b", False) in got and ("f", "c", "d", True) in got and not any(s == "no" or p in ("bad", "empty") for s, p, _, _ in got)
    by = {(s, p): v for s, p, v, _ in got}
    two = ".x , #y > z"
    assert [by[two, f"margin-{s}"] for s in ("top", "right", "bottom", "left")] == ["1px", "2px", "3px", "2px"] and by[two, "padding-left"] == "0" and by[two, "--v"] == "A"
    assert (by[two, "font-size"], by[two, "line-height"], by[two, "font-family"]) == ("12px", "2", '"A B", serif') and (two, "font-style") not in by
    assert (by["q", "border-left-width"], by["q", "border-left-style"], by["q", "border-left-color"]) == ("medium", "dashed", "#fff") and by["@font-face", "src"] == 'url("a;b{}.ttf")' and by["@page :first", "size"] == "a5"
    assert (by["u", "list-style-type"], by["u", "list-style-position"]) == ("square", "inside") and (by["f", "flex-grow"], by["f", "flex-shrink"], by["f", "flex-basis"]) == ("2", "1", "0")
    assert (by["f", "background-image"], by["f", "background-repeat"], by["f", "flex-direction"], by["f", "flex-wrap"]) == ("url(x y.png)", "no-repeat", "column", "wrap") and ("f", "background-color") not in by
    chains = {(r[0], r[1]): r[2] for r in sheets.as_rules(sheets_.filter("sheet = 's'"))}
    one, other = X.parse_selectors(".x, #y > z")
    assert chains[one, "padding-top"] == chains[other, "padding-top"] == "0"
    with pytest.raises(ValueError, match="more than 3"):
        sheets.as_rules(sheets_.filter("sheet = 's'"), 3)


def test_merged_sources(spark):
    sources = spark.createDataFrame([("o", 0, "b", "b", "image"), ("o", 0, "a", "a", "pdf"), ("o", 1, "", "a", "pdf")], "output string, place int, name_order string, path string, kind string")
    files_ = spark.createDataFrame([("a", 1), ("a", 2)], "path string, page int")
    images = spark.createDataFrame([("b", 20, 10)], "path string, width int, height int")
    got = [(r["new_page"], r["path"], r["page"], r["x"], r["y"], r["w"], r["h"]) for r in pages.merge_sources(sources, files_, images, (100.0, 100.0), 10.0, "contain").orderBy("new_page").collect()]
    none = (None,) * 4
    assert got == [(1, "a", 1, *none), (2, "a", 2, *none), (3, "b", None, 10.0, 30.0, 80.0, 40.0), (4, "a", 1, *none), (5, "a", 2, *none)]
    for lost in ("pdf", "image"):
        with pytest.raises(PySparkException, match="no pages in zz"):
            pages.merge_sources(spark.createDataFrame([("o", 0, "", "zz", lost)], sources.schema), files_, images, (100.0, 100.0)).collect()
    with pytest.raises(ValueError, match="no room"):
        pages.merge_sources(sources, files_, images, (100.0, 100.0), 50.0)


def test_drawn_references(spark):
    svg = '<svg><defs><g id="a"><rect></rect><use href="#b" x="2"></use><use href="#a" x="9"></use></g><g id="b"><circle></circle></g><g id="b"><path></path></g></defs><use xlink:href="#a" x="10px" y="1.5"></use><symbol><use href="#b"></use></symbol><use href="#gone"></use><use></use></svg>'
    nodes = dom.nodes(spark.createDataFrame([(1, svg), (2, "<p>x</p>"), (3, None)], "page_id long, html string"))
    got = sorted((r["tag"], len(r["path"]), r["dx"], r["dy"]) for r in graphics.drawn(nodes).collect())
    assert got == [("circle", 2, 12.0, 1.5), ("g", 1, 10.0, 1.5), ("g", 2, 12.0, 1.5), ("rect", 1, 10.0, 1.5)]
    x, y = graphics.transform_point(F.lit(1.0), F.lit(2.0), F.array(*[F.lit(v) for v in (2.0, 0.5, 3.0, 4.0, 10.0, 20.0)]))
    assert tuple(spark.range(1).select(x, y).first()) == (18.0, 28.5)


def test_built_text(spark):
    spans = spark.createDataFrame([("p", 2, 10.9, "b"), ("p", 1, 10.0, "a"), ("p", 3, 11.5, "c"), ("p", 4, 10.6, "d"), ("q", 1, 0.0, "")], "page string, at int, y double, text string")
    assert {r["page"]: r["text"] for r in text.built_text(spans, ["page"]).collect()} == {"p": "ab\ncd", "q": ""}


def test_well_formed(spark):
    cases = {"<a><b>x</b></a>": True, "<a><b></a>": False, "": True, "text": True, "<a>&amp;</a>": True, "<a>&foo;</a>": False, "<x:a><y:b/></x:a>": True, "<a b=1/>": False, None: True}
    assert _values(spark, list(cases), compliance.well_formed(F.col("a"))) == list(cases.values())


def test_counters_and_differences(spark):
    both = lambda v, style: spark.range(1).select(S.counter_text(F.lit(v), F.lit(style))).first()[0]
    assert [both(v, s) for v, s in ((27, "lower-alpha"), (26, "UPPER-LATIN"), (1994, "lower-roman"), (4000, "upper-roman"), (0, "upper-roman"), (3, "square"), (3, "none"), (3, "odd"), (3, None))] == ["27", "Z", "mcmxciv", "4000", "0", "■", "", "3", "3"]
    names = F.create_map(F.lit("a"), F.array(F.lit(2), F.lit(3)))
    cases = {"counters(a)": "2.3", "counters(a, '/', lower-roman)": "ii/iii", '"x counter(a) y"': "x 3 y", "counter(z)": "0", "counters(z)": "", None: None}
    assert _values(spark, list(cases), S.counter_content(F.col("a"), names)) == list(cases.values())
    rows = {"/x /y 65 /A /B 300 /C 66 /b 66.9 /c -1 /m": {0: "x", 1: "y", 65: "A", 66: "c"}, "": {}, "5": {}}
    assert _values(spark, list(rows), S.differences(F.filter(F.split("a", " "), lambda x: x != ""))) == list(rows.values())
    line = spark.createDataFrame([("1", "a@b"), ("", "a@b"), (None, None)], "p string, e string").select(S.contact_line(F.col("p"), F.col("e")))
    assert [r[0] for r in line.collect()] == ["1 | a@b", "a@b", ""]


def test_spans_are_placed_once(spark, capsys):
    rows = [(p, float(x), 700.0 - y, 10.0, 0.0, False, f"t{x}") for p in range(3) for y in (0, 20, 40, 60) for x in (0, 100)]
    spans = spark.createDataFrame(rows, "page long, x double, y double, size double, width double, bold boolean, text string")
    L.lines(spans).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    exports.page_html(spans).explain()  # placed spans and their cells are stored
    assert "MapInArrow" not in capsys.readouterr().out
    exports.page_markdown(spans).explain()
    assert capsys.readouterr().out.count("MapInArrow") <= 1  # the runs of lines
    assert [r["line"] for r in L.placed(spans).filter("page = 1").orderBy("y", "x").collect()] == [4, 4, 3, 3, 2, 2, 1, 1]
