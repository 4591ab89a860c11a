"""How much the operators write, shuffle and repeat: what must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import objects, trees


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that the tree operators write."""
    rows, spread = [], trees.spread

    def count(df, name):
        out = spread(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(trees, "spread", count)
    return rows


def test_climb_writes_leaves_once(spark, written):
    # A chain of 64 nodes with 1,000 leaves at its end.
    chain = spark.range(64).select(F.col("id").alias("n"), (F.col("id") - 1).alias("up"))
    tree = chain.unionByName(spark.range(1000, 2000).select(F.col("id").alias("n"), F.lit(63).cast("long").alias("up"))).select(F.lit(1).alias("g"), "n", "up", (F.col("n") % 7).alias("kept"))
    got = trees.climb(tree, ["g"], "n", "up", {"v": F.lit(1)}, lambda own, above: {"v": own["v"] + above["v"]}, keep=["kept"])
    assert {(r["n"], r["kept"]): r["v"] for r in got.collect()} == {(k, k % 7): min(k, 64) + 1 for k in [*range(64), *range(1000, 2000)]}
    assert sum(written) <= 1064 + 8 * 64


def test_climb_with_lost_parents_and_ends(spark):
    rows = [(1, 1, None, "a"), (1, 2, 1, None), (1, 3, 2, "c"), (1, 4, 3, None), (1, 5, 99, None), (2, 1, None, None), (2, 4, 1, None)]
    tree = spark.createDataFrame(rows, "g int, n int, up int, v string")
    assert {(r["g"], r["n"]): r["v"] for r in trees.nearest(tree, ["g"], "n", "up", "v").collect()} == {(1, 1): "a", (1, 2): "a", (1, 3): "c", (1, 4): "c", (1, 5): None, (2, 1): None, (2, 4): None}
    with pytest.raises(ValueError, match="cycle"):
        trees.nearest(spark.createDataFrame([(1, 1, 2, None), (1, 2, 1, None), (1, 3, 1, None)], "g int, n int, up int, v string"), ["g"], "n", "up", "v")


def test_file_annotations_climb_once(spark, data, monkeypatch):
    from docloom.plans.registry import QUERIES

    calls, climb = [], trees.climb
    monkeypatch.setattr(objects.trees, "climb", lambda *a, **k: calls.append(1) or climb(*a, **k))
    assert QUERIES["file_annotations"](spark, data).filter("is_field").count() > 0
    assert len(calls) == 1


def test_styles_of_few_and_many_combinations(spark, monkeypatch):
    from docloom.operators import styles

    rows = [(1, k, k - 1 if k else -1, "p" if k % 2 else "b") for k in range(6)]
    nodes = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, tag string")
    declared = spark.createDataFrame([(1, k, "font-size", f"{k + 1}em") for k in range(3)] + [(1, 4, "color", "#fff")], "page_id long, node_id int, property string, value string")
    tables, keep = [], styles.materialise
    monkeypatch.setattr(styles, "materialise", lambda df, name: tables.append(out := keep(df, name)) or out)
    few = sorted(styles.computed(nodes, declared).drop("other").collect())
    assert [r["font_size"] for r in few] == [12.0, 24.0, 72.0, 72.0, 72.0, 72.0] and [r["color"] for r in few][3:] == [[0.2] * 3, [1.0] * 3, [1.0] * 3]
    assert tables[0].count() == 5  # the two p without declarations share one
    monkeypatch.setattr(styles, "FEW_LOOKS", 0)
    assert sorted(styles.computed(nodes, declared).drop("other").collect()) == few


def test_only_the_sibling_columns_that_selectors_read(spark):
    from docloom.operators import selectors as X

    chains = [c for text in ("nav a", "li + li", "p:first-of-type", "i:not(b:empty)") for c in X.parse_selectors(text)]
    assert X.sibling_columns(chains[:1]) == () and X.sibling_columns(chains[:3]) == ("type_ix", "prev_id") and X.sibling_columns(chains) == ("type_ix", "prev_id", "n_children")
    tree = spark.createDataFrame([(1, 0, -1, "p"), (1, 1, 0, "b"), (1, 2, 0, "")], "page_id long, node_id int, parent_id int, tag string")
    plain = X.with_siblings(tree, ())
    assert plain.columns == tree.columns and "Window" not in plain._jdf.queryExecution().executedPlan().toString()
    assert [r["n_children"] for r in X.with_siblings(tree, ("n_children",)).orderBy("node_id").collect()] == [2, 0]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_lines_from_one_sort_of_runs(spark):
    from docloom.operators import flow

    runs = spark.createDataFrame([(1, 1, "ab c", "x", 2.0), (1, 2, "d  ", "y", 4.0), (1, 3, "", "x", 2.0), (1, 4, "e", "x", 2.0), (2, 1, "\t", "x", 2.0), (2, 2, None, "x", 2.0), (3, 1, "f", "x", 2.0)], "k int, at int, text string, look string, size double")
    words = flow.words(runs, ["k"], "at", ["look", "size"])
    got = [(r["k"], r["word"], r["text"], [(p["look"], p["text"]) for p in r["parts"]], r["width"], r["space"], r["size"]) for r in words.orderBy("k", "word").collect()]
    assert got == [(1, 1, "ab", [("x", "ab")], 2.0, 1.0, 2.0), (1, 2, "cd", [("x", "c"), ("y", "d")], 3.0, 1.0, 4.0), (1, 3, "e", [("x", "e")], 1.0, 1.0, 2.0), (3, 1, "f", [("x", "f")], 1.0, 1.0, 2.0)]
    plan = _plan(flow.wrap(words.drop("parts"), ["k"], 40.0, ordered=True))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort ") == 1


def test_lines_from_one_pass_over_runs(spark, data):
    from docloom.operators import flow
    from docloom.plans.registry import QUERIES

    texts = ["ab c", "d  ", "", "e fgh", "\tij", None, " ", "klmnopqrstuvwxyz", "a b c d e f g h ", "i"]
    runs = spark.createDataFrame([(k, at, text, 2.0 + (k + at) % 3) for k in range(4) for at, text in enumerate(texts * 3) if k < 3 or not (text or "").strip()], "k int, at int, text string, size double")
    for width, indent in ((9.0, 0.0), (30.0, 5.0)):
        want = flow.lines(flow.wrap(flow.words(runs, ["k"], "at", []), ["k"], width, indent), ["k"])
        got = flow.run_lines(runs, ["k"], "at", width, indent)
        assert sorted(got.drop("words").collect()) == sorted(want.select(*got.drop("words").columns).collect())
        assert all(r["words"] == len(r["text"].split(" ")) for r in got.collect()) and {r["k"] for r in got.collect()} == {0, 1, 2}
    plan = _plan(QUERIES["wrapped_lines"](spark, data))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_folds_hand_on_a_bounded_number_of_rows(spark):
    import pyarrow as pa

    from docloom.operators import folds

    class Rows:
        columns = ["k", "at"]
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    read = []

    def step(state, k, at):
        read.append(at)
        return ((k, at * 10_000 + i) for i in range(10_000))

    run = folds.fold_sorted(Rows(), ["k"], ["at"], lambda: None, step, "k long, i long", ordered=True)
    out = run(iter([pa.record_batch({"k": [1] * 10, "at": list(range(10))})]))
    first = next(out)
    assert read == [0] and first.num_rows <= 4096
    rest = list(out)
    assert max(b.num_rows for b in rest) <= 4096
    assert [i for b in (first, *rest) for i in b.column(1).to_pylist()] == list(range(100_000))


def test_cells_are_found_while_a_page_is_read(spark, data):
    from docloom.operators import dom, grids
    from docloom.plans.registry import QUERIES

    inner = "<table><tr><td>x<td rowspan='2z'>y</table>"
    pages = [
        "<table><tr><td colspan=2>a<td>b<tr><th rowspan=3>c<td>d<tr><td colspan=' +2'>e<td>f</table>", f"<p>t<table><tbody><tr><td>o {inner} p<td>q</tbody><thead><tr><td>h<tr></thead><tfoot><tr><th>f</table>",
        f"<table><tr><td>{inner}{inner}</td></table>", "<tr><td>no table</td></tr><table><td>no row</td><tr>", "<table><thead><tbody><tr><td>deep</table>", "<table><tr><td><script>s</script><style>t</style>u &amp; v<br>w \n\t x</td><td/><td>", "", None,
        "<div><table><caption><tr><td>c</caption><tr><td rowspan=0 colspan='-1'>z<div><td>in a div</div><td>l</table></div>", "<table>" + "".join(f"<tr><td rowspan={k % 4} colspan={k % 3}>{k}</td><td> </td><td>{k}</td></tr>" for k in range(3000)) + "</table>",
        "<TABLE><TR><TD ColSpan=3>A</TD></TR></TABLE>", "<table><tr><td title='" + "t" * 300 + "' colspan=2>long</td><td>m</td></tr></table>", "<svg><table><tr><td>v</table>", "<table><tr><p><td>in p</td></p></tr></table>", "x<td>", " ", "<table><tr><td>1</td></tr></table><table><tr><td>2</td><td>\u00a0</td></tr></table>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").unionByName(spark.read.parquet(f"{data}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "html"))
    want, got = grids.table_cells(dom.nodes(df)), grids.page_cells(df)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and got.count() > 9000
    plan = _plan(QUERIES["html_tables"](spark, data))
    assert plan.count("- Exchange ") == 1 and plan.count("MapInArrow") == 1 and "Window" not in plan


def test_contents_from_one_sort_of_lines(spark, data):
    from docloom.plans.registry import QUERIES

    plan = _plan(QUERIES["toc_entries"](spark, data))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort ") == 1


def test_sums_and_searches_are_not_repeated(spark):
    from docloom.functions import scalars as S
    from docloom.operators import markdown

    columns = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.struct(i.cast("double").alias("least"), (i * 2.0).alias("wanted"), F.lit(1.0).alias("weight")))
    widths = spark.range(3, 4).select(S.table_widths(columns, F.lit(9.0)).alias("w"))
    assert [round(x, 6) for x in widths.first()["w"]] == [1.5, 3.0, 4.5] and _plan(widths).count("aggregate(") <= 4
    refs = F.create_map(F.lit("r"), F.struct(F.lit("u").alias("url"), F.lit("").alias("title")))
    html = spark.createDataFrame([("[a][R] [b[c][] [r][] <[d][[r]",), (None,)], "t string").select(markdown.inline_html(F.col("t"), refs).alias("h"))
    assert [r["h"] for r in html.collect()] == ['<a href="u">a</a> [b[c][] <a href="u">r</a> &lt;[d][[r]', None]
    assert _plan(html).count("regexp_extract_all(") == 1


def test_outline_parents_are_not_broadcast(spark, data, monkeypatch):
    from docloom.plans import export_queries

    plans = []
    monkeypatch.setattr(export_queries, "spread", lambda df, name: plans.append(_plan(df)) or df)
    monkeypatch.setattr(export_queries.objects, "outlines", lambda items: items.select("file_id", "object_id", *[F.lit(0).alias(c) for c in ("depth", "place", "number", "descendants")]))
    export_queries.outline_items(spark, data)
    assert plans and "BroadcastHashJoin" not in plans[0]


def test_job_stream_keeps_a_state_for_a_bucket_of_users(spark, tmp_path):
    from docloom.streaming import jobs

    events = spark.createDataFrame([(u, 1_000_000 + 60 * m + u, k) for u in range(200) for m, k in ((0, "view"), (20, "purchase"), (45, "error"), (200, "view"))], "user_id long, s long, event_type string")
    events = events.select("user_id", F.timestamp_seconds("s").alias("ts"), F.col("s").alias("event_id"), "event_type")
    events = events.unionByName(events.filter("user_id = 7").withColumn("user_id", F.lit(None).cast("long")))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    shared = str(tmp_path / "shared")
    got = jobs.finished_jobs(spark, str(tmp_path / "events.parquet"), shared)
    want = jobs.jobs(events).filter(F.unix_micros("created") < 1_012_000_000_000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 402
    state = spark.read.format("statestore").load(next(p for p in (tmp_path / "shared").iterdir()).as_posix() + "/state")
    assert state.count() < 200


def test_reachable_deals_rows(spark, monkeypatch):
    """Tables that a walk writes come from tasks of about as many rows, however well the rows compress."""
    from docloom import session

    most, spread = [], trees.spread

    def watch(df, name):
        most.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0)
        return spread(df, name)

    monkeypatch.setattr(trees, "spread", watch)
    monkeypatch.setattr(session, "ROWS_EACH", 200, raising=False)
    n = F.col("id")
    edges = spark.range(2000).select(F.lit("f").alias("g"), n.alias("src"), ((n + 1000) % 2000).alias("dst"))
    edges = edges.unionByName(edges).unionByName(spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 1), (None, 1, 2), ("g", None, 3)], "g string, src long, dst long"))
    starts = spark.createDataFrame([("g", 1), ("g", 1), (None, 1)], "g string, node long").unionByName(spark.range(1000).select(F.lit("f").alias("g"), n.alias("node")))
    got = {(r["g"], r["node"]): r["depth"] for r in trees.reachable(edges, starts, ["g"], 5).collect()}
    assert got == {("f", k): int(k >= 1000) for k in range(2000)} | {("g", 1): 0, ("g", 2): 1, (None, 1): 0}
    assert max(most) <= 400
    keyed = spark.createDataFrame([("f", 1500, 1), ("f", 1400, 1), ("g", 2, 1), ("g", 1, 0)], "g string, node long, k int")
    assert sorted(map(tuple, trees.with_key(keyed, edges, starts, ["g"], F.col("k") == 1, 5).collect())) == [("f", 1400, 1), ("g", 2, 1)]
