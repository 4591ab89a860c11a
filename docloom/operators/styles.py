"""Computed styles of a node table, and the text runs that they make.

Declared values come from ``selectors.cascade`` as text. A node's style starts from its parent's inherited properties, then come the defaults of
its tag, then what is declared. Sizes may be relative to the font above, so what climbs the tree is not a value
but how a value depends on the font at the pointer: fixed, or so many times it. Two such steps make one, which is what ``trees.climb`` needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import trees
from docloom.session import materialise, spread

#: What a property is without any declaration above, in points for sizes.
INITIAL = {
    "font-family": "Helvetica", "font-size": 12.0, "font-weight": 400, "font-style": "normal", "color": (0.2, 0.2, 0.2), "text-align": "left", "text-decoration": "none",
    "line-height": 1.5, "letter-spacing": 0.0, "word-spacing": 0.0, "text-indent": 0.0, "text-transform": "none", "white-space": "normal", "vertical-align": "baseline",
    "list-style-type": "disc", "list-style-position": "outside", "border-collapse": "separate", "border-spacing": 0.0, "visibility": "visible",
}
#: Defaults by tag.
TAG_DISPLAY = {
    "block": ("div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "blockquote", "address", "details", "summary", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "pre", "hr"),
    "inline": ("span", "mark", "small", "sub", "sup", "kbd", "samp", "var", "abbr", "cite", "dfn", "q", "time", "strong", "b", "em", "i", "u", "s", "del", "code", "a", "br"),
    "inline-block": ("img", "input", "textarea", "select", "button"),
    "list-item": ("li",), "table": ("table",), "table-row": ("tr",), "table-cell": ("td", "th"), "table-header-group": ("thead",), "table-row-group": ("tbody",), "table-footer-group": ("tfoot",),
}
TAG_STYLES = {
    "strong": {"font-weight": "700"}, "b": {"font-weight": "700"}, "em": {"font-style": "italic"}, "i": {"font-style": "italic"}, "u": {"text-decoration": "underline"},
    "s": {"text-decoration": "line-through"}, "del": {"text-decoration": "line-through"}, "code": {"font-family": "Courier"}, "pre": {"font-family": "Courier", "white-space": "pre"},
    "h1": {"font-size": "24pt", "font-weight": "700"}, "h2": {"font-size": "20pt", "font-weight": "700"}, "h3": {"font-size": "16pt", "font-weight": "700"},
    "h4": {"font-size": "14pt", "font-weight": "700"}, "h5": {"font-size": "12pt", "font-weight": "700"}, "h6": {"font-size": "10pt", "font-weight": "700"},
    "a": {"text-decoration": "underline"},
}
LINK_COLOR = (0.067, 0.333, 0.800)
FONT_SIZES = {"xx-small": 6.75, "x-small": 7.5, "small": 9.75, "medium": 12.0, "large": 13.5, "x-large": 18.0, "xx-large": 24.0}
FONT_STEPS = {"smaller": 0.833, "larger": 1.2}
FONT_WEIGHTS = {"normal": 400, "bold": 700, "bolder": 700, "lighter": 300}

#: Fixed value: as many combinations of tag and declarations are broadcast; more are joined by shuffle.
FEW_LOOKS = 4_096

_TEXTS = [p for p, v in INITIAL.items() if isinstance(v, str)]
_LENGTHS = ["letter-spacing", "word-spacing", "text-indent", "border-spacing"]
_KEEPS_NORMAL = ("letter-spacing", "word-spacing")


def _name(p: str) -> str:
    return p.replace("-", "_")


def _linear(points: Column, per_font: Column) -> Column:
    """Fixed, or so many times the font at the pointer; both null: as at the pointer."""
    return F.struct(points.cast("double").alias("points"), per_font.cast("double").alias("per_font"))


def _font(text: Column, number: Column, unit: Column, root: float) -> Column:
    points, times = S.length_parts(number, unit, root)
    named, step = _chosen(text, FONT_SIZES), _chosen(text, FONT_STEPS)
    return F.when(text.isNull(), _linear(F.lit(None), F.lit(1.0))).when(named.isNotNull(), _linear(named, F.lit(None))).when(step.isNotNull(), _linear(F.lit(None), step)).otherwise(_linear(points, times))


def _follow(own: Column, font: Column) -> Column:
    """A linear value after the pointer has moved: ``font`` is the font that it pointed to."""
    return _linear(F.when(own["points"].isNotNull(), own["points"]).otherwise(own["per_font"] * font["points"]), F.when(own["points"].isNull(), own["per_font"] * font["per_font"]))


def computed(nodes: DataFrame, declared: DataFrame | None = None, root_size: float = 12.0) -> DataFrame:
    """page_id, node_id, tag, display, a column for each of ``INITIAL`` (hyphens as underscores) and other (map of the remaining declared properties).

    ``nodes``: page_id, node_id, parent_id (negative or null for roots), tag ("" for text). ``declared``: page_id, node_id, property, value. Values may
    hold var(), which is resolved with the custom properties declared here or above. Colours that cannot be read
    count as not declared. line-height becomes a multiple of the node's own font size, as which it is inherited.
    """
    rows = nodes.select("page_id", "node_id", F.when(F.col("parent_id") >= 0, F.col("parent_id")).alias("parent_id"), "tag")
    none = F.create_map().cast("map<string,string>")
    if declared is None:
        rows = rows.withColumn("declared", none)
    else:
        maps = spread(declared.groupBy("page_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("declared")), "declared")
        rows = rows.join(maps, ["page_id", "node_id"], "left").withColumn("declared", F.coalesce("declared", none))
        if not maps.filter(F.exists(F.map_keys("declared"), lambda k: k.startswith("--"))).isEmpty():
            own = F.map_filter("declared", lambda k, v: k.startswith("--"))
            merge = lambda a, up: {"vars": F.map_concat(F.map_filter(F.coalesce(up["vars"], none), lambda k, v: ~F.map_contains_key(a["vars"], k)), a["vars"])}
            rows = trees.climb(rows, ["page_id"], "node_id", "parent_id", {"vars": own}, merge, keep=["parent_id", "tag", "declared"])
            rows = rows.withColumn("declared", F.transform_values("declared", lambda k, v: F.when(k.startswith("--"), v).otherwise(S.css_variable(v, F.col("vars"))))).drop("vars")
    # In steps, so that no expression is written out more than once: texts, then numbers with units, then how they depend on the font.
    # All this depends on the tag and what is declared only, so it is done once for each combination of these.
    look = F.array_sort(F.map_entries("declared"))
    combinations = rows.select("tag", look.alias("_look")).distinct().withColumn("declared", F.map_from_entries("_look"))
    sizes = ["font-size", "line-height", *_LENGTHS]
    text = lambda p: F.col(f"_{_name(p)}")
    parts = combinations.select("tag", "_look", F.col("declared")["color"].alias("_color"), (F.col("tag") == "a").alias("_link"), *[_declared(p).alias(f"_{_name(p)}") for p in INITIAL if p != "color"])
    parts = parts.withColumns({f"_{_name(p)}": F.when(text(p) != "normal", F.lower(F.trim(text(p)))) if p in _KEEPS_NORMAL else F.lower(F.trim(text(p))) for p in [*sizes, "font-weight"]})
    numbers = {p: S.number_and_unit(text(p)) for p in sizes}
    parts = parts.withColumns({f"_n_{_name(p)}": n for p, (n, _) in numbers.items()} | {f"_u_{_name(p)}": u for p, (_, u) in numbers.items()})
    number, unit = (lambda p: F.col(f"_n_{_name(p)}")), (lambda p: F.col(f"_u_{_name(p)}"))
    parts = parts.withColumn("font_size", _font(text("font-size"), number("font-size"), unit("font-size"), root_size))
    values: dict[str, Column] = {"font_size": F.col("font_size")}
    for p in _TEXTS:
        values[_name(p)] = F.regexp_replace(text(p), "^[\"']+|[\"']+$", "") if p == "font-family" else text(p)
    weight = text("font-weight")
    values["font_weight"] = F.when(weight.isNotNull(), F.coalesce(_chosen(weight, FONT_WEIGHTS), weight.try_cast("int"), F.lit(400)))
    values["color"] = F.coalesce(S.css_color(F.col("_color"))["rgb"], F.when(F.col("_link"), F.array(*[F.lit(x) for x in LINK_COLOR])))
    for p in _LENGTHS:
        values[_name(p)] = _linear(*S.length_parts(number(p), unit(p), root_size))
    values["line_height"] = _line_height(text("line-height"), number("line-height"), unit("line-height"), F.col("font_size"))
    looks = materialise(parts.select(F.col("tag").alias("_tag"), F.col("_look").alias("_same"), *[v.alias(c) for c, v in values.items()]), "looks")
    looks = F.broadcast(looks) if looks.count() <= FEW_LOOKS else looks.hint("merge")
    nodes_ = rows.withColumn("_look", look).join(looks, F.col("tag").eqNullSafe(F.col("_tag")) & (F.col("_look") == F.col("_same")))
    out = trees.climb(nodes_, ["page_id"], "node_id", "parent_id", {c: F.col(c) for c in values}, _combined, keep=["tag", "declared"])
    base = float(INITIAL["font-size"])
    fixed = lambda c: F.coalesce(c["points"], c["per_font"] * base)
    final = {"font_size": fixed(F.col("font_size")), "line_height": F.coalesce(F.col("line_height.points"), F.col("line_height.over_font") / base)}
    final |= {_name(p): fixed(F.col(_name(p))) for p in _LENGTHS}
    initial = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    display = F.lit("block")
    for kind, tags in TAG_DISPLAY.items():
        display = F.when(F.col("tag").isin(*tags), kind).otherwise(display)
    known = [*INITIAL, "display"]
    return out.select(
        "page_id", "node_id", "tag", F.coalesce(F.col("declared")["display"], display).alias("display"),
        *[F.coalesce(final.get(_name(p), F.col(_name(p))), initial(v)).alias(_name(p)) for p, v in INITIAL.items()],
        F.map_filter("declared", lambda k, v: ~k.isin(*known) & ~k.startswith("--")).alias("other"),
    )


def _chosen(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _tag_default(p: str) -> Column:
    out = F.lit(None).cast("string")
    for tag, own in TAG_STYLES.items():
        if p in own:
            out = F.when(F.col("tag") == tag, own[p]).otherwise(out)
    return out


def _declared(p: str) -> Column:
    return F.coalesce(F.col("declared")[p], _tag_default(p))


def _line_height(text: Column, number: Column, unit: Column, font: Column) -> Column:
    """A multiple, or a length over the own font: fixed, or to be divided by the font at the pointer."""
    points, times = S.length_parts(number, unit, float(INITIAL["font-size"]))
    size = F.when(points > 0, points)
    multiple = F.when(text == "normal", 1.5).otherwise(F.coalesce(text.try_cast("double"), F.when(unit == "%", times), F.when(times > 0, times), size / F.when(font["points"] > 0, font["points"])))
    over = F.when(multiple.isNull() & font["points"].isNull(), size / font["per_font"])
    return F.struct(F.when(text.isNotNull(), F.coalesce(multiple, F.when(over.isNull(), 1.5))).cast("double").alias("points"), over.cast("double").alias("over_font"))


def _combined(own: dict[str, Column], up: dict[str, Column]) -> dict[str, Column]:
    font = up["font_size"]
    out = {"font_size": _follow(own["font_size"], font)}
    for c, v in own.items():
        if c == "font_size":
            continue
        if c in map(_name, _LENGTHS):
            out[c] = F.when(v["points"].isNull() & v["per_font"].isNull(), up[c]).otherwise(_follow(v, font))
        elif c == "line_height":
            moved = F.struct(F.when(font["points"].isNotNull(), v["over_font"] / font["points"]).alias("points"), F.when(font["points"].isNull(), v["over_font"] / font["per_font"]).alias("over_font"))
            out[c] = F.when(v["points"].isNotNull(), v).when(v["over_font"].isNotNull(), moved).otherwise(up[c])
        else:
            out[c] = F.coalesce(v, up[c])
    return out


_RUN = ("font_family", "font_size", "bold", "italic", "color", "underline", "strike", "link")


def text_runs(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """page_id, block, run (from 1), text and the style of the run: neighbouring pieces of text of one block with the same style are one run.

    ``nodes`` are those of ``dom.nodes``. A block is the outermost table cell above a text, or else the nearest element above that is not inline; hidden text
    (of scripts and styles) and white space are left out, white space is collapsed unless preserved, and a line break is a run of its own.
    The link is that of the outermost link above.
    """
    style = styles.select("page_id", "node_id", "display", "white_space", "text_transform", "font_family", "font_size", (F.col("font_weight") >= 600).alias("bold"),
                          F.col("font_style").isin("italic", "oblique").alias("italic"), "color", (F.col("text_decoration") == "underline").alias("underline"), (F.col("text_decoration") == "line-through").alias("strike"))
    pieces = nodes.filter((F.col("tag") == "br") | ((F.col("tag") == "") & ~F.col("hidden"))).select("page_id", "node_id", "tag", "text", "parent_id", "ancestors", "path")
    # Of the elements above each piece, those that matter: cells, links and whatever is not inline.
    above = pieces.select("page_id", "node_id", F.posexplode("ancestors").alias("depth", "up"))
    kinds = nodes.filter("tag <> ''").join(style.select("page_id", "node_id", "display"), ["page_id", "node_id"]).select("page_id", F.col("node_id").alias("up"), F.col("tag").isin("td", "th").alias("cell"),
                         F.when((F.col("tag") == "a") & (F.col("href") != ""), F.col("href")).alias("href"), (~F.col("display").isin("inline", "inline-block")).alias("block"))
    at = F.struct("depth", "up")
    found = above.join(kinds, ["page_id", "up"]).groupBy("page_id", "node_id").agg(
        F.min(F.when(F.col("cell"), at)).alias("_cell"), F.max(F.when(F.col("block"), at)).alias("_block"), F.min_by("href", F.when(F.col("href").isNotNull(), F.col("depth"))).alias("link"),
    )
    rows = pieces.join(found, ["page_id", "node_id"], "left").join(style, ["page_id", "node_id"])
    text = F.when(F.col("white_space").isin("pre", "pre-wrap", "pre-line"), F.col("text")).otherwise(S.collapse_whitespace(F.col("text")))
    rows = rows.withColumn("text", F.when(F.col("tag") == "br", "\n").otherwise(S.text_transform(text, F.col("text_transform")))).filter((F.col("tag") == "br") | (F.trim("text") != "") | (F.col("text") == " "))
    rows = rows.withColumn("block", F.coalesce("_cell.up", "_block.up", F.lit(-1))).withColumn("style", F.when(F.col("tag") != "br", F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "link" else F.col(c) for c in _RUN])))
    order = Window.partitionBy("page_id", "block").orderBy("node_id")
    fresh = F.when(F.lag("node_id").over(order).isNull() | F.col("style").isNull() | ~F.lag("style").over(order).eqNullSafe(F.col("style")), 1).otherwise(0)
    rows = rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda p: p["text"]), "")
    return rows.groupBy("page_id", "block", "run").agg(texts.alias("text"), F.first("style").alias("style")).select("page_id", "block", "run", "text", "style.*")
