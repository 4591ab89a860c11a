"""Style sheets as rows: rules with their conditions, declarations, shorthands in long form.

Sheets are cut into statements by an expression; a fold over the statements keeps the blocks that are open. So a sheet is a stream of rows, not a text in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import folds
from docloom.operators import selectors as X

_QUOTED = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'"""
_STATEMENT = rf"""(?s)(?:[^{{}};"'(]++|{_QUOTED}|\((?:[^()"']++|{_QUOTED}|\((?:[^()"']++|{_QUOTED})*+\))*+\)|\()*+[{{}};]|(?s)[^{{}};]+\z"""
_VALUES = r"""(?:[^\s()\[\]"']++|"[^"]*"|'[^']*'|\((?:[^()]++|\([^()]*\))*+\)|\[[^\]]*\])++"""
_GROUPS = ("media", "supports", "layer")

# Words of shorthands.
SIDES = ("top", "right", "bottom", "left")
BORDER_STYLES = ("none", "hidden", "dotted", "dashed", "solid", "double", "groove", "ridge", "inset", "outset")
LIST_TYPES = ("none", "disc", "circle", "square", "decimal", "lower-alpha", "upper-alpha", "lower-roman", "upper-roman")
WEIGHTS = ("bold", "bolder", "lighter", "100", "200", "300", "400", "500", "600", "700", "800", "900")
DIRECTIONS, WRAPS = ("row", "row-reverse", "column", "column-reverse"), ("nowrap", "wrap", "wrap-reverse")
REPEATS = ("repeat", "no-repeat", "repeat-x", "repeat-y", "space", "round")
#: How many rules of one sheet ``as_rules`` takes to the driver.
MAX_RULES = 100_000


def declarations(sheets: DataFrame) -> DataFrame:
    """sheet, rule (from 1), place, conditions (of the group rules around it, as ``@media print``), selector, property, value, important.

    ``sheets``: sheet, css. Comments go; quoted text and brackets may hold any sign. @font-face and @page rules have their name as the selector, other at-rules
    are left out with all that is in them. A declaration without a colon or a value is left out.
    """
    css = F.regexp_replace("css", r"(?s)/\*.*?(?:\*/|\z)", " ")
    rows = sheets.select("sheet", F.posexplode(F.regexp_extract_all(css, F.lit(_STATEMENT), F.lit(0))).alias("at", "token"))

    def step(state: dict, sheet, at, token) -> list[tuple]:
        body, end = (token[:-1], token[-1]) if token[-1] in "{};" else (token, "")
        body, opened, out = body.strip(), state["open"], []
        if end == "{":
            opened.append(" ".join(body.split()))
            state["rule"] += 1
            return out
        if opened and body:
            name, colon, value = body.partition(":")
            # Around a rule there may only be groups that are known.
            *around, selector = opened
            known = all(a[:1] == "@" and a[1:].split(" ")[0].split("(")[0].lower() in _GROUPS for a in around)
            plain = not selector.startswith("@") or selector.split(" ")[0].lower() in ("@font-face", "@page")
            value = value.strip()
            important = value.lower().replace(" ", "").endswith("!important")
            if important:
                value = value[: value.rindex("!")].strip()
            if known and plain and colon and name.strip() and value and selector:
                name = name.strip()
                out.append((sheet, state["rule"], at, around, selector, name if name.startswith("--") else name.lower(), value, important))
        if end == "}" and opened:
            opened.pop()
        return out

    kind = dict(sheets.dtypes)["sheet"]
    schema = f"sheet {kind}, rule int, place int, conditions array<string>, selector string, property string, value string, important boolean"
    return folds.fold_sorted(rows, ["sheet"], ["at"], lambda: {"open": [], "rule": 0}, step, schema)


def included(conditions: Column) -> Column:
    """Whether all conditions hold: media rules for print, screen or all do, and the other groups do."""
    return F.forall(conditions, lambda c: ~F.lower(c).startswith("@media") | S.media_included(F.lower(c)))


def values(text: Column) -> Column:
    """The parts of a value between blanks, brackets and quoted text kept whole."""
    return F.regexp_extract_all(text, F.lit(_VALUES), F.lit(0))


def _entry(name, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("property"), value.alias("value"))


def is_color(text: Column) -> Column:
    t = F.lower(text)
    return t.rlike("^(#|rgb|hsl)") | t.isin(*S.COLORS)


def long_form(name: Column, value: Column) -> Column:
    """array<struct<property, value>> that a declaration stands for: the long properties of box, border, font, list, flex and background shorthands, else itself.

    Of a background the first layer's colour, image and repetition are told; without either it is taken for a colour.
    """
    parts = values(value)
    n = F.size(parts)
    at = lambda k: F.get(parts, F.lit(k) if isinstance(k, int) else k)
    pick = lambda test, default: F.coalesce(F.try_element_at(F.filter(parts, test), F.lit(-1)), F.lit(default))
    side = [F.when(n == 0, "0").otherwise(x) for x in (at(0), F.when(n < 2, at(0)).otherwise(at(1)), F.when(n < 3, at(0)).otherwise(at(2)), F.when(n == 1, at(0)).when(n < 4, at(1)).otherwise(at(3)))]
    box = lambda before, after="": F.array(*[_entry(f"{before}-{s}{after}", v) for s, v in zip(SIDES, side, strict=True)])
    style = F.lower(pick(lambda p: F.lower(p).isin(*BORDER_STYLES), "none"))
    color = pick(is_color, "currentcolor")
    width = pick(lambda p: ~F.lower(p).isin(*BORDER_STYLES) & ~is_color(p), "medium")
    border = lambda s: [_entry(f"border-{s}-width", width), _entry(f"border-{s}-style", style), _entry(f"border-{s}-color", color)]
    some = lambda *entries: F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    skip = F.when(at(0).isin("italic", "oblique", "normal"), 1).otherwise(0)
    heavy = skip + F.when(F.lower(at(skip)).isin(*WEIGHTS), 1).otherwise(0)
    size = at(heavy)
    apart = F.coalesce(at(heavy + 1) == "/", F.lit(False)) & (heavy + 2 < n)
    rest = heavy + F.when(apart, 3).otherwise(1)
    family = F.array_join(F.slice(parts, rest + 1, F.greatest(n - rest, F.lit(0))), " ")
    font = some(
        _entry("font-style", F.when(skip == 1, at(0))), _entry("font-weight", F.when(heavy > skip, at(skip))), _entry("font-size", F.substring_index(size, "/", 1)),
        _entry("line-height", F.when(size.contains("/"), F.regexp_replace(size, "^[^/]*/", "")).when(apart, at(heavy + 2))), _entry("font-family", F.when(family != "", family)),
    )
    low = F.transform(parts, F.lower)
    last = lambda words: F.try_element_at(F.filter(low, lambda p: p.isin(*words)), F.lit(-1))
    lists = some(_entry("list-style-position", last(("inside", "outside"))), _entry("list-style-type", last(LIST_TYPES)))
    flow = some(_entry("flex-direction", last(DIRECTIONS)), _entry("flex-wrap", last(WRAPS)))
    flex = lambda grow, shrink, basis: F.array(_entry("flex-grow", grow), _entry("flex-shrink", shrink), _entry("flex-basis", basis))
    word = F.trim(value)
    flexes = F.when(word == "none", flex(F.lit("0"), F.lit("0"), F.lit("auto"))).when(word == "auto", flex(F.lit("1"), F.lit("1"), F.lit("auto"))).when(n.between(1, 3), flex(at(0), F.coalesce(at(1), F.lit("1")), F.coalesce(at(2), F.lit("0")))).otherwise(F.array().cast("array<struct<property:string,value:string>>"))
    image = F.get(F.filter(parts, lambda p: F.lower(p).rlike(r"^url\(|gradient\(")), F.lit(0))
    paint = F.try_element_at(F.filter(parts, is_color), F.lit(-1))
    ground = some(_entry("background-color", F.when(paint.isNull() & image.isNull(), word).otherwise(paint)), _entry("background-image", image), _entry("background-repeat", last(REPEATS)))
    out = F.array(_entry(name, value))
    for before in ("margin", "padding"):
        out = F.when(name == before, box(before)).otherwise(out)
    for after in ("width", "style", "color"):
        out = F.when(name == f"border-{after}", box("border", f"-{after}")).otherwise(out)
    for s in SIDES:
        out = F.when(name == f"border-{s}", F.array(*border(s))).otherwise(out)
    out = F.when(name == "border", F.array(*[e for s in SIDES for e in border(s)])).otherwise(out)
    for short, entries in (("font", font), ("list-style", lists), ("flex-flow", flow), ("flex", flexes), ("background", ground)):
        out = F.when(name == short, entries).otherwise(out)
    return out


def rules(sheets: DataFrame) -> DataFrame:
    """``declarations`` that count, in long form."""
    rows = declarations(sheets).filter(included(F.col("conditions")))
    return rows.withColumn("_e", F.explode(long_form(F.col("property"), F.col("value")))).select("sheet", "rule", "place", "selector", F.col("_e.property").alias("property"), F.col("_e.value").alias("value"), "important")


def as_rules(sheet: DataFrame, most: int = MAX_RULES) -> list[tuple[X.Chain, str, str, bool]]:
    """The rules of one sheet for ``selectors.cascade``, selectors that cannot be read left out. More than ``most`` declarations are an error."""
    rows = rules(sheet).filter(~F.col("selector").startswith("@")).orderBy("place", "property").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} declarations")
    out = []
    for r in rows:
        try:
            chains = X.parse_selectors(r["selector"])
        except ValueError:
            continue
        out += [(chain, r["property"], r["value"], r["important"]) for chain in chains]
    return out
