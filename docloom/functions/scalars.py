"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower-case letters and digits; blanks, hyphens and full stops become single hyphens, emphasis marks and all else go."""
    plain = F.regexp_replace(F.lower(text), r"[*_`]|~~", "")
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{Nd} .-]", ""), r"[ .-]+", "-")
    return F.regexp_replace(kept, "^-+|-+$", "")


#: The entities that are resolved before escaping.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#34;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def unescape_html(text: Column) -> Column:
    """The entities of ``ENTITIES``, ampersands last, so that nothing is resolved twice."""
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(unescape_html(text), r"([\\`*_\[\]#|])", r"\\$1")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pdf_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def capitalize(text: Column) -> Column:
    """Raises the first letter of each blank-separated word and keeps the rest."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def ean13_check_digit(digits: Column) -> Column:
    """Check digit of the first twelve digits."""
    weighed = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), F.lit(0),
        lambda acc, i: acc + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1),
    )
    return F.pmod(10 - F.pmod(weighed, F.lit(10)), F.lit(10))


def code128_checksum(text: Column) -> Column:
    """Weighted position checksum of a code set B symbol, modulo 103; start symbol 104."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, lambda c, i: (F.ascii(c) - 32) * (i + 1)), F.lit(104), lambda a, x: a + x)
    return F.pmod(total, F.lit(103))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1 - x) * (1 - k) for x in (c, m, y)]


def hex_channels(code: Column) -> list[Column]:
    """Red, green and blue of #rrggbb or #rgb, 0 to 255."""
    h = F.regexp_replace(code, "^#", "")
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return [F.conv(F.substring(full, at, 2), 16, 10).cast("int") for at in (1, 3, 5)]


#: Points per CSS unit.
CSS_POINTS = {"px": 0.75, "cm": 28.3465, "mm": 2.83465, "in": 72.0, "pt": 1.0}


def css_length_points(text: Column, parent: Column, root: Column) -> Column:
    """A CSS length in points; em and % are relative to ``parent``, rem to ``root``; an unknown unit counts as px."""
    number = F.coalesce(F.regexp_extract(text, r"^(-?[0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    unit = F.regexp_extract(text, r"([a-z%]*)$", 1)
    out = number * CSS_POINTS["px"]
    for name, factor in CSS_POINTS.items():
        out = F.when(unit == name, number * factor).otherwise(out)
    return F.when(unit == "em", number * parent).when(unit == "rem", number * root).when(unit.isin("%", "vw", "vh"), number * parent / 100).otherwise(out)


def fit_image(w: Column, h: Column, box_w: Column, box_h: Column, fit: Column) -> tuple[Column, Column]:
    """Drawn size for contain (also for unknown and missing fits), cover, fill or none, whatever their case; null for an image without width or height."""
    by_w, by_h = F.try_divide(box_w, w), F.try_divide(box_h, h)
    some = by_w.isNotNull() & by_h.isNotNull()
    name = F.lower(F.trim(F.coalesce(fit, F.lit(""))))
    scale = F.when(name == "none", F.lit(1.0)).when(some & (name == "cover"), F.greatest(by_w, by_h)).when(some, F.least(by_w, by_h))
    return F.when(name == "fill", box_w).otherwise(w * scale), F.when(name == "fill", box_h).otherwise(h * scale)


def affine_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Of two 2x3 matrices [a b c d e f]: first ``a``, then ``b``."""
    return [
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    ]


def rotation(degrees: Column) -> Column:
    """90, 180 or 270; any other angle is 0."""
    d = F.pmod(degrees, F.lit(360))
    return F.when(d.isin(90, 180, 270), d).otherwise(F.lit(0))


def page_list(spec: Column) -> Column:
    """Distinct zero-based pages of a spec such as ``1-3,5``, in order of first mention; blank is null (all). Check ``page_spec_valid`` first."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    bound = lambda p, k: F.trim(F.element_at(F.split(p, "-", 2), k)).try_cast("int") - 1
    ranges = F.transform(parts, lambda p: F.sequence(bound(p, 1), bound(p, -1)))
    return F.when(page_spec_valid(spec) & (F.trim(spec) != ""), F.array_distinct(F.flatten(ranges)))


def page_spec_valid(spec: Column) -> Column:
    """Pages are whole numbers from 1 on and ranges do not run backwards; empty parts are skipped."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def good(p: Column) -> Column:
        ends = F.split(p, "-", 2)
        a, z = F.trim(ends[0]).try_cast("int"), F.trim(F.element_at(ends, -1)).try_cast("int")
        return F.coalesce((a >= 1) & (z >= a), F.lit(False))

    return F.forall(parts, good)


def require_page_spec(spec: Column) -> Column:
    """``page_list`` that fails on an invalid spec, as a bad request should."""
    return F.when(page_spec_valid(spec), page_list(spec)).otherwise(F.raise_error(F.concat(F.lit("invalid page spec: "), spec)))


#: File types by extension.
IMAGE_TYPES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "gif")


def merge_type(path: Column, kind: Column) -> Column:
    """pdf or image, from the stated type or else the extension; null if neither is known."""
    stated, ext = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    found = F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGE_TYPES), "image")
    return F.when(stated.isin("", "auto"), found).when(stated.isin("pdf", "image"), stated)


def glob_match(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits one of the patterns (* and ?, not across a slash), whatever its case."""
    one = lambda p: "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in p.lower()) + "$"
    out = F.lit(False)
    for p in patterns:
        out = out | F.lower(name).rlike(one(p))
    return out


#: Canonical profile names, their other spellings and the families known by a prefix.
PROFILES = {"pdfa-1b": ("pdf/a-1b", "pdfa1b", "pdf/a-1-b"), "pdfa-2b": ("pdf/a-2b", "pdfa2b", "pdf/a-2-b"), "pdfa-4": ("pdf/a-4", "pdfa4"), "pdfua-1": ("pdf/ua-1", "pdfua1"), "pdfua-2": ("pdf/ua-2", "pdfua2")}
PROFILE_FAMILIES = {"pdfx": ("pdfx", "pdf/x"), "pdfe": ("pdfe", "pdf/e"), "pdfvt": ("pdfvt", "pdf/vt"), "pades": ("pades",)}


def profile_name(text: Column) -> Column:
    p = F.lower(F.trim(text))
    out = p
    for family, starts in reversed(PROFILE_FAMILIES.items()):
        for start in starts:
            out = F.when(p.startswith(start), family).otherwise(out)
    for name, others in PROFILES.items():
        out = F.when(p.isin(name, *others), name).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference against a base URL: absolute ones stay, // keeps the scheme, / the host, ? and # the page; dot segments are resolved."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page, path = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    own = F.regexp_extract(ref, r"^([^?#]*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1)), own))
    zero = F.array().cast("array<string>")
    kept = F.aggregate(F.split(joined, "/"), zero, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    ends_open = joined.rlike(r"/\.{1,2}$")
    flat = F.concat(F.array_join(kept, "/"), F.when(ends_open, "/").otherwise(""))
    return (
        F.when(ref == "", base).when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when((base == "") | (host == ""), ref).when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("?"), F.concat(page, ref)).when(ref.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), ref)).otherwise(F.concat(host, flat, tail))
    )


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of data:[type][;base64],data; what is not valid base64 is null."""
    rest = F.regexp_replace(uri, "^data:", "")
    meta, data = F.substring_index(rest, ",", 1), F.regexp_extract(rest, r"(?s)^[^,]*,(.*)$", 1)
    return F.when(~rest.contains(","), rest.cast("binary")).when(meta.contains(";base64"), F.try_to_binary(data, F.lit("base64"))).otherwise(data.cast("binary"))


def import_url(line: Column) -> Column:
    """Of an @import line of a style sheet, with or without url() and quotes."""
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(line), "^@import", "")), ";$", ""))
    inner = F.when(rest.startswith("url("), F.trim(F.regexp_replace(F.regexp_replace(rest, r"^url\(", ""), r"\)$", ""))).otherwise(rest)
    return F.when(F.trim(line).startswith("@import"), F.regexp_replace(inner, "^[\"']+|[\"']+$", ""))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row, outer pipes left out, escaped pipes kept; null if there is no pipe."""
    t = F.trim(line)
    inner = F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))
    return F.when(t.contains("|"), cells)


def table_aligns(line: Column) -> Column:
    """Alignment of each column of a separator row, else null."""
    cells = table_cells(line)
    side = F.transform(cells, lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.endswith(":"), "right").otherwise("left"))
    return F.when((F.size(cells) >= 2) & F.forall(cells, lambda c: c.rlike("^[-:]{3,}$") & (F.length(F.replace(c, F.lit(":"), F.lit(""))) >= 3)), side)


def auto_widths(fixed: Column, available: Column) -> Column:
    """Column widths: positive ones are fixed, the others share what is left, nothing if none is."""
    total = F.aggregate(fixed, F.lit(0.0), lambda a, w: a + F.greatest(w, F.lit(0.0)))
    n = F.size(F.filter(fixed, lambda w: w <= 0))
    share = F.greatest((available - total) / n, F.lit(0.0))
    return F.transform(fixed, lambda w: F.when(w > 0, w).otherwise(share))


def track_widths(tracks: Column, available: Column, gap: Column, bounds: bool = False) -> Column:
    """Grid tracks struct<size, fr, auto> and, where wanted, least and most: fixed sizes first, then fractions of the rest, of which auto tracks get a fifth.

    A track with a positive least or most size is held to it afterwards; the others stay as they are.
    """
    add = lambda f: F.aggregate(tracks, F.lit(0.0), lambda a, t: a + f(t))
    is_fr, is_auto = (lambda t: (t["size"] <= 0) & (t["fr"] > 0)), (lambda t: (t["size"] <= 0) & (t["fr"] <= 0) & t["auto"])
    rest = F.greatest(available - gap * (F.size(tracks) - 1) - add(lambda t: F.greatest(t["size"], F.lit(0.0))), F.lit(0.0))
    fr, n_auto = add(lambda t: F.when(is_fr(t), t["fr"]).otherwise(0.0)), add(lambda t: F.when(is_auto(t), 1.0).otherwise(0.0))

    def filled(s: Column) -> Column:
        share = F.when(s["fr"] == 0, s["rest"] / s["n_auto"]).otherwise(s["rest"] * 0.2 / s["n_auto"])
        for_fr = F.when(s["n_auto"] > 0, s["rest"] * 0.8).otherwise(s["rest"])
        width = lambda t: F.when(t["size"] > 0, t["size"]).when(is_fr(t), for_fr * t["fr"] / s["fr"]).when(is_auto(t), share).otherwise(0.0)
        if not bounds:
            return F.transform(s["tracks"], width)
        sized = F.transform(s["tracks"], lambda t: F.struct(width(t).alias("w"), t["least"].alias("least"), t["most"].alias("most")))
        raised = F.transform(sized, lambda t: F.struct(F.when((t["least"] > 0) & (t["w"] < t["least"]), t["least"]).otherwise(t["w"]).alias("w"), t["most"].alias("most")))
        return F.transform(raised, lambda t: F.when((t["most"] > 0) & (t["w"] > t["most"]), t["most"]).otherwise(t["w"]))

    # In a list of one, so that the sums are made once and not for each track.
    return F.transform(F.array(F.struct(tracks.alias("tracks"), rest.alias("rest"), fr.alias("fr"), n_auto.alias("n_auto"))), filled)[0]


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "on", "checked", "y")


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


#: Luminance weights.
LUMINANCE = (0.299, 0.587, 0.114)


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return sum((w * unit(x) for w, x in zip(LUMINANCE[1:], (g, b), strict=True)), LUMINANCE[0] * unit(r))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> list[Column]:
    """Black takes what all inks share; pure black has no other ink."""
    top = F.greatest(unit(r), unit(g), unit(b))
    return [*(F.when(top <= 0, 0.0).otherwise((top - unit(x)) / top) for x in (r, g, b)), 1 - top]


def hsl_to_rgb(h: Column, s: Column, lightness: Column) -> list[Column]:
    """``h`` in degrees. Each channel is a trapezoid over the hue circle, a third of it apart."""
    high = F.when(lightness < 0.5, lightness * (1 + s)).otherwise(lightness + s - lightness * s)
    low = 2 * lightness - high

    def channel(shift: int) -> Column:
        sixth = F.pmod(h + shift, F.lit(360.0)) / 60
        return low + (high - low) * unit(F.least(sixth, 4 - sixth))

    return [F.when(s == 0, lightness).otherwise(channel(x)) for x in (120, 0, -120)]


def gradient_color(stops: Column, at: Column) -> Column:
    """Between the stops (struct of offset and value, in order) around a place, linearly; beyond the ends their values. Null without stops."""
    before = F.element_at(F.filter(stops, lambda s: s["offset"] < at), -1)
    after = F.get(F.filter(stops, lambda s: s["offset"] >= at), F.lit(0))
    between = before["value"] + (at - before["offset"]) / (after["offset"] - before["offset"]) * (after["value"] - before["value"])
    return F.when(F.size(F.filter(stops, lambda s: s["offset"] < at)) == 0, F.get(stops, F.lit(0))["value"]).when(after.isNull(), F.element_at(stops, -1)["value"]).otherwise(between)


def box_sides(text: Column) -> Column:
    """Top, right, bottom and left of a shorthand of one to four values; nothing is 0."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    pick = lambda *places: F.array(*[F.get(parts, F.lit(p)) for p in places])
    n = F.size(parts)
    return F.when(n == 0, F.array(*[F.lit("0")] * 4)).when(n == 1, pick(0, 0, 0, 0)).when(n == 2, pick(0, 1, 0, 1)).when(n == 3, pick(0, 1, 2, 1)).otherwise(pick(0, 1, 2, 3))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t\n\r\f]+", " ")


#: Innermost var(): its name, and its fallback, which may hold other functions.
_VAR = r"var\(\s*(--[^\s,()]+)\s*(?:,([^()]*(?:\((?:[^()]|\([^()]*\))*\)[^()]*)*))?\)"
VAR_STEPS = 32


def css_variable(value: Column, variables: Column) -> Column:
    """Every ``var(--name)`` and ``var(--name, fallback)`` in a value, nested ones too, from a map of variables; without either it is empty.

    Variables may hold var() themselves. After ``VAR_STEPS`` replacements, as in a cycle, what is left stays.
    """

    def step(acc: Column, _: Column) -> Column:
        name, fallback = F.regexp_extract(acc, _VAR, 1), F.trim(F.regexp_extract(acc, _VAR, 2))
        return F.when(acc.rlike(_VAR), F.replace(acc, F.regexp_extract(acc, _VAR, 0), F.coalesce(variables[name], fallback))).otherwise(acc)

    return F.when(value.contains("var("), F.aggregate(F.sequence(F.lit(1), F.lit(VAR_STEPS)), value, step)).otherwise(value)


def map_changes(a: Column, b: Column) -> Column:
    """Keys of either map whose values differ or that one of them lacks, in order."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~a[k].eqNullSafe(b[k]))


#: Page sizes in points.
PAGE_SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}


def page_size(name: Column) -> tuple[Column, Column]:
    """Width and height of a named page size; unknown names are A4."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    w, h = (F.lit(x) for x in PAGE_SIZES["a4"])
    for k, (x, y) in PAGE_SIZES.items():
        w, h = F.when(key == k, x).otherwise(w), F.when(key == k, y).otherwise(h)
    return w, h


# Font families by what a name contains, tested in this order; style suffixes, each stripped once.
FAMILIES = (
    ("helvetica|arial", "Helvetica, Arial, sans-serif"),
    ("times", "'Times New Roman', Times, serif"),
    ("courier|mono", "'Courier New', Courier, monospace"),
    ("symbol", "Symbol, serif"),
    ("zapf|dingbat", "ZapfDingbats, serif"),
)
STYLE_SUFFIXES = ("-Bold", "-Italic", "-BoldItalic", "-Oblique", "-BoldOblique", ",Bold", ",Italic", ",BoldItalic")
IMAGE_ENDS = {"image/jpeg": ".jpg", "image/png": ".png"}


def font_name(name: Column) -> Column:
    """A font's name without a subset prefix of up to six signs."""
    return F.regexp_replace(name, r"^[^+]{0,6}\+", "")


def font_style(name: Column) -> tuple[Column, Column]:
    """Whether a font is bold and whether it is italic, by its name."""
    n = F.coalesce(F.lower(name), F.lit(""))
    return n.rlike("bold|black|heavy"), n.rlike("italic|oblique")


def font_family(name: Column) -> Column:
    """A list of CSS families for a font; null stays null."""
    own = font_name(F.regexp_replace(name, "^/", ""))
    for end in STYLE_SUFFIXES:
        own = F.regexp_replace(own, end + "$", "")
    out = F.concat(F.lit("'"), own, F.lit("', sans-serif"))
    for pattern, family in reversed(FAMILIES):
        out = F.when(F.lower(name).rlike(pattern), family).otherwise(out)
    return out


def hex_bytes(text: Column) -> Column:
    """Bytes of a hexadecimal string: other signs are skipped, a last single digit counts as the upper half."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def image_name(page: Column, index: Column, mime: Column) -> Column:
    """File name of an extracted image from its page and place, both counted from 0."""
    end = F.lit(".bin")
    for kind, other in IMAGE_ENDS.items():
        end = F.when(mime == kind, other).otherwise(end)
    return F.format_string("page_%03d_image_%03d%s", page + 1, index + 1, end)


def rgb_css(r: Column, g: Column, b: Column) -> Column:
    """A colour of channels from 0 to 1 as CSS text."""
    return F.format_string("rgb(%d,%d,%d)", *[F.least(F.greatest(F.round(c * 255).cast("int"), F.lit(0)), F.lit(255)) for c in (r, g, b)])


def media_included(query: Column) -> Column:
    """Whether rules of a media query count: it names print, screen or all."""
    return F.coalesce(query.rlike("print|screen|all"), F.lit(False))


_LENGTH = r"^([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*(rem|em|px|pt|%|cm|mm|in|vw|vh)?$"


def number_and_unit(text: Column) -> tuple[Column, Column]:
    """Of a length; a plain number and nothing at all are px, what is no length is 0 without a unit."""
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, _LENGTH, 2)
    number = F.coalesce(F.regexp_extract(t, _LENGTH, 1).try_cast("double"), F.when(text.isNotNull(), 0.0))
    return number, F.when((t == "") | (t.rlike(_LENGTH) & (unit == "")), "px").when(t == "auto", "auto").otherwise(unit)


def simple_calc(expr: Column) -> Column:
    """A sum or difference of two lengths of one unit; plain numbers are px. Empty for anything else, null for null.

    Numbers are written without exponent between 0.001 and ten million.
    """
    out = F.lit("")
    for sign, pattern in ((-1, r"^(.*?) - (.*)$"), (1, r"^(.*?) \+ (.*)$")):
        (a, own), (b, other) = (number_and_unit(F.regexp_extract(F.trim(expr), pattern, i)) for i in (1, 2))
        number = F.regexp_replace((a + sign * b).cast("string"), r"\.0$", "")
        fits = F.trim(expr).rlike(pattern) & ((own == other) | (own == "") | (other == ""))
        out = F.when(fits, F.concat(number, F.when(own == "", other).otherwise(own))).otherwise(out)
    return F.when(expr.isNotNull(), out)


def length_parts(number: Column, unit: Column, root: float) -> tuple[Column, Column]:
    """A CSS length as (points, times the font): one of them is null, both are for a null. em, % and view units go by the font, rem by ``root``; no length is 0."""
    times = F.when(unit == "em", number).when(unit.isin("%", "vw", "vh"), number / 100)
    factor = F.when(unit == "rem", root)
    for name, points in CSS_POINTS.items():
        factor = factor.when(unit == name, points)
    return F.when(number.isNotNull() & times.isNull(), number * factor.otherwise(0.0)), times


# Colours by name.
COLORS = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff", "magenta": "ff00ff", "orange": "ffa500", "purple": "800080",
    "pink": "ffc0cb", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "navy": "000080", "teal": "008080", "maroon": "800000", "olive": "808000", "lime": "00ff00", "aqua": "00ffff",
    "fuchsia": "ff00ff", "brown": "a52a2a", "coral": "ff7f50", "crimson": "dc143c", "darkblue": "00008b", "darkgray": "a9a9a9", "darkgrey": "a9a9a9", "darkgreen": "006400", "darkred": "8b0000", "gold": "ffd700",
    "indigo": "4b0082", "ivory": "fffff0", "khaki": "f0e68c", "lavender": "e6e6fa", "lightblue": "add8e6", "lightgray": "d3d3d3", "lightgrey": "d3d3d3", "lightgreen": "90ee90", "lightyellow": "ffffe0", "tomato": "ff6347",
    "turquoise": "40e0d0", "violet": "ee82ee", "wheat": "f5deb3", "whitesmoke": "f5f5f5", "yellowgreen": "9acd32", "steelblue": "4682b4", "slategray": "708090", "slategrey": "708090", "skyblue": "87ceeb", "salmon": "fa8072",
    "royalblue": "4169e1", "plum": "dda0dd", "peru": "cd853f", "orchid": "da70d6", "linen": "faf0e6", "chocolate": "d2691e", "beige": "f5f5dc", "azure": "f0ffff", "aliceblue": "f0f8ff", "antiquewhite": "faebd7",
    "bisque": "ffe4c4", "blanchedalmond": "ffebcd", "burlywood": "deb887", "cadetblue": "5f9ea0", "chartreuse": "7fff00", "cornflowerblue": "6495ed", "cornsilk": "fff8dc", "darkcyan": "008b8b", "darkgoldenrod": "b8860b", "darkkhaki": "bdb76b",
    "darkmagenta": "8b008b", "darkolivegreen": "556b2f", "darkorange": "ff8c00", "darkorchid": "9932cc", "darksalmon": "e9967a", "darkseagreen": "8fbc8f", "darkslateblue": "483d8b", "darkslategray": "2f4f4f", "darkslategrey": "2f4f4f", "darkturquoise": "00ced1",
    "darkviolet": "9400d3", "deeppink": "ff1493", "deepskyblue": "00bfff", "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1e90ff", "firebrick": "b22222", "floralwhite": "fffaf0", "forestgreen": "228b22", "gainsboro": "dcdcdc",
    "ghostwhite": "f8f8ff", "goldenrod": "daa520", "greenyellow": "adff2f", "honeydew": "f0fff0", "hotpink": "ff69b4", "indianred": "cd5c5c", "lawngreen": "7cfc00", "lemonchiffon": "fffacd", "lightcoral": "f08080", "lightcyan": "e0ffff",
    "lightpink": "ffb6c1", "lightsalmon": "ffa07a", "lightseagreen": "20b2aa", "lightskyblue": "87cefa", "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "b0c4de", "mediumaquamarine": "66cdaa", "mediumblue": "0000cd", "mediumorchid": "ba55d3",
    "mediumpurple": "9370db", "mediumseagreen": "3cb371", "mediumslateblue": "7b68ee", "mediumspringgreen": "00fa9a", "mediumturquoise": "48d1cc", "mediumvioletred": "c71585", "midnightblue": "191970", "mintcream": "f5fffa", "mistyrose": "ffe4e1", "moccasin": "ffe4b5",
    "navajowhite": "ffdead", "oldlace": "fdf5e6", "olivedrab": "6b8e23", "orangered": "ff4500", "palegoldenrod": "eee8aa", "palegreen": "98fb98", "paleturquoise": "afeeee", "palevioletred": "db7093", "papayawhip": "ffefd5", "peachpuff": "ffdab9",
    "powderblue": "b0e0e6", "rebeccapurple": "663399", "rosybrown": "bc8f8f", "saddlebrown": "8b4513", "sandybrown": "f4a460", "seagreen": "2e8b57", "seashell": "fff5ee", "sienna": "a0522d", "snow": "fffafa", "springgreen": "00ff7f",
    "tan": "d2b48c", "thistle": "d8bfd8",
}


def css_color(text: Column) -> Column:
    """struct<rgb, alpha>, 0 to 1, of a name, #rgb, #rgba, #rrggbb, #rrggbbaa, rgb() or rgba(); null for anything else.

    Channels of named colours are rounded to three places. Channels of functions are clamped; what is no number is 0.
    """
    names = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    pair = lambda h, at: F.when(F.substring(h, at, 2).rlike("^[0-9a-f]{2}$"), F.conv(F.substring(h, at, 2), 16, 10).cast("double") / 255).otherwise(0.0)
    color = lambda h, alpha, places=15: F.struct(F.array(*[F.round(pair(h, at), places) for at in (1, 3, 5)]).alias("rgb"), alpha.alias("alpha"))
    called_by_name = lambda t: t.startswith("rgb") & t.contains("(") & t.contains(")")

    def channel(parts: Column, at: int, scale: float) -> Column:
        p = F.trim(F.get(parts, F.lit(at)))
        number = F.coalesce(F.regexp_replace(p, "%$", "").try_cast("double"), F.lit(0.0))
        return unit(F.when(p.endswith("%"), number / 100).otherwise(number / scale))

    def split(t: Column) -> Column:
        h = F.substring(t, F.lit(2), F.length(t))
        wide = F.when(t.startswith("#"), F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h))
        parts = F.when(called_by_name(t), F.filter(F.split(F.regexp_extract(t, r"(?s)^[^(]*\((.*)\)", 1), "[,/ ]"), lambda x: x != ""))
        return F.struct(names[t].alias("named"), wide.alias("wide"), parts.alias("parts"))

    def read(x: Column) -> Column:
        wide, parts = x["wide"], x["parts"]
        alpha = F.when(F.length(wide) == 8, pair(wide, 7)).otherwise(1.0)
        called = F.struct(F.array(*[channel(parts, at, 255) for at in range(3)]).alias("rgb"), F.when(F.size(parts) > 3, channel(parts, 3, 1)).otherwise(1.0).alias("alpha"))
        return F.when(x["named"].isNotNull(), color(x["named"], F.lit(1.0), 3)).when(F.length(wide).isin(6, 8), color(wide, alpha)).when(F.size(parts) >= 3, called)

    # In lists of one, so that a text is looked up and taken apart once.
    return F.when(text.isNotNull(), F.transform(F.transform(F.array(F.lower(F.trim(text))), split), read)[0])


def text_transform(text: Column, how: Column) -> Column:
    """uppercase, lowercase, or capitalize, which raises the first letter of each run of letters and digits; else the text as it is."""
    pieces = F.split(text, r"(?<![\p{L}\p{Nd}])(?=[\p{L}\p{Nd}])")
    first = lambda p: F.upper(F.left(p, F.lit(1)))
    raised = F.transform(pieces, lambda p: F.concat(F.when(F.length(first(p)) == 1, first(p)).otherwise(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p))))
    return F.when(how == "uppercase", F.upper(text)).when(how == "lowercase", F.lower(text)).when(how == "capitalize", F.array_join(raised, "")).otherwise(text)


def table_widths(columns: Column, total: Column) -> Column:
    """Widths of table columns struct<least, wanted, weight> that fill ``total``.

    Where all wanted widths fit, what is left goes by weight; where not even the least fit, these are scaled down; else what is left beyond the least
    goes by weight times what each wants more. Without any weight all get the same. A width of 0 or less gives zeros.
    """
    add = lambda f: F.aggregate(columns, F.lit(0.0), lambda a, c: a + f(c))
    n = F.size(columns).cast("double")
    wanted = lambda c: F.greatest(c["wanted"], c["least"])
    more = lambda c: (wanted(c) - c["least"]) * F.greatest(c["weight"], F.lit(0.0))
    sums = {"least": add(lambda c: c["least"]), "wanted": add(wanted), "weights": add(lambda c: c["weight"]), "flex": add(more)}

    def filled(s: Column) -> Column:
        own, spare, beyond = s["columns"], s["total"] - s["wanted"], s["total"] - s["least"]
        spread = F.when(s["weights"] == 0, F.transform(own, lambda c: wanted(c) + spare / s["n"])).otherwise(F.transform(own, lambda c: wanted(c) + F.try_divide(spare * c["weight"], s["weights"])))
        between = F.when(s["flex"] == 0, F.transform(own, lambda c: c["least"] + beyond / s["n"])).otherwise(F.transform(own, lambda c: c["least"] + F.try_divide(beyond * more(c), s["flex"])))
        scaled = F.transform(own, lambda c: F.try_divide(c["least"] * s["total"], s["least"]))
        return F.when(s["total"] <= 0, F.transform(own, lambda c: F.lit(0.0))).when(s["wanted"] <= s["total"], spread).when(s["least"] >= s["total"], scaled).otherwise(between)

    # In a list of one, so that the sums are made once and not for each column.
    return F.transform(F.array(F.struct(columns.alias("columns"), total.alias("total"), n.alias("n"), *[v.alias(c) for c, v in sums.items()])), filled)[0]


#: How much of a table's spare width cells take by their alignment.
STRETCH = {"center": 0.15, "right": 0.05, "end": 0.05}


def stretch_weight(align: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in STRETCH.items():
        out = F.when(align == name, weight).otherwise(out)
    return out


# Code 128 start and stop symbols.
START_B, START_C, STOP = 104, 105, 106


def code128_symbols(text: Column) -> Column:
    """Symbols from start to stop: pairs of digits for an even number of digits alone, else one for each sign; null for nothing and for signs outside 32 to 127."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit("[0-9]{2}"), F.lit(0)), lambda p: p.cast("int"))
    signs = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)
    data = F.when(text.rlike("^(?:[0-9]{2})+$"), F.concat(F.array(F.lit(START_C)), pairs)).when(text.rlike(r"(?s)\A[\x20-\x7f]+\z"), F.concat(F.array(F.lit(START_B)), signs))
    weighed = F.aggregate(F.transform(data, lambda s, i: s * F.greatest(i, F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.concat(data, F.array(F.pmod(weighed, F.lit(103)).cast("int"), F.lit(STOP)))


def full_address(address: Column, city: Column, state: Column, zip_code: Column, country: Column) -> Column:
    """One line; parts that are empty or missing are left out."""
    part = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(F.coalesce(address, F.lit("")), part(", ", city), part(", ", state), part(" ", zip_code), part(", ", country))


def form_value(json: Column) -> Column:
    """A JSON value as the text that a form field takes: strings without quotes, null and nothing empty, anything else as it is written, without blanks around it."""
    t = F.trim(json)
    return F.when(json.isNull() | (t == "null"), "").when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")).otherwise(t)


def number_of(value: Column) -> Column:
    """A number written as text, 0 if it is none."""
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(0.0))


# What bytes 128 to 159 stand for in the Windows code page; those left out stand for nothing.
WINDOWS = {
    128: "\u20ac", 130: "\u201a", 131: "\u0192", 132: "\u201e", 133: "\u2026", 134: "\u2020", 135: "\u2021", 136: "\u02c6", 137: "\u2030", 138: "\u0160", 139: "\u2039", 140: "\u0152", 142: "\u017d",
    145: "\u2018", 146: "\u2019", 147: "\u201c", 148: "\u201d", 149: "\u2022", 150: "\u2013", 151: "\u2014", 152: "\u02dc", 153: "\u2122", 154: "\u0161", 155: "\u203a", 156: "\u0153", 158: "\u017e", 159: "\u0178",
}


def decode_windows(data: Column) -> Column:
    """Bytes of the Windows code page as text; bytes without a sign stay control characters."""
    plain = F.decode(data, "ISO-8859-1")
    return F.translate(plain, "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))


def encode_windows(text: Column) -> Column:
    """Text as bytes of the Windows code page, a question mark for what it lacks."""
    known = F.translate(text, "".join(WINDOWS.values()), "".join(map(chr, WINDOWS)))
    return F.encode(F.regexp_replace(known, r"[^\x00-\u00ff]", "?"), "ISO-8859-1")


#: Page sizes of style sheets beside ``PAGE_SIZES``.
SHEET_SIZES = {"b4": (708.66, 1000.63), "b5": (498.90, 708.66), "ledger": (1224.0, 792.0)}


def sheet_size(text: Column) -> Column:
    """array<width, height> in points of a size of a page rule: a name, one or two lengths, each with an orientation behind it or not. Landscape turns upright pages."""
    t = F.lower(F.trim(text))
    wide, own = t.endswith(" landscape"), F.trim(F.regexp_replace(t, " (landscape|portrait)$", ""))
    parts = F.filter(F.split(own, r"\s+"), lambda x: x != "")

    def side(k: int) -> Column:
        number, unit = number_and_unit(F.coalesce(F.get(parts, F.lit(k)), F.get(parts, F.lit(0)), F.lit("")))
        points, times = length_parts(number, unit, 12.0)
        return F.coalesce(points, times * 12.0)

    size = F.when(F.size(parts) <= 2, F.array(side(0), side(1))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    for name, (w, h) in {**PAGE_SIZES, **SHEET_SIZES}.items():
        size = F.when((own == name) & (F.lit(name in ("a4", "letter")) | (t == name)), F.array(F.lit(w), F.lit(h))).otherwise(size)
    return F.when(wide & (size[0] < size[1]), F.reverse(size)).otherwise(size)


# Signs of list styles, and Roman numerals by place.
BULLETS = {"disc": "\u2022", "circle": "\u25cb", "square": "\u25a0", "none": ""}
ROMAN = (("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))


def roman(value: Column) -> Column:
    """Lower-case Roman numerals of a number from 1 to 3999; others are written as they are."""
    digit = lambda table, of: F.element_at(F.array(*[F.lit(x) for x in table]), (of % 10 + 1).cast("int"))
    places = [digit(t, F.floor(value / d)) for t, d in zip(ROMAN, (100, 10, 1), strict=True)]
    return F.when(value.between(1, 3999), F.concat(F.repeat(F.lit("m"), F.floor(F.greatest(value, F.lit(0)) / 1000).cast("int")), *places)).otherwise(value.cast("string"))


def counter_text(value: Column, style: Column) -> Column:
    """A counter in a list style: decimal (also for unknown ones), lower- or upper-alpha or -latin up to 26, lower- or upper-roman, or a bullet."""
    name = F.lower(F.coalesce(style, F.lit("")))
    letter = F.when(value.between(1, 26), F.char(value + 96)).otherwise(value.cast("string"))
    out = F.when(name.isin("lower-alpha", "lower-latin"), letter).when(name.isin("upper-alpha", "upper-latin"), F.upper(letter)).when(name == "lower-roman", roman(value)).when(name == "upper-roman", F.upper(roman(value)))
    for kind, sign in BULLETS.items():
        out = out.when(name == kind, sign)
    return out.otherwise(value.cast("string"))


_COUNTER = r"counter\(\s*([^,()]*?)\s*(?:,\s*([^()]*?)\s*)?\)"
_COUNTERS = r"counters\(\s*([^,()]*?)\s*(?:,\s*([^,()]*?)\s*)?(?:,\s*([^()]*?)\s*)?\)"
COUNTER_STEPS = 16


def counter_content(content: Column, counters: Column) -> Column:
    """A content value with ``counter(name, style)`` and ``counters(name, separator, style)`` from a map of counters to their open values, the innermost last; quotes around it go.

    A counter that is not there is 0, of counters nothing. After ``COUNTER_STEPS`` of either what is left stays.
    """

    def one(acc: Column, _: Column) -> Column:
        own = counters[F.regexp_extract(acc, _COUNTER, 1)]
        value = F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit(0))
        return F.when(acc.rlike(_COUNTER), F.replace(acc, F.regexp_extract(acc, _COUNTER, 0), counter_text(value, F.regexp_extract(acc, _COUNTER, 2)))).otherwise(acc)

    def every(acc: Column, _: Column) -> Column:
        mark, style = F.regexp_replace(F.regexp_extract(acc, _COUNTERS, 2), "^[\"']+|[\"']+$", ""), F.regexp_extract(acc, _COUNTERS, 3)
        mark = F.when(F.regexp_extract(acc, _COUNTERS, 2) == "", ".").otherwise(mark)
        own = F.coalesce(counters[F.regexp_extract(acc, _COUNTERS, 1)], F.array().cast("array<int>"))
        return F.when(acc.rlike(_COUNTERS), F.replace(acc, F.regexp_extract(acc, _COUNTERS, 0), F.call_function("array_join", F.transform(own, lambda v: counter_text(v, style)), mark))).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(COUNTER_STEPS))
    return F.regexp_replace(F.aggregate(steps, F.aggregate(steps, content, one), every), "^[\"']+|[\"']+$", "")


def differences(items: Column) -> Column:
    """map<int, string> from codes to names of an encoding's differences: numbers set the code of the name that follows, further names count on; codes are 0 to 255."""
    at = F.sequence(F.lit(0), F.size(items) - 1)
    rows = F.transform(F.when(F.size(items) > 0, at).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.array_max(F.filter(F.transform(F.slice(items, 1, i), lambda x, j: F.when(~x.startswith("/"), j)), lambda j: j.isNotNull())).alias("j"), i.alias("i"), F.get(items, i).alias("x")))
    named = F.transform(F.filter(rows, lambda r: r["x"].startswith("/")), lambda r: F.struct(
        F.when(r["j"].isNull(), r["i"]).otherwise(F.floor(F.get(items, r["j"]).try_cast("double")).cast("int") + r["i"] - r["j"] - 1).alias("code"), F.regexp_replace(r["x"], "^/", "").alias("name")))
    kept = F.filter(named, lambda e: e["code"].between(0, 255))
    return F.map_from_entries(F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["code"] == e["code"])))


def contact_line(phone: Column, email: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" | ", some(phone), some(email))
