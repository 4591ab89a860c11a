"""Page algebra: a document is rows (doc, page, ...), pages numbered from 1 in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S


def select_pages(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """The chosen pages of every document, in the given order, numbered anew; those a document lacks are skipped."""
    spec = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(k).alias("at")) for k, p in enumerate(chosen)])
    kept = pages.withColumn("_hit", F.explode(F.filter(spec, lambda s: s["page"] == F.col("page"))))
    order = Window.partitionBy("doc").orderBy("_hit.at")
    return kept.withColumn("new_page", F.row_number().over(order)).drop("_hit")


def delete_pages(pages: DataFrame, gone: list[int]) -> DataFrame:
    kept = pages.filter(~F.col("page").isin(*gone))
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc").orderBy("page")))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Documents concatenated part after part: part, doc, page and ``new_page`` by document, from a running sum of page counts."""
    every = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        every = p if every is None else every.unionByName(p)
    counts = every.groupBy("doc", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("doc", "part").orderBy("page"))
    return every.withColumn("_k", inside).join(counts, ["doc", "part"]).withColumn("new_page", F.col("offset") + F.col("_k")).drop("_k", "offset")


def number_pages(pages: DataFrame) -> DataFrame:
    of = F.count("*").over(Window.partitionBy("doc"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    return pages.withColumn("label", F.format_string("Page %d of %d", at, of))


def checked(pages: DataFrame, chosen: list[int]) -> DataFrame:
    """The pages, or an error when rows are read if a document lacks one of the ``chosen`` (from 1)."""
    of = F.count("*").over(Window.partitionBy("doc"))
    bad = F.lit(False)
    for p in chosen:
        bad = bad | (F.lit(p) < 1) | (F.lit(p) > of)
    failed = F.raise_error(F.format_string("page out of range [1, %d]", of)).cast("int")
    return pages.withColumn("page", F.when(bad, failed).otherwise(F.col("page")))


def keep_some(pages: DataFrame, gone: list[int]) -> DataFrame:
    """``delete_pages``, but a document of which nothing would be left is an error when rows are read."""
    left = F.sum((~F.col("page").isin(*gone)).cast("int")).over(Window.partitionBy("doc"))
    return delete_pages(pages.withColumn("page", F.when(left == 0, F.raise_error(F.lit("no pages remain")).cast("int")).otherwise(F.col("page"))), gone)


def rotate(pages: DataFrame, degrees: int, chosen: list[int] | None = None) -> DataFrame:
    """Sets ``rotation`` of the chosen pages, of all without a choice; 90, 180 and 270 degrees count, anything else is 0."""
    turned = S.rotation(F.lit(degrees))
    hit = F.lit(True) if not chosen else F.col("page").isin(*chosen)
    before = F.col("rotation") if "rotation" in pages.columns else F.lit(0)
    return pages.withColumn("rotation", F.when(hit, turned).otherwise(before))


def split_named(pages: DataFrame, outputs: DataFrame, doc_column: str = "doc") -> DataFrame:
    """The pages of each output in the order of its spec: output, new_page (from 1) and the page's columns.

    ``outputs``: doc, output, spec (as ``1-3,5``; blank for all pages). An invalid spec, a page that its document lacks or an output without a name is an error when rows are read.
    """
    named = F.when(F.trim("output") == "", F.raise_error(F.lit("output path is empty")).cast("string")).otherwise(F.col("output"))
    spec = outputs.select(F.col(doc_column).alias("_doc"), named.alias("output"), S.require_page_spec(F.coalesce("spec", F.lit(""))).alias("_list"))
    counts = pages.groupBy("doc").agg(F.max("page").alias("_n"))
    spec = spec.join(counts, F.col("_doc") == F.col("doc")).drop("doc")
    every = F.coalesce("_list", F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda p: p - 1))
    spec = spec.select("_doc", "output", "_n", F.posexplode(every).alias("_at", "_page"))
    far = F.when(F.col("_page") >= F.col("_n"), F.raise_error(F.format_string("page %d out of range [1, %d]", F.col("_page") + 1, F.col("_n").cast("int"))).cast("int")).otherwise(F.col("_page"))
    return spec.withColumn("_page", far).join(pages, (F.col("_doc") == F.col("doc")) & (F.col("_page") + 1 == F.col("page"))).withColumn("new_page", F.col("_at") + 1).drop("_doc", "_at", "_page", "_n")


def page_map(attributes: Column) -> Column:
    """A map of entries with plain keys: leading slashes go, and what encrypts is only said to be present."""
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(F.regexp_replace(e["key"], "^/", "").alias("k"), F.when(e["key"] == "/Encrypt", "present").otherwise(e["value"]).alias("v")))
    return F.map_from_entries(entries)


def merge_sources(sources: DataFrame, pages: DataFrame, images: DataFrame, size: tuple[float, float], margin: float = 0.0, fit: str = "") -> DataFrame:
    """output, new_page, path, page (null for images), x, y, w, h: the pages of all sources one after the other; an image is a page of its own.

    ``sources``: output, place, name_order, path, kind (as ``files.expand_inputs`` gives them); ``pages``: path, page; ``images``: path, width, height. An image
    is drawn in the middle of a page of ``size`` inside its margin. A source that is in neither table, or a margin without room, is an error.
    """
    room_w, room_h = size[0] - 2 * margin, size[1] - 2 * margin
    if room_w <= 0 or room_h <= 0:
        raise ValueError("the margin leaves no room")
    lost = lambda c: F.when(c.isNull(), F.raise_error(F.concat(F.lit("no pages in "), F.col("path"))).cast("int")).otherwise(c)
    none = F.lit(None).cast("double")
    copied = sources.filter("kind = 'pdf'").join(pages.select("path", "page"), "path", "left").select("output", "place", "name_order", "path", lost(F.col("page")).alias("page"), *[none.alias(c) for c in "xywh"])
    w, h = S.fit_image(F.col("width").cast("double"), F.col("height").cast("double"), F.lit(room_w), F.lit(room_h), F.lit(fit))
    drawn = sources.filter("kind = 'image'").join(images.select("path", "width", "height", F.lit(1).alias("_there")), "path", "left").withColumn("_ok", lost(F.col("_there"))).withColumns({"w": w, "h": h})
    drawn = drawn.filter("_ok = 1").select("output", "place", "name_order", "path", F.lit(None).cast("int").alias("page"), (margin + (room_w - F.col("w")) / 2).alias("x"), (margin + (room_h - F.col("h")) / 2).alias("y"), "w", "h")
    order = Window.partitionBy("output").orderBy("place", "name_order", "path", "page")
    return copied.unionByName(drawn).withColumn("new_page", F.row_number().over(order)).select("output", "new_page", "path", "page", "x", "y", "w", "h")
