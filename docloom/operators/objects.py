"""Annotations, form fields and metadata of files from a table of objects.

Objects: file_id, object_id, parent_id (null: none), page (null for objects on no page), place (order on the page), attrs (map<string, string>, keys with a slash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import trees

#: What an annotation takes from the objects above it if it has none of its own.
INHERITED = {"name": "/T", "field": "/FT", "value": "/V"}


def trim_name(c: Column) -> Column:
    return F.regexp_replace(c, "^/", "")


def rectangle(text: Column) -> Column:
    """The four numbers of ``[x0 y0 x1 y1]``; zeros unless there are four, and for what is no number."""
    parts = F.filter(F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"\s+"), lambda x: x != "")
    zeros = F.array(*[F.lit(0.0)] * 4)
    # In a list of one, so that the text is taken apart once.
    numbers = F.transform(F.array(parts), lambda p: F.when(F.size(p) == 4, F.transform(p, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))).otherwise(zeros))
    return F.when(F.coalesce(text, F.lit("")) != "", numbers[0]).otherwise(zeros)


def annotations(objects: DataFrame) -> DataFrame:
    """file_id, page, place, object_id, subtype, name, field, value, content, rect, uri of the objects on pages; "" for what is missing.

    Name, field and value are those of the nearest object above that has them. Parents in a cycle are an error.
    """
    own = lambda key: F.coalesce(F.col("attrs")[key], F.lit(""))
    some = lambda c: F.coalesce(c, F.lit(""))
    shown = objects.withColumns({"subtype": trim_name(own("/Subtype")), "content": own("/Contents"), "rect": F.when(F.col("page").isNotNull(), rectangle(own("/Rect"))), "uri": own("/URI")})
    values = {c: F.col("attrs")[key] for c, key in INHERITED.items()}
    kept = ["page", "place", "subtype", "content", "rect", "uri"]
    rows = trees.climb(shown, ["file_id"], "object_id", "parent_id", values, lambda own, up: {c: F.coalesce(own[c], up[c]) for c in own}, keep=kept).filter("page is not null")
    return rows.select(
        "file_id", "page", "place", "object_id", "subtype", some(F.col("name")).alias("name"), some(trim_name(F.col("field"))).alias("field"), some(trim_name(F.col("value"))).alias("value"), "content", "rect", "uri",
    )


def is_field() -> Column:
    """Whether a row of ``annotations`` is a form field: a widget with a name."""
    return (F.col("subtype") == "Widget") & (F.col("name") != "")


def form_fields(objects: DataFrame) -> DataFrame:
    """The widgets with a name among the annotations."""
    return annotations(objects).filter(is_field())


def metadata(info: Column) -> Column:
    """A file's information entries with plain keys."""
    return F.transform_keys(info, lambda k, v: trim_name(k))


def set_metadata(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files (file_id, info, ...) with the entries of ``new`` (file_id, info) in place of all their own; others keep theirs."""
    fresh = new.select("file_id", F.transform_keys("info", lambda k, v: F.concat(F.lit("/"), trim_name(k))).alias("_info"))
    return files.join(fresh, "file_id", "left").withColumn("info", F.coalesce("_info", "info")).drop("_info")


def outlines(items: DataFrame) -> DataFrame:
    """file_id, object_id, title, page, depth (from 1), place among its siblings (from 1), number (as 2.1) and descendants of every bookmark.

    ``items``: file_id, object_id, parent_id (null at the top), prev_id (the sibling before; null for the first), title, page. Places are ranks along the links
    between siblings, found by pointer jumping; links in a cycle are an error.
    """
    ranks = trees.descendants(items, ["file_id"], "object_id", "prev_id").select("file_id", "object_id", (F.col("depth") + 1).cast("int").alias("place"))
    placed = items.join(ranks, ["file_id", "object_id"])
    numbers = trees.climb(placed, ["file_id"], "object_id", "parent_id", {"number": F.col("place").cast("string")}, lambda own, up: {"number": F.concat(up["number"], F.lit("."), own["number"])})
    counts = trees.descendants(items, ["file_id"], "object_id", "parent_id").select("file_id", "object_id", "descendants", (F.col("depth") + 1).cast("int").alias("depth"))
    return placed.join(numbers, ["file_id", "object_id"]).join(counts, ["file_id", "object_id"]).select("file_id", "object_id", "title", "page", "depth", "place", "number", "descendants")
