"""Archival and accessibility rules as arrays of conditions over files, and as filters over their objects.

Files: file_id, xmp (null: none), title, author, encrypted, trailer_keys, catalog_keys, lang, marked, tree_keys (null: no
structure tree). Objects: file_id, object_id, kind (annotation, figure, state or other), keys, flags, alt, alpha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S

# Profiles and the parts that their metadata names.
ARCHIVE_PARTS = {"pdfa-1b": "1", "pdfa-2b": "2", "pdfa-4": "4"}
ACCESS_PARTS = {"pdfua-1": "1", "pdfua-2": "2"}
MARKS = {"pdfx": ["pdfxid:", "PDF/X"], "pdfe": ["PDF/E"], "pdfvt": ["PDF/VT"]}
PRINT, FORBIDDEN = 4, 1 | 2 | 32


def _tag(xmp: Column, name: str) -> Column:
    """Trimmed text of an element, empty where there is none."""
    return F.coalesce(F.trim(F.regexp_extract(xmp, f"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def well_formed(xml: Column) -> Column:
    """Whether a text is well-formed XML; text without any tag or entity is."""
    parsed = F.from_xml(xml, "_corrupt_record string, _none string")
    return F.coalesce(~xml.rlike("[<&]") | parsed["_corrupt_record"].isNull(), F.lit(True))


def detected(xmp: Column) -> Column:
    """The profiles that metadata claims, in a fixed order; none without metadata."""
    part, level = _tag(xmp, "pdfaid:part"), F.upper(_tag(xmp, "pdfaid:conformance"))
    found = [F.when((part == p) & ((level == "B") if p == "1" else F.lit(True)), name) for name, p in ARCHIVE_PARTS.items()]
    found += [F.when(_tag(xmp, "pdfuaid:part") == p, name) for name, p in ACCESS_PARTS.items()]
    for name, marks in MARKS.items():
        some = F.lit(False)
        for m in marks:
            some = some | F.contains(xmp, F.lit(m))
        found.append(F.when(some, name))
    return F.array_compact(F.array(*found))


def profiles(asked: Column, xmp: Column) -> Column:
    """The profiles to test: always "pdf", then those asked for under their usual names, or with "auto" those detected."""
    names = F.transform(F.coalesce(asked, F.array().cast("array<string>")), S.profile_name)
    auto = F.array_contains(names, "auto")
    rest = F.when(auto, detected(xmp)).otherwise(F.filter(names, lambda p: p != ""))
    return F.array_distinct(F.concat(F.array(F.lit("pdf")), rest))


def _rule(fails: Column, code: str, severity: str = "error") -> Column:
    return F.when(fails, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def _mirrored(value: Column, xmp: Column) -> Column:
    return F.coalesce(F.length(value) == 0, F.lit(True)) | F.contains(xmp, S.xml_escape(value))


def _has(keys: str, key: str) -> Column:
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def file_issues(files: DataFrame) -> DataFrame:
    """file_id, profile, severity, code of files with a column ``profiles``; rules of one row only, so there is no shuffle."""
    xmp, profile = F.coalesce("xmp", F.lit("")), F.col("profile")
    none = xmp == ""
    archive, access = profile.isin(*ARCHIVE_PARTS), profile.isin(*ACCESS_PARTS)
    part = F.element_at(F.create_map(*[F.lit(x) for kv in {**ARCHIVE_PARTS, **ACCESS_PARTS}.items() for x in kv]), profile)
    tree = F.col("tree_keys").isNotNull()
    rules = [
        _rule(archive & (F.coalesce("encrypted", F.lit(False)) | _has("trailer_keys", "Encrypt")), "encryption"),
        _rule(archive & ~_has("trailer_keys", "ID"), "document-id"),
        _rule(archive & ~_has("catalog_keys", "Metadata"), "metadata"),
        _rule(archive & ~_has("catalog_keys", "OutputIntents"), "output-intent"),
        _rule(archive & none, "xmp"),
        _rule(archive & ~none & ~well_formed(xmp), "xmp-xml"),
        _rule(archive & ~none & (_tag(xmp, "pdfaid:part") != part), "pdfaid-part"),
        _rule(archive & ~none & (profile != "pdfa-4") & (F.upper(_tag(xmp, "pdfaid:conformance")) != "B"), "pdfaid-conformance"),
        _rule(~none & (profile == "pdfa-4") & (_tag(xmp, "pdfaid:rev") == ""), "pdfaid-revision", "warning"),
        _rule(archive & ~none & ~_mirrored(F.col("title"), xmp), "info-xmp-title"),
        _rule(archive & ~none & ~_mirrored(F.col("author"), xmp), "info-xmp-author"),
        _rule(access & ~F.contains(xmp, F.lit("<pdfuaid:part>")), "pdfuaid"),
        _rule(access & ~none & (_tag(xmp, "pdfuaid:part") != part), "pdfuaid-part"),
        _rule(access & (F.trim(F.coalesce("lang", F.lit(""))) == ""), "language"),
        _rule(access & ~F.coalesce("marked", F.lit(False)), "markinfo"),
        _rule(access & ~tree, "structure-tree"),
        _rule(access & tree & ~_has("tree_keys", "ParentTree"), "parent-tree"),
        _rule(access & tree & ~_has("tree_keys", "K"), "structure-kids"),
    ]
    rows = files.withColumn("profile", F.explode("profiles"))
    return rows.select("file_id", "profile", F.inline(F.array_compact(F.array(*rules)))).select("file_id", "profile", "severity", "code")


def object_issues(files: DataFrame, objects: DataFrame) -> DataFrame:
    """file_id, profile, severity, code, object_id of failing objects; what a whole file fails once has no object_id.

    Objects are tested before the join, so only those that fail some profile are shuffled.
    """
    kind = F.col("kind")
    flags = F.coalesce(F.col("flags"), F.lit(0))
    codes = F.array_compact(F.array(
        F.when((kind == "annotation") & ((flags.bitwiseAND(PRINT) == 0) | (flags.bitwiseAND(FORBIDDEN) != 0)), "annotation-flags"),
        F.when((kind == "figure") & (F.trim(F.coalesce("alt", F.lit(""))) == ""), "figure-alt"),
        F.when(_has("keys", "SMask"), "smask"),
        F.when((kind == "state") & (F.col("alpha") < 1), "transparency"),
    ))
    failing = objects.select("file_id", "object_id", F.explode(codes).alias("code"))
    failing = failing.withColumn("object_id", F.when(F.col("code").isin("annotation-flags", "figure-alt"), F.col("object_id"))).distinct()
    rows = files.select("file_id", "tree_keys", F.explode("profiles").alias("profile")).filter(F.col("profile").isin(*ARCHIVE_PARTS, *ACCESS_PARTS))
    code, profile = F.col("code"), F.col("profile")
    applies = (
        F.when(code == "annotation-flags", profile.isin(*ARCHIVE_PARTS))
        .when(code == "figure-alt", profile.isin(*ACCESS_PARTS) & F.col("tree_keys").isNotNull())
        .otherwise(profile == "pdfa-1b")
    )
    severity = F.when(code == "figure-alt", "warning").otherwise("error")
    return failing.join(rows, "file_id").filter(applies).select("file_id", "profile", severity.alias("severity"), "code", "object_id")
