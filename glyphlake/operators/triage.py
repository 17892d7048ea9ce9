"""Document inventory: classification, scope, tiers, exact duplicates, gates and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.operators.ranking import global_index
from glyphlake.operators.shared import unused, written


def classify(counts: dict[str, Column], fonts: Column, english: Column) -> Column:
    """struct(category, encoding_scheme, script_found, likely_english) of a document; the first rule that holds.

    counts has total_chars, arabic_chars, devanagari_chars, pua_chars, replacement_chars and garbage_chars.
    """
    typeset = F.coalesce(F.exists(fonts, lambda f: C.contains_any(F.lower(f), ("urdutypesetting", "arabictypesetting"))), F.lit(False))
    facts = {k: counts[f"{k}_chars"] for k in ("total", "arabic", "devanagari", "pua", "replacement", "garbage")}
    facts |= {"typeset": typeset, "nastaliq": C.nastaliq_font(fonts), "english": english}
    return C.bind(F.struct(*(c.alias(n) for n, c in facts.items())), _category)


def _category(facts: Column) -> Column:
    flag = facts["english"].cast("int")

    def made(category: str, scheme: str, script: str, likely: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(scheme).alias("encoding_scheme"), F.lit(script).alias("script_found"), likely.alias("likely_english"))

    return (
        F.when(facts["total"] < 30, made("image_only", "none", "none", F.lit(0)))
        .when(facts["typeset"] & (facts["pua"] < 20) & ((facts["garbage"] > 40) | (facts["replacement"] > 40)), made("bad_text", "broken_tounicode", "legacy_encoded", flag))
        .when((facts["arabic"] > 20) & (facts["arabic"] >= facts["pua"]), made("good_text", "clean_unicode", "perso_arabic", flag))
        .when(facts["devanagari"] > 20, made("good_text", "clean_unicode", "devanagari", flag))
        .when(facts["pua"] > 20, made("bad_text", "pua", "legacy_encoded", flag))
        .when(facts["english"] & ~facts["nastaliq"], made("english_prose", "clean_unicode", "latin", F.lit(1)))
        .otherwise(made("bad_text", "legacy_8bit", "legacy_encoded", flag))
    )


def parallel_source(path: Column) -> Column:
    return C.contains_any(F.lower(path), C.PARALLEL_NAMES).cast("int")


def in_scope(category: Column, parallel: Column, error: Column) -> Column:
    """0 for prose that is not a parallel source, and for whatever could not be read."""
    return F.when((F.coalesce(error, F.lit("")) != "") | ((category == "english_prose") & (parallel == 0)), 0).otherwise(1)


def tier(path: Column, scope: Column, parallel: Column, pages: Column) -> Column:
    """9 out of scope, 1 dictionaries and grammars, 3 from 100 pages on, else 2."""
    return F.when(scope == 0, 9).when((parallel == 1) | F.contains(F.lower(path), F.lit("grammar")), 1).when(pages >= 100, 3).otherwise(2)


def needs_ocr(category: Column) -> Column:
    return category.isin("bad_text", "image_only").cast("int")


def landscape_vote(pages: DataFrame, by: str) -> DataFrame:
    """(by, landscape): 1 where over half of a document's pages are wider than 1.15 times their height."""
    wide = (F.col("width") > F.col("height") * 1.15).cast("int")
    return pages.groupBy(by).agg((F.sum(wide) * 2 > F.count("*")).cast("int").alias("landscape"))


def font_order(spans: DataFrame, by: str) -> DataFrame:
    """(by, fonts): font names by descending frequency, ties by first appearance (column pos)."""
    counted = spans.groupBy(by, "font").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "font")))
    return counted.groupBy(by).agg(F.transform(ordered, lambda x: x["font"]).alias("fonts"))


def mark_primary(df: DataFrame, digest: str, path: str, *ties: str) -> DataFrame:
    """df with is_primary: 1 for the shortest path of each digest, then the smallest; rows alike in all of that are alike in this.

    The least of each digest that occurs twice is a partial aggregate, written before rows are joined with it, so that Spark can
    split the join on a digest of very many rows. Rows without a digest are all primary.
    """
    first, known = unused(df, "first", "known")
    rank = F.struct(F.length(path).alias("n"), F.col(path).alias("path"), *(F.col(t).alias(f"tie{k}") for k, t in enumerate(ties)))
    least = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias(known)).agg(F.min(rank).alias(first), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = df.join(written(least, "primaries"), F.col(digest) == F.col(known), "left")
    return joined.withColumn("is_primary", (F.col(first).isNull() | (F.col(first) == rank)).cast("int")).drop(first, known)


def duplicate_groups(df: DataFrame, digest: str, position: str) -> DataFrame:
    """(digest, dup_group): D01, D02, ... for digests of two rows or more, in the order they are first seen."""
    seen = df.groupBy(F.col(digest).alias("digest")).agg(F.min(position).alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    numbered = global_index(seen, ["first"], "n")
    return numbered.select(F.col("digest").alias(digest), "copies", F.format_string("D%02d", F.col("n") + 1).alias("dup_group"))


def duplicate_totals(groups: DataFrame, pages: str) -> DataFrame:
    """One row: groups, redundant copies and pages in them; groups has a row per group with copies and pages."""
    return groups.agg(F.count("*").alias("dup_groups"), F.sum(F.col("copies") - 1).alias("redundant_copies"), F.sum((F.col("copies") - 1) * F.col(pages)).alias("wasted_pages"))


def summary(manifest: DataFrame) -> DataFrame:
    """(block, key, files, pages): the totals of an inventory, each block with its own filter, in one scan.

    Primaries by category and by encoding scheme; primaries in scope by script (the Latin one apart) and tier, and those
    that need OCR or are parallel sources; everything; and all rows out of scope by category.
    """
    primary = F.col("is_primary") == 1
    scoped = primary & (F.col("in_scope") == 1)
    blocks = (
        ("all", F.lit(True), F.lit("all")),
        ("category", primary, F.col("category")),
        ("script", scoped & (F.col("script_found") != "latin"), F.col("script_found")),
        ("scheme", primary, F.col("encoding_scheme")),
        ("needs_ocr", scoped & (needs_ocr(F.col("category")) == 1), F.lit("all")),
        ("parallel", scoped & (F.col("parallel_source") == 1), F.lit("all")),
        ("tier", scoped, F.col("tier").cast("string")),
        ("out_of_scope", F.col("in_scope") == 0, F.col("category")),
    )
    rows = F.filter(F.array(*(F.when(keep, F.struct(F.lit(name).alias("block"), key.alias("key"))) for name, keep, key in blocks)), lambda x: x.isNotNull())
    return manifest.select("pages", F.inline(rows)).groupBy("block", "key").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))


def extract_targets(manifest: DataFrame) -> DataFrame:
    return manifest.where("is_primary = 1 and in_scope = 1 and category = 'good_text' and encoding_scheme = 'clean_unicode'")


def gate(pages: DataFrame, doc: str, page: str, text: str, most: float = 0.08) -> DataFrame:
    """Rows of the documents whose garbage ratio over pages 5 to 14 (0-based; the last page if fewer) is at most `most`."""
    visible = C.count_of(F.col(text), f"[^{C.SPACE}]")
    bad = F.round(C.garbage_ratio(F.col(text)) * visible)
    # Only three numbers of a page are gathered; texts meet the verdict on their document afterwards.
    counts = pages.select(F.col(doc).alias("doc"), F.struct(F.col(page).alias("page"), bad.alias("bad"), visible.alias("visible")).alias("of"))
    told = counts.groupBy("doc").agg(F.count("*").alias("n"), F.collect_list("of").alias("of"))
    sliced = F.filter("of", lambda p: (p["page"] >= F.least(F.lit(5), F.col("n") - 1)) & (p["page"] < F.least(F.lit(15), F.col("n"))))
    total = lambda what: F.aggregate("sliced", F.lit(0.0), lambda t, p: t + p[what])
    told = told.withColumn("sliced", sliced).withColumn("share", F.when(total("visible") > 0, total("bad") / total("visible")).otherwise(0.0))
    clean = written(told.where(F.col("share") <= most).select("doc"), "clean")
    return pages.join(clean, F.col(doc).eqNullSafe(F.col("doc")) if doc != "doc" else pages[doc].eqNullSafe(clean["doc"]), "left_semi")


def assemble(pages: DataFrame, doc: str, page: str, text: str, between: str = "\n\n") -> DataFrame:
    """(doc, pages, chars, book): the pages of each document joined in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text])
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(F.length(text)).alias("chars"), F.array_join(ordered, between).alias("book"))
