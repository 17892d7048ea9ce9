"""Dictionary pages to a lexicon: headwords, batches, model answers, verification lists, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import textfn as X
from glyphlake.functions.charclass import SPACE
from glyphlake.operators.ranking import group_index
from glyphlake.operators.shared import unused

# Vowel letters that stand alone as section heads.
SECTION_VOWELS = ("ओ", "अ", "ए", "ऐ", "औ", "आ", "इ", "ई", "उ", "ऊ")


def parse_lines(pages: DataFrame, letter: str = X.DEVANAGARI_CLASS, vowels: tuple[str, ...] = SECTION_VOWELS) -> DataFrame:
    """(entry_id, page, line, devanagari, roman, raw_line) of pages (page, text): one row per headword line.

    Blank lines, page tags, section heads and lines whose rest starts with a digit are left out; line counts from 1.
    """
    rows = pages.select("page", F.posexplode(X.lines(F.col("text"))).alias("_at", "raw_line"))
    line = X.strip(F.col("raw_line"))
    # Words of the letter with space between: one class and no nested repetition, on which Java's matcher would recurse.
    pattern = rf"^({letter}(?:[{letter[1:-1]}{SPACE}]*{letter})?)[{SPACE}]*(?:\(([A-Za-z][^)]*)\))?(.*)$"
    parsed = rows.withColumn("_line", line).where(
        (F.col("_line") != "") & ~F.col("_line").rlike(rf"^\[\d+\][{SPACE}]*$") & ~F.col("_line").rlike(rf"^{letter}[{SPACE}]*/[{SPACE}]*[A-Za-z/]") & ~F.col("_line").isin(*vowels) & F.col("_line").rlike(pattern)
    )
    group = lambda k: X.strip(F.regexp_extract("_line", pattern, k))
    out = parsed.select(F.format_string("p%04d:L%d", F.col("page"), F.col("_at") + 1).alias("entry_id"), "page", (F.col("_at") + 1).alias("line"), group(1).alias("devanagari"), group(2).alias("roman"), "raw_line", group(3).alias("_rest"))
    return out.where((F.col("devanagari") != "") & ~F.col("_rest").rlike(r"^\p{Nd}")).drop("_rest")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch: consecutive numbers of `size` rows each within a group, in order, which must tell a group's rows apart."""
    (place,) = unused(rows, "place")
    return group_index(rows, by, order, place).withColumn("batch", F.floor(F.col(place) / size).cast("int")).drop(place)


def payload() -> Column:
    """A row as the model is asked about it, as JSON."""
    return F.to_json(F.struct(F.col("entry_id").alias("id"), "devanagari", F.coalesce("roman", F.lit("")).alias("roman"), X.english_snippet(F.col("raw_line")).alias("english"), F.coalesce("nastaliq_pass1", F.lit("")).alias("pass1_nastaliq")))


def apply_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """rows with nastaliq_pass2 from results (id, nastaliq, pos); of repeated ids the last counts, ids without an answer get ""."""
    known, answer = unused(rows, "known", "answer")
    last = results.groupBy(F.col("id").alias(known)).agg(F.max_by("nastaliq", "pos").alias(answer))
    joined = rows.drop("nastaliq_pass2").join(last, F.col("entry_id") == F.col(known), "left")
    return joined.withColumn("nastaliq_pass2", F.coalesce(answer, F.lit(""))).drop(known, answer)


def verification(rows: DataFrame, refined: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order pages are asked for (page, ord), with pass-2 values where there are any.

    A page asked for twice gives its rows twice.
    """
    (second,) = unused(rows, "second")
    good = refined.where(F.coalesce("nastaliq_pass2", F.lit("")) != "").select("entry_id", F.col("nastaliq_pass2").alias(second)).groupBy("entry_id").agg(F.min(second).alias(second))
    asked = rows.join(pages, "page").orderBy("ord", "line").limit(n)
    joined = asked.drop("nastaliq_pass2").join(good, "entry_id", "left")
    value = F.coalesce(second, "nastaliq_pass1")
    return joined.withColumns({"nastaliq_pass2": F.coalesce(second, F.lit("")), "nastaliq_verified": value, "verify_status": F.lit(""), "verify_notes": F.lit("")}).drop(second)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing, and of new what has a key that existing lacks."""
    return existing.unionByName(new.join(existing.select(key).distinct(), key, "left_anti"))


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, at the position of its first."""
    columns = [c for c in rows.columns if c not in (key, position)]
    return rows.groupBy(key).agg(F.min(position).alias(position), F.max_by(F.struct(*columns), position).alias("_row")).select(key, position, "_row.*")


def quality(verified: Column, pass1: Column, pass2: Column) -> Column:
    """Extension: how far an entry has been checked."""
    return F.when(F.coalesce(verified, F.lit("")) != "", "human_verified").when((F.coalesce(pass2, F.lit("")) != "") & (pass2 != pass1), "pass2_refined").otherwise("pass1_kept")
