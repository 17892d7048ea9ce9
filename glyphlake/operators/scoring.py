"""Transcriptions against gold text: edit scripts, word error rates, categories, pooled and latest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import textfn as X
from glyphlake.functions.udfs import align, nfc
from glyphlake.operators.shared import unused

FAMILIES = ("composer", "gemini", "sonnet_4.6", "sonnet_5_cc")


def error_rate(errors: Column, gold_words: Column) -> Column:
    return F.when(gold_words > 0, 100.0 * errors / gold_words).otherwise(0.0)


def pair_up(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, tag, gold, hyp): each run's words next to its page's gold words; gold (page_id, text), runs (page_id, tag, text)."""
    g = gold.select("page_id", X.scoring_tokens(nfc("text")).alias("gold"))
    return g.join(runs.select("page_id", "tag", X.scoring_tokens(nfc("text")).alias("hyp")), "page_id")


def score(pairs: DataFrame) -> DataFrame:
    """Pairs with gold_words, hyp_words, errors and wer: the distance alone needs no Python."""
    counted = pairs.withColumns({"gold_words": F.size("gold"), "hyp_words": F.size("hyp"), "errors": X.word_distance(F.col("gold"), F.col("hyp"))})
    return counted.withColumn("wer", error_rate(F.col("errors"), F.col("gold_words")))


def mistakes(pairs: DataFrame) -> DataFrame:
    """(page_id, tag, pos, category, ref, hyp): every step of the edit script that is not equal, with its category."""
    steps = pairs.select("page_id", "tag", F.posexplode(align("gold", "hyp")).alias("pos", "step")).where(F.col("step.op") != "eq")
    ref, hyp = F.col("step.ref"), F.col("step.hyp")
    category = F.when(F.col("step.op") == "del", "missing").when(F.col("step.op") == "ins", "extra").when(F.col("step.op") == "split_join", "split_join").otherwise(X.substitution_category(ref, hyp))
    return steps.select("page_id", "tag", "pos", category.alias("category"), F.coalesce(ref, F.lit("")).alias("ref"), F.coalesce(hyp, F.lit("")).alias("hyp"))


def category_counts(found: DataFrame) -> DataFrame:
    """(page_id, tag, cats): a map from category to count for each run."""
    n = found.groupBy("page_id", "tag", "category").agg(F.count("*").alias("n"))
    return n.groupBy("page_id", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("cats"))


def first_samples(found: DataFrame, by: list[str], order: list[str], most: int = 8) -> DataFrame:
    """The first `most` mistakes of each group, in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("sample", rank).where(F.col("sample") <= most)


def family(tag: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """The first family whose name the tag starts with; null for none."""
    return F.coalesce(*(F.when(tag.startswith(f), f) for f in families))


def pooled(scored: DataFrame, by: Column | str) -> DataFrame:
    """(family, runs, errors, gold_words, wer): errors over gold words, summed before dividing."""
    key = by if isinstance(by, Column) else F.col(by)
    total = scored.groupBy(key.alias("family")).agg(F.count("*").alias("runs"), F.sum("errors").alias("errors"), F.sum("gold_words").alias("gold_words"))
    return total.where(F.col("family").isNotNull()).withColumn("wer", error_rate(F.col("errors"), F.col("gold_words")))


def latest_runs(scored: DataFrame, by: list[str], tag: str = "tag", mark: str = "v2") -> DataFrame:
    """The last run of each group: those with the mark in their tag come after those without, then by tag."""
    order = Window.partitionBy(*by).orderBy(F.contains(F.col(tag), F.lit(mark)).desc(), F.desc(tag))
    (rank,) = unused(scored, "rank")
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def gold_positions(pairs: DataFrame) -> DataFrame:
    """(page_id, tag, gold_pos, ref, hyp): what each run has for each gold word, null where it has nothing."""
    steps = F.filter(align("gold", "hyp"), lambda s: s["ref"].isNotNull())
    return pairs.select("page_id", "tag", F.posexplode(steps).alias("gold_pos", "step")).select("page_id", "tag", "gold_pos", "step.ref", "step.hyp")


def two_models(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Extension: the runs of two tags, each aligned with the gold words by itself, as agreement takes them."""
    found = gold_positions(pairs.where(F.col("tag").isin(a, b)))
    one = found.where(F.col("tag") == a).select("page_id", "gold_pos", "ref", F.col("hyp").alias("a"))
    return one.join(found.where(F.col("tag") == b).select("page_id", "gold_pos", F.col("hyp").alias("b")), ["page_id", "gold_pos"])


def agreement(gold_scripts: DataFrame) -> DataFrame:
    """Extension: two models on the same gold words. gold_scripts (page_id, gold_pos, ref, a, b) -> one row of totals."""
    same = F.col("a").eqNullSafe(F.col("b"))
    return gold_scripts.agg(F.count("*").alias("gold_words"), F.count_if(same).alias("agree"), F.count_if(same & ~F.col("a").eqNullSafe(F.col("ref"))).alias("agree_wrong"))
