"""Whole jobs, from source tables to result tables, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions import textfn as X
from glyphlake.functions.udfs import call_model, transliterator
from glyphlake.operators import decode, layout, lexicon, records, scoring, triage


def build_manifest(files: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a file. files (path, size_mb, md5, pages, error), pages (path, page 0-based, text, width, height, fonts)."""
    n = F.col("n_pages")
    sampled = pages.join(files.select("path", F.col("pages").alias("n_pages")), "path").where(F.array_contains(X.sampled_pages(n), F.col("page")))
    counts = sampled.groupBy("path").agg(*(F.sum(c).alias(k) for k, c in C.class_counts(F.col("text")).items()), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("_text"))
    fonts = triage.font_order(sampled.select("path", (F.col("page") * 1000).alias("base"), F.posexplode("fonts").alias("k", "font")).withColumn("pos", F.col("base") + F.col("k")), "path")
    spread = triage.landscape_vote(sampled, "path").withColumnRenamed("landscape", "page_spread")
    known = files.join(counts, "path", "left").join(fonts, "path", "left").join(spread, "path", "left")
    filled = known.withColumns({k: F.coalesce(k, F.lit(0)) for k in C.MANIFEST_CLASSES} | {"fonts": F.coalesce("fonts", F.array().cast("array<string>")), "page_spread": F.coalesce("page_spread", F.lit(0))})
    english = C.english_hits(F.left(F.coalesce("_text", F.lit("")), F.lit(4000))) >= 3
    made = filled.withColumn("_c", triage.classify({k: F.col(k) for k in C.MANIFEST_CLASSES}, F.col("fonts"), english)).select("*", "_c.*")
    made = made.withColumn("parallel_source", triage.parallel_source(F.col("path")))
    made = made.withColumn("in_scope", triage.in_scope(F.col("category"), F.col("parallel_source"), F.col("error")))
    made = made.withColumns({"tier": triage.tier(F.col("path"), F.col("in_scope"), F.col("parallel_source"), F.col("pages")), "needs_ocr": triage.needs_ocr(F.col("category"))})
    ordered = made.withColumn("_position", F.struct(F.lower("path"), "path"))
    groups = triage.duplicate_groups(ordered, "md5", "_position").drop("copies")
    out = triage.mark_primary(ordered, "md5", "path").join(groups, "md5", "left").withColumn("dup_group", F.coalesce("dup_group", F.lit("")))
    return out.withColumn("fonts", F.array_join(F.slice("fonts", 1, 6), "; ")).drop("_c", "_text", "_position")


def extract_clean_text(manifest: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page texts, books) of the clean primaries whose sample is not garbage; what fails the gate is never written."""
    wanted = triage.extract_targets(manifest).select("path", X.slug(F.col("path")).alias("doc_id"))
    kept = triage.gate(pages.join(wanted, "path"), "path", "page", "text").select("doc_id", "page", "text")
    return kept, triage.assemble(kept, "doc_id", "page", "text")


def build_credits(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Credits of the primaries whose files (path) exist."""
    rows = manifest.where("is_primary = 1").join(present.select("path"), "path", "left_semi").withColumn("filename", F.substring_index("path", "/", -1))
    made = rows.withColumn("c", records.credits(F.col("path"), F.col("filename")))
    return made.select("filename", F.col("path").alias("relative_path"), "pages", "size_mb", "category", "script_found", records.scope_label(F.col("in_scope")).alias("scope"), "c.credits", "c.notes", "md5")


def score_gold(transcriptions: DataFrame) -> dict[str, DataFrame]:
    """Runs against gold, mistakes, categories, samples, totals by family and of the latest runs; transcriptions as the reader gives them."""
    pairs = scoring.pair_up(transcriptions.where("tag is null"), transcriptions.where("tag is not null"))
    scored = scoring.score(pairs).drop("gold", "hyp")
    found = scoring.mistakes(pairs)
    latest = scoring.latest_runs(scored.withColumn("family", scoring.family(F.col("tag"), ("gemini_3.6_flash", "sonnet_4.6"))).where("family is not null"), ["page_id", "family"])
    per_run = scoring.first_samples(found, ["page_id", "tag", "category"], ["pos"])
    samples = scoring.first_samples(per_run.withColumn("family", scoring.family(F.col("tag"))).where("family is not null").drop("sample"), ["family", "category"], ["page_id", "tag", "pos"], 12)
    return {"runs": scored, "mistakes": found, "categories": scoring.category_counts(found), "samples": samples, "families": scoring.pooled(scored, scoring.family(F.col("tag"))), "latest": latest, "latest_totals": scoring.pooled(latest, "family"), "chat_totals": scoring.pooled(scored.where("tag = 'composer_v1'"), "tag")}


def private_census(chars: DataFrame, seed: DataFrame) -> DataFrame:
    """Distinct and mapped codes of one font family by page and in all. chars as decode.chars_of gives them."""
    codes = chars.where(F.contains("font", F.lit("Batool"))).withColumn("code", C.hex_key(F.col("cp")))
    return decode.codes_by_page(codes, seed, "page", "code")


def glyph_census(glyphs: DataFrame, seed: DataFrame) -> dict[str, DataFrame]:
    """The seed grown by trusted ToUnicode values, coverage, and unknown keys. seed (key, text)."""
    kept = glyphs.where(C.kept_font(F.col("font"))).withColumns({"key": C.glyph_key(F.col("font"), F.col("gid")), "seq": F.row_number().over(Window.partitionBy("page").orderBy("y0", F.desc("x0"), "gid")) + F.col("page") * 1_000_000})
    harvested = decode.harvest(kept, "key", "ucs", "page")
    likely = decode.likely_values(harvested, "key", "ucs", C.good_code(F.col("ucs")))
    new = likely.select("key", decode.lookup_text(F.lit(None).cast("string"), F.lit(C.KEPT_FONTS[0]), F.col("ucs"), decode.nfkc(decode.char_of(F.col("ucs")))).alias("text"), decode.evidence(F.col("ucs"), F.col("n"), F.col("total"), F.col("first_page")).alias("evidence"))
    grown = lexicon.upsert(seed.withColumn("evidence", F.lit(None).cast("string")), new, "key")
    totals = harvested.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_page").alias("first_page"), F.max_by("ucs", F.struct("n", -F.col("first_seen"))).alias("top_ucs"), F.min("first_seen").alias("first_seen"))
    return {"seed": grown, "coverage": decode.coverage(totals, grown, "key"), "unknown": decode.unmapped(totals, grown, "key").orderBy(F.desc("n"), "first_seen")}


def crop_boxes(glyphs: DataFrame, unknown: DataFrame, width: float, height: float, top: int, pad: float = 4.0) -> DataFrame:
    """(key, n, sample, page, box): up to three padded places of each of the `top` commonest unknown keys; the report's limits."""
    keyed = glyphs.withColumn("key", C.glyph_key(F.col("font"), F.col("gid")))
    chosen = F.broadcast(unknown.orderBy(F.desc("n"), "first_seen").limit(top).select("key", "n"))  # at most `top` rows
    rank = F.row_number().over(Window.partitionBy("key").orderBy("page", "y0", F.desc("x0")))
    rows = keyed.join(chosen, "key").withColumn("sample", rank).where("sample <= 3")
    return rows.select("key", "n", "sample", "page", layout.clamp_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(width), F.lit(height), pad).alias("box"))


def gold_candidates(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Candidates (id, source_pdf, page_1idx, spread, note) whose files exist; a spread gives its right and then its left half."""
    rows = wanted.join(present.select(F.col("path").alias("source_pdf")), "source_pdf", "left_semi")
    half = F.explode(F.when(F.col("spread"), F.array(F.lit("_a_right"), F.lit("_b_left"))).otherwise(F.array(F.lit(""))))
    return rows.withColumn("half", half).select(F.concat("id", "half").alias("id"), "source_pdf", "page_1idx", F.concat("id", "half", F.lit(".png")).alias("image"), "note")


def lexicon_pass1(pages: DataFrame, convert: Callable[[str], str]) -> DataFrame:
    found = lexicon.parse_lines(pages)
    return found.withColumns({"nastaliq_pass1": transliterator(convert)(F.col("devanagari")), "nastaliq_pass2": F.lit("")})


def lexicon_pass2(rows: DataFrame, prompt: str, model: Callable[[str], str], size: int = 20) -> DataFrame:
    """Rows with the model's values. One failed batch fails the job, and nothing is written."""
    numbered = lexicon.batches(rows, ["page"], ["line"], size).withColumn("_payload", lexicon.payload())
    asked = numbered.groupBy("page", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_payload"))), lambda x: x["_payload"]), ",").alias("p"))
    asked = asked.select((F.col("page").cast("long") * 1_000_000 + F.col("batch")).alias("batch"), F.concat(F.lit(prompt + "["), F.col("p"), F.lit("]")).alias("prompt"))
    answers = call_model(asked, model).select("batch", F.posexplode(X.json_array(F.col("answer"), "array<struct<id string, nastaliq string>>")).alias("k", "a"))
    return lexicon.apply_results(rows, answers.select("a.id", "a.nastaliq", (F.col("batch") * 1000 + F.col("k")).alias("pos")))
