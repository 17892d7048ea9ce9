"""Queries that go through files: written by the sinks to the shared folder and read again by the readers; and whole jobs. DuckDB SQL for each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.udfs import nfc
from glyphlake.operators import lexicon, records, scoring, triage
from glyphlake.operators.shared import folder
from glyphlake.plans import documents, jobs
from glyphlake.sources import readers, schemas, sinks


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit rows whose names hold quotes, commas and line ends."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return docs.select(F.concat(F.lit(' "a", '), F.left("text", F.lit(80))).alias("filename"), F.col("doc_id").cast("string").alias("relative_path"), F.col("n_chars").cast("int").alias("pages"), F.lit(1.5).alias("size_mb"), "lang", F.col("lang").alias("category"), F.lit("none").alias("script_found"), records.scope_label((F.col("doc_id") % 2).cast("int")).alias("scope"), F.col("source").alias("credits"), F.lit("x").alias("notes"), F.md5("text").alias("md5"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits as CSV and as TSV, read again."""
    rows, at = _credits(spark, sf_dir), folder(spark, "tables")
    sinks.csv(rows, f"{at}/csv", schemas.CREDITS)
    sinks.csv(rows, f"{at}/tsv", schemas.CREDITS, sep="\t")
    both = readers.csv(spark, f"{at}/csv", schemas.CREDITS).withColumn("form", F.lit("csv")).unionByName(readers.tsv(spark, f"{at}/tsv", schemas.CREDITS).withColumn("form", F.lit("tsv")))
    return both.select("form", "relative_path", F.md5("filename").alias("filename"), "pages", "size_mb", "scope", "credits", "md5")


TABLE_FILES = """SELECT form, doc_id::VARCHAR AS relative_path, md5(' "a", ' || left(text, 80)) AS filename, n_chars::INT AS pages, 1.5::DOUBLE AS size_mb, CASE WHEN doc_id % 2 = 1 THEN 'in_scope' ELSE 'out_of_scope' END AS scope, source AS credits, md5(text) AS md5 FROM documents, (VALUES ('csv'), ('tsv')) f(form)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as page files, each with a line end at its end, read again, of them pages 1 to 3."""
    at = folder(spark, "pages")
    sinks.page_texts(_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text"), at)
    return readers.page_range(readers.page_folder(spark, at), 1, 3).select("doc_id", "page", F.md5("text").alias("text"))


PAGE_FILES = "SELECT conv_id::VARCHAR AS doc_id, turn::INT AS page, md5(text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END) AS text FROM conversations WHERE turn BETWEEN 1 AND 3"


def provenance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of two shapes as JSON lines, read again under one schema."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    skipped = F.col("doc_id") % 5 == 0
    rows = docs.select(F.concat(F.lit("é/"), "doc_id").alias("source"), F.lit("m").alias("method"), F.lit("clean_unicode").alias("encoding_scheme"), F.col("lang").alias("script_found"), F.lit(1).alias("pages"), F.when(~skipped, F.col("n_chars")).alias("chars"), F.when(~skipped, F.left("text", F.lit(30))).alias("book"), F.when(skipped, 1).alias("skipped"), F.when(skipped, F.lit(0.25)).alias("garbage_ratio"))
    at = folder(spark, "provenance")
    sinks.json_lines(rows, at)
    return readers.json_lines(spark, at, schemas.PROVENANCE).select("source", "script_found", "pages", "chars", F.md5("book").alias("book"), "skipped", "garbage_ratio", F.col("note").isNull().cast("int").alias("no_note"))


PROVENANCE_FILES = "SELECT 'é/' || doc_id AS source, lang AS script_found, 1 AS pages, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS chars, CASE WHEN doc_id % 5 <> 0 THEN md5(left(text, 30)) END AS book, CASE WHEN doc_id % 5 = 0 THEN 1 END AS skipped, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE END AS garbage_ratio, 1 AS no_note FROM documents"


def seed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode tables, one a brand, as JSON with sorted maps, read again, with a table that is missing."""
    parts = _table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_type")
    entries = F.map_from_entries(F.collect_list(F.struct(F.format_string("%04X", F.col("p_partkey")), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")))))
    rows = parts.groupBy(F.col("p_brand").alias("font_family")).agg(entries.alias("map")).withColumn("map", sinks.sorted_map("map"))
    at = folder(spark, "seeds")
    sinks.json_lines(rows, at)
    known = spark.read.schema(schemas.SEED).json(at).select("font_family", F.posexplode("map").alias("place", "code", "text"))
    none = readers.seed(spark, f"{at}/none.json", must_exist=False).select("font_family", F.lit(0).alias("place"), "code", "text")
    return known.unionByName(none)


SEED_FILES = "SELECT p_brand AS font_family, (row_number() OVER (PARTITION BY p_brand ORDER BY printf('%04X', p_partkey)) - 1)::INT AS place, printf('%04X', p_partkey) AS code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS text FROM part"


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log, appended to twice with columns in another order, and refused with one too many; then totals of models."""
    events = _table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schemas.RUN_LOG.fields}
    log = events.select(*(({"page_id": F.col("user_id").cast("string"), "model": F.col("event_type"), "input_tokens": F.col("k"), "output_tokens": F.col("k") * 2, "total_tokens": F.col("k") * 3, "prompt_version": F.lit("v1")} | {n: c for n, c in empty.items() if n not in ("page_id", "model", "input_tokens", "output_tokens", "total_tokens", "prompt_version")})[f.name].alias(f.name) for f in schemas.RUN_LOG.fields))
    at = folder(spark, "log")
    sinks.append_log(log, at, schemas.RUN_LOG)
    sinks.append_log(log.select(*reversed(log.columns)), at, schemas.RUN_LOG)
    try:
        sinks.append_log(log.withColumn("cost", F.lit(1)), at, schemas.RUN_LOG)
        refused = 0
    except ValueError:
        refused = 1
    return records.token_totals(spark.read.schema(schemas.RUN_LOG).parquet(at), ["model"]).withColumn("refused", F.lit(refused))


LOG_FILES = "SELECT event_type AS model, 2 * count(*) AS runs, 2 * sum(json_extract(props, '$.k')::INT)::BIGINT AS input_tokens, 4 * sum(json_extract(props, '$.k')::INT)::BIGINT AS output_tokens, 6 * sum(json_extract(props, '$.k')::INT)::BIGINT AS total_tokens, 1 AS refused FROM events GROUP BY 1"


def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of the pages that have a fourth turn, by page, model and version: a second write is refused, and the pages that are not there yet are found."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("page_id"), F.col("role").alias("model"), F.lit("v1").alias("version"), "turn", "text")
    one = turns.where("turn = 3").drop("turn")
    at = folder(spark, "outputs")
    sinks.raw_outputs(one, at)
    try:
        sinks.raw_outputs(one, at)
        refused = 0
    except Exception as e:
        if "exist" not in str(e).lower():
            raise
        refused = 1
    left = sinks.unfinished(turns.select(F.col("page_id").cast("int").alias("page_id")).distinct(), spark, at, "page_id")
    return left.select("page_id", F.lit(refused).alias("refused"))


OUTPUT_FILES = "SELECT DISTINCT conv_id::INT AS page_id, 1 AS refused FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3)"


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headword lines asked about in batches of a language; a model answers for those with a romanisation, in a code fence."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    roman = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    rows = docs.select(F.concat(F.lit("e"), "doc_id").alias("entry_id"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("page"), F.col("doc_id").alias("line"), F.col("lang").alias("devanagari"), roman.alias("roman"), F.concat(F.lit("x nm: gloss "), "n_chars").alias("raw_line"), F.lit("p1").alias("nastaliq_pass1"), F.lit("").alias("nastaliq_pass2"))

    def model(prompt: str) -> str:
        asked = json.loads(prompt.removeprefix("Q: "))
        return "```json\n" + json.dumps([{"id": a["id"], "nastaliq": f"{a['english']}/{a['roman']}/{a['pass1_nastaliq']}"} for a in asked if a["roman"]]) + "\n```"

    return jobs.lexicon_pass2(rows, "Q: ", model).select("entry_id", "nastaliq_pass2")


MODEL_ANSWERS = "SELECT 'e' || doc_id AS entry_id, CASE WHEN doc_id % 3 = 0 THEN 'gloss ' || n_chars || '/' || source || '/p1' ELSE '' END AS nastaliq_pass2 FROM documents"


def extract_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be extracted: primary, in scope, good and clean; and the credits of the primaries that have a label."""
    manifest = documents._classified(spark, sf_dir).withColumn("md5", F.md5("text")).drop("text")
    primary = triage.mark_primary(manifest, "md5", "path", "doc_id")
    return triage.extract_targets(primary).select("doc_id", "path", "script_found", "tier")


EXTRACT_TARGETS = documents.CLASSIFIED + """, r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY length(path), path, doc_id) AS rn FROM t)
  SELECT doc_id, path, script_found, tier FROM r WHERE rn = 1 AND in_scope = 1 AND category = 'good_text' AND encoding_scheme = 'clean_unicode'"""


def composed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose accents were taken apart, composed again."""
    apart = F.regexp_replace(F.regexp_replace("text", "é", "é"), "ü", "ü")
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(nfc(apart)).alias("composed"), F.length(apart).alias("apart"))


COMPOSED_WORDS = "SELECT doc_id, md5(nfc_normalize(text)) AS composed, length(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))::INT AS apart FROM documents"


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation as a page's gold and all others as outputs of models: errors of every run on whole texts."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    gold = turns.where("turn = 0").select(F.col("conv_id").alias("page_id"), "text")
    runs = turns.where("turn > 0").select(F.col("conv_id").alias("page_id"), F.concat(F.lit("gemini_"), "turn").alias("tag"), "text")
    return scoring.score(scoring.pair_up(gold, runs)).select("page_id", "tag", "gold_words", "hyp_words", "errors")


GOLD_SCORES = r"""WITH RECURSIVE l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^\[(illustration|photo|blank|badge|footer|stamp|handwritten|oval|logo)[:\]]') AND NOT (s[1] = '[' AND s[-1] = ']')) AS a FROM conversations),
  f AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(array_to_string(a, ' '), '\[\[([^\]]+)\]\]', '\1', 'g'), '[ \t\n\r\f\v]+([:,])', '\1', 'g'), '([:,])[ \t\n\r\f\v]+', '\1 ', 'g') AS s FROM l),
  w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(s, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM f),
  p AS (SELECT o.conv_id, o.turn, g.w AS r, o.w AS h FROM w o JOIN w g ON g.conv_id = o.conv_id AND g.turn = 0 AND o.turn > 0),
  d AS (SELECT conv_id, turn, 0::BIGINT AS i, unnest(range(0, len(h) + 1)) AS j, unnest(range(0, len(h) + 1)) AS c FROM p
    UNION ALL SELECT conv_id, turn, i + 1, j, (j + min(base - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING))::BIGINT
    FROM (SELECT d.conv_id, d.turn, i, j, CASE WHEN j = 0 THEN c + 1 ELSE least(c + 1, lag(c) OVER (PARTITION BY d.conv_id, d.turn ORDER BY j) + (h[j] <> r[i + 1])::INT) END AS base FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn WHERE i < len(r)))
  SELECT p.conv_id AS page_id, 'gemini_' || p.turn AS tag, len(r)::INT AS gold_words, len(h)::INT AS hyp_words, c::INT AS errors FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.turn AND d.i = len(r) AND d.j = len(h)"""


def entry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far entries have been checked, by quality."""
    rows = _table(spark, sf_dir, "documents", "doc_id", "lang", "source").join(_table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    found = lexicon.quality(F.when(F.col("quality") == 1, "v"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 0, F.col("source")))
    return rows.groupBy(found.alias("quality")).agg(F.count("*").alias("entries"))


ENTRY_QUALITY = "SELECT CASE WHEN l.quality = 1 THEN 'human_verified' WHEN d.doc_id % 2 <> 0 AND d.doc_id % 3 = 0 AND source <> lang THEN 'pass2_refined' ELSE 'pass1_kept' END AS quality, count(*) AS entries FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1"

NAMES = "table_files page_files provenance_files seed_files log_files output_files model_answers extract_targets composed_words gold_scores entry_quality".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE = {name: globals()[name.upper()] for name in NAMES}
