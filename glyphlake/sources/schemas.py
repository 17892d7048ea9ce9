"""Explicit schemas of the corpus tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}[k]) for n, k in (f.split() for f in text.split(", "))])


MANIFEST = _struct("path string, size_mb double, pages int, md5 string, dup_group string, is_primary int, category string, encoding_scheme string, script_found string, likely_english int, parallel_source int, needs_ocr int, page_spread int, in_scope int, tier int, arabic_chars int, devanagari_chars int, pua_chars int, latin_chars int, garbage_chars int, fonts string, error string")
PAGE_TEXT = _struct("doc_id string, page int, text string")
PROVENANCE = _struct("source string, method string, encoding_scheme string, script_found string, pages int, chars long, out_dir string, book string, skipped int, garbage_ratio double, note string")
CHARS = _struct("page int, y0 double, x0 double, x1 double, font string, ch string, cp int")
GLYPHS = _struct("page int, y0 double, x0 double, x1 double, y1 double, font string, gid int, ucs int")
LEXICON = _struct("entry_id string, page int, line int, devanagari string, roman string, raw_line string, nastaliq_pass1 string, nastaliq_pass2 string")
VERIFICATION = T.StructType([*LEXICON.fields, *_struct("nastaliq_verified string, verify_status string, verify_notes string").fields])
PUBLISHED = _struct("entry_id string, page int, line int, devanagari string, roman string, nastaliq string, english_gloss string, quality string")
BAKEOFF = _struct("page_id string, setup string, model string, prompt string, word_error_rate_pct double, role string")
RUN_LOG = _struct("timestamp_utc timestamp, page_id string, model string, prompt_version string, temperature double, max_tokens_requested int, thinking string, input_tokens int, output_tokens int, total_tokens int, stop_reason string, extra_settings string, output_file string")
CANDIDATES = _struct("id string, source_pdf string, page_1idx int, image string, note string, check_type string")
CREDITS = _struct("filename string, relative_path string, pages int, size_mb double, category string, script_found string, scope string, credits string, notes string, md5 string")
CLIPS = _struct("client_id string, path string, sentence_id string, sentence string, sentence_domain string, up_votes int, down_votes int, age string, gender string, accents string, variant string, locale string, segment string")
SEED = T.StructType([T.StructField(n, T.StringType()) for n in ("font_family", "scheme", "source_pdf")] + [T.StructField("source_page_1idx", T.IntegerType()), T.StructField("gold_page", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType())), T.StructField("map", T.MapType(T.StringType(), T.StringType())), T.StructField("evidence", T.MapType(T.StringType(), T.StringType()))])
_CHAR = T.StructType([T.StructField("c", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
_SPAN = T.StructType([T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("chars", T.ArrayType(_CHAR))])
_LINE = T.StructType([T.StructField("spans", T.ArrayType(_SPAN))])
_GLYPH = T.StructType([T.StructField("ucs", T.StringType()), T.StructField("gid", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
TRACE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("font", T.StringType()), T.StructField("chars", T.ArrayType(_GLYPH))])))])
PAGE_TREE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("type", T.IntegerType()), T.StructField("lines", T.ArrayType(_LINE))])))])
