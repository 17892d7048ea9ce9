"""Operators on literal tables: decoding, layout, triage edges, lexicon, logs."""

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import decode, layout, lexicon, records, scoring, triage
from glyphlake.operators.ranking import global_index
from glyphlake.sources import readers, schemas, sinks
from glyphlake.streaming.census import windowed_census

SEED = {"F001": "ا", "F002": "ب", "F003": "َ", "F004": "", "F0F1": "ئ", "F031": "ے", "F060": "ہ", "F061": "ہ", "F010": "ن", "F011": "ی", "F012": "م", "F013": "د"}


def private(spark, rows, wrap=False):
    """rows: (y0, x0, x1, code or text)."""
    made = [(1, float(y), float(a), float(b), "Batool" if isinstance(c, int) else "Times", chr(c) if isinstance(c, int) else c, c if isinstance(c, int) else ord(c)) for y, a, b, c in rows]
    glyphs = spark.createDataFrame(made, schemas.CHARS)
    seed = spark.createDataFrame(list(SEED.items()), "code string, text string")
    return decode.decode_private(glyphs, seed, wrap)


def line_of(spark, codes, **more):
    """Codes in reading order, each ten wide with no gap."""
    return private(spark, [(0, 100 - 10 * k, 110 - 10 * k, c) for k, c in enumerate(codes)], **more).first()["line"]


def test_private_codes_read_from_right_to_left(spark):
    assert line_of(spark, [0xF001, 0xF002, 0xF009]) == "اب[F009]"
    assert line_of(spark, [0xF001, 0xF004, 0xF002]) == "ا ب"  # the dropped glyph leaves its gap
    assert line_of(spark, [0xF001], wrap=True) == "{ا}"


def test_contextual_letters(spark):
    assert line_of(spark, [0xF001, 0xF0F1, 0xF031]) == "ا" + "ئے"
    assert line_of(spark, [0xF002, 0xF0F1, 0xF031]) == "ب" + "ائے"
    assert line_of(spark, [0xF010, 0xF060, 0xF011]) == "نھی"
    assert line_of(spark, [0xF012, 0xF060, 0xF001]) == "مها"
    assert line_of(spark, [0xF061, 0xF013]) == "ھد"
    assert line_of(spark, [0xF061, 0xF002]) == "ہب"


def test_rows_split_above_the_gap_only(spark):
    rows = private(spark, [(0, 0, 10, 0xF001), (14, 0, 10, 0xF002), (28.01, 0, 10, 0xF001)]).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1] and sorted(rows[0]["line"]) == sorted("اب")


def test_word_gap_is_strict(spark):
    near = private(spark, [(0, 20, 30, 0xF001), (0, 9, 19, 0xF002)]).first()["line"]
    far = private(spark, [(0, 20, 30, 0xF001), (0, 8, 18.9, 0xF002)]).first()["line"]
    assert near == "اب" and far == "ا ب"


def test_marks_join_the_nearest_host(spark):
    inside = private(spark, [(0, 20, 30, 0xF001), (0, 10, 20, 0xF002), (0, 12, 14, 0xF003)]).first()["line"]
    assert inside == "ابَ"
    assert private(spark, [(0, 12, 14, 0xF003)]).first()["line"] == "َ"


def test_latin_runs_stay_in_place(spark):
    assert private(spark, [(0, 0, 5, "a"), (0, 5, 10, "b"), (0, 40, 50, 0xF001), (0, 30, 40, 0xF002)]).first()["line"] == "abاب"


def glyph_line(spark, rows, seed=None):
    glyphs = spark.createDataFrame([(1, 0.0, float(a), float(b), 0.0, font, gid, ucs) for a, b, font, gid, ucs in rows], schemas.GLYPHS)
    table = spark.createDataFrame(list((seed or {}).items()) or [("none", "x")], "key string, text string")
    return decode.decode_glyphs(glyphs, table).first()["line"]


URDU = "AA+UrduTypesetting,Bold"


def test_glyph_keys_fall_back_to_unicode(spark):
    assert glyph_line(spark, [(20, 30, URDU, 1, 0x628), (10, 20, URDU, 2, 0xFFFD), (0, 10, "Times", 3, 0x41)]) == "ب[UrduTypesetting:2]A"
    assert glyph_line(spark, [(20, 30, URDU, 1, 0xFEFB)], {}) == "لا"
    assert glyph_line(spark, [(20, 30, URDU, 1, 0x628), (10, 20, URDU, 2, 0x41)], {"UrduTypesetting:1": "", "UrduTypesetting:2": "xy"}) == "xy"


def test_zero_width_dots_name_the_next_host(spark):
    assert glyph_line(spark, [(30, 30.1, URDU, 9, 0x62A), (20, 30, URDU, 2, 0xFFFD)]) == "ت"
    assert glyph_line(spark, [(30, 30.1, URDU, 9, 0x62A), (20, 30, URDU, 2, 0x627)]) == "ا"
    assert glyph_line(spark, [(30, 30.1, URDU, 9, 0x62A)]) == "ت"
    assert glyph_line(spark, [(31, 31.1, URDU, 9, 0x62A), (30, 30.1, URDU, 8, 0x62B), (20, 30, URDU, 2, 0xFFFD)]) in ("ث", "ت")


def test_no_space_before_a_combining_mark(spark):
    assert glyph_line(spark, [(20, 30, URDU, 1, 0x628), (5, 10, URDU, 2, 0x627)]) == "ب ا"
    assert glyph_line(spark, [(20, 30, URDU, 1, 0x628), (5, 10, URDU, 2, 0x64E)]) == "بَ"


def test_page_text_drops_blank_lines(spark):
    rows = spark.createDataFrame([(1, 0, " a "), (1, 1, "  "), (1, 2, "b")], "page int, row_id int, line string")
    assert decode.page_text(rows).first()["text"] == "a\nb"


def test_nested_trees_flatten(spark):
    tree = [(1, [(0, [([("F", 9.0, [("x", [1.04, 2.0, 3.0, 4.0]), ("", [1.0, 2.0, 3.0, 4.0])])],)]), (1, [])])]
    pages = spark.createDataFrame(tree, schemas.PAGE_TREE)
    assert [(r["ch"], r["cp"]) for r in decode.chars_of(pages).collect()] == [("x", 120), ("", None)]
    assert [(r["ord"], r["bucket"], r["x"]) for r in decode.debug_chars(pages).orderBy("n").collect()] == [(120, "ascii", 1.0), (-1, "other", 1.0)]


def classified(spark, fonts=(), english=False, **counts):
    every = {f"{k}_chars": F.lit(counts.get(k, 0)) for k in ("total", "arabic", "devanagari", "pua", "replacement", "garbage")}
    made = triage.classify(every, F.array(*(F.lit(f) for f in fonts)).cast("array<string>"), F.lit(english))
    return tuple(spark.range(1).select(made.alias("c")).select("c.*").first())


def test_classification_edges(spark):
    assert classified(spark, total=29, english=True) == ("image_only", "none", "none", 0)
    assert classified(spark, total=30) == ("bad_text", "legacy_8bit", "legacy_encoded", 0)
    assert classified(spark, total=99, arabic=21, pua=21) == ("good_text", "clean_unicode", "perso_arabic", 0)
    assert classified(spark, total=99, arabic=21, pua=22) == ("bad_text", "pua", "legacy_encoded", 0)
    assert classified(spark, total=99, pua=20) == ("bad_text", "legacy_8bit", "legacy_encoded", 0)
    assert classified(spark, total=99, devanagari=21, pua=99)[2] == "devanagari"
    assert classified(spark, total=99, arabic=50, garbage=41, fonts=["X+UrduTypesetting"])[1] == "broken_tounicode"
    assert classified(spark, total=99, english=True) == ("english_prose", "clean_unicode", "latin", 1)
    assert classified(spark, total=99, english=True, fonts=["Noori Nastaliq"]) == ("bad_text", "legacy_8bit", "legacy_encoded", 1)


def test_scope_and_tier(spark):
    rows = spark.createDataFrame([("a/x.pdf", "good_text", "", 99), ("a/x.pdf", "good_text", "", 100), ("a/kosh.pdf", "english_prose", "", 5), ("a/x.pdf", "english_prose", "", 5), ("a/kosh.pdf", "good_text", "broken", 5), ("Grammar.pdf", "good_text", None, 500)], "path string, category string, error string, pages int")
    parallel = triage.parallel_source(F.col("path"))
    scope = triage.in_scope(F.col("category"), parallel, F.col("error"))
    assert [tuple(r) for r in rows.select(scope, triage.tier(F.col("path"), scope, parallel, F.col("pages"))).collect()] == [(1, 2), (1, 3), (1, 1), (0, 9), (0, 9), (1, 1)]


def test_primary_prefers_short_then_case_sensitive_path(spark):
    rows = spark.createDataFrame([("m", "bb.pdf"), ("m", "BB.pdf"), ("m", "ccc.pdf"), ("n", "z.pdf")], "md5 string, path string")
    found = triage.mark_primary(rows, "md5", "path").where("is_primary = 1").collect()
    assert {r["path"] for r in found} == {"BB.pdf", "z.pdf"}


def test_global_index_is_gapless(spark):
    rows = global_index(spark.range(1000).withColumn("v", -F.col("id")).repartition(7), ["v"]).collect()
    assert sorted((r["index"], r["id"]) for r in rows) == [(k, 999 - k) for k in range(1000)]


def test_headword_lines(spark):
    text = "[12]\nओ\nअ / a\nभाषा (bhasha) nm: language\n  पानी  water\nLatin only\nशब्द 12 x\nदो शब्द (do shabd)\n\n"
    found = lexicon.parse_lines(spark.createDataFrame([(7, text)], "page int, text string")).orderBy("line").collect()
    assert [(r["entry_id"], r["devanagari"], r["roman"]) for r in found] == [("p0007:L4", "भाषा", "bhasha"), ("p0007:L5", "पानी", ""), ("p0007:L8", "दो शब्द", "do shabd")]


def test_results_and_verification(spark):
    rows = spark.createDataFrame([("a", 1, 1, "p1"), ("b", 1, 2, "p2"), ("c", 2, 1, "p3")], "entry_id string, page int, line int, nastaliq_pass1 string")
    answers = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("z", "x", 3)], "id string, nastaliq string, pos int")
    refined = lexicon.apply_results(rows, answers)
    assert {r["entry_id"]: r["nastaliq_pass2"] for r in refined.collect()} == {"a": "new", "b": "", "c": ""}
    order = spark.createDataFrame([(2, 0), (1, 1), (2, 2)], "page int, ord int")
    found = lexicon.verification(rows, refined, order, 3).orderBy("ord", "line").collect()
    assert [(r["entry_id"], r["nastaliq_verified"]) for r in found] == [("c", "p3"), ("a", "new"), ("b", "p2")]


def test_scoring_end_to_end(spark):
    gold = spark.createDataFrame([("p", "one two three"), ("e", "")], "page_id string, text string")
    runs = spark.createDataFrame([("p", "gemini_v1", "one two"), ("p", "gemini_v2", "one tvvo three"), ("e", "gemini_v1", "x")], "page_id string, tag string, text string")
    pairs = scoring.pair_up(gold, runs)
    scored = scoring.score(pairs)
    assert {(r["page_id"], r["tag"]): (r["errors"], round(r["wer"], 2)) for r in scored.collect()} == {("p", "gemini_v1"): (1, 33.33), ("p", "gemini_v2"): (1, 33.33), ("e", "gemini_v1"): (1, 0.0)}
    assert {(r["page_id"], r["tag"]): r["category"] for r in scoring.mistakes(pairs).collect()} == {("p", "gemini_v1"): "missing", ("p", "gemini_v2"): "letter_or_word", ("e", "gemini_v1"): "extra"}
    assert [r["tag"] for r in scoring.latest_runs(scored.where("page_id = 'p'"), ["page_id"]).collect()] == ["gemini_v2"]


def test_log_appends_do_not_drift(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    row = spark.createDataFrame([(None,) * len(schemas.RUN_LOG)], schemas.RUN_LOG)
    sinks.append_log(row, path, schemas.RUN_LOG)
    sinks.append_log(row.select(*reversed(row.columns)), path, schemas.RUN_LOG)
    with pytest.raises(ValueError, match="cost"):
        sinks.append_log(row.withColumn("cost", F.lit(1)), path, schemas.RUN_LOG)
    assert spark.read.parquet(path).count() == 2


def test_files_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "m.csv").write_text("﻿" + ",".join(schemas.CREDITS.names) + '\n"a, b",x/a,3,1.5,good_text,none,in_scope,c,"n ""q""",m\n', encoding="utf-8")
    row = readers.csv(spark, f"{at}/m.csv", schemas.CREDITS).first()
    assert (row["filename"], row["pages"], row["notes"]) == ("a, b", 3, 'n "q"')
    (tmp_path / "seed.json").write_text('{"font_family": "F",\n "map": {"F001": "x", "F002": ""}}')
    assert {r["code"]: r["text"] for r in readers.seed(spark, f"{at}/seed.json").collect()} == {"F001": "x", "F002": ""}
    assert readers.seed(spark, f"{at}/none.json", must_exist=False).count() == 0
    (tmp_path / "pages").mkdir()
    for k in (1, 2, 12):
        (tmp_path / f"pages/page-{k:04d}.txt").write_text(f"text {k}")
    assert sorted(r["page"] for r in readers.page_texts(spark, f"{at}/pages").collect()) == [1, 2, 12]
    assert sorted(r["page"] for r in readers.page_texts(spark, f"{at}/pages", [2, 12]).collect()) == [2, 12]
    (tmp_path / "runs/pg").mkdir(parents=True)
    for name in ("pg_gold", "pg_gemini_v2_original", "pg_gemini_edited"):
        (tmp_path / f"runs/pg/{name}.txt").write_text(name)
    assert {(r["page_id"], r["tag"]) for r in readers.transcriptions(spark, f"{at}/runs").collect()} == {("pg", None), ("pg", "gemini_v2")}
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.pdf").write_bytes(b"%PDF")
    assert [(r["path"], r["md5"]) for r in readers.binaries(spark, f"{at}/in").collect()] == [("sub/a.pdf", __import__("hashlib").md5(b"%PDF").hexdigest())]
    raw = spark.createDataFrame([("p", "m", "v1", "t")], "page_id string, model string, version string, text string")
    sinks.raw_outputs(raw, f"{at}/raw")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.raw_outputs(raw, f"{at}/raw")


def test_credits(spark):
    made = records.credits(F.lit("anjumshanasi/Kosh.pdf"), F.lit("Kosh.pdf"))
    row = spark.range(1).select(made.alias("c")).select("c.*").first()
    assert row["credits"].startswith("Prof.") and row["notes"] == "Local folder: anjumshanasi/; Dictionary / glossary volume"
    plain = spark.range(1).select(records.credits(F.lit("x.pdf"), F.lit("x.pdf")).alias("c")).select("c.*").first()
    assert plain["credits"] == records.DEFAULT_CREDIT and plain["notes"] == ""


def test_spread_and_box(spark):
    row = spark.range(1).select(F.inline(layout.spread_halves(F.lit(10.0), F.lit(0.0), F.lit(30.0), F.lit(5.0)))).collect()
    assert [(r["half"], r["x0"], r["x1"]) for r in row] == [("a_right", 20.0, 30.0), ("b_left", 10.0, 20.0)]


def test_census_over_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([("2024-01-01 00:01:00", "abc گ"), ("2024-01-01 00:05:00", "x"), ("2024-01-01 00:20:00", "y")], "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    docs.write.parquet(f"{tmp_path}/in")
    query = windowed_census(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), "ts").writeStream.format("memory").queryName("census").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("census").orderBy("start").collect()
    assert [(r["documents"], r["latin_chars"], r["arabic_chars"]) for r in found] == [(2, 4, 1), (1, 1, 0)]
