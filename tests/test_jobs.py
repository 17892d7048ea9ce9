"""Whole jobs on literal tables."""

import json

from pyspark.sql import functions as F

from glyphlake.plans import jobs
from glyphlake.sources import schemas


def test_manifest_extract_and_credits(spark):
    arabic, english = "گوجری زبان کا لفظ " * 12, "It is the word of a man and it was in the house that he went to for it. " * 3
    files = spark.createDataFrame([("B/kosh.pdf", 1.0, "m1", 12, ""), ("a/kosh.pdf", 1.0, "m1", 12, ""), ("x/prose.pdf", 2.0, "m2", 1, ""), ("x/broken.pdf", 0.1, "m3", 0, "cannot open"), ("x/scan.pdf", 9.0, "m4", 120, "")], "path string, size_mb double, md5 string, pages int, error string")
    pages = [(p, k, arabic, 100.0, 80.0, ["F"]) for p in ("B/kosh.pdf", "a/kosh.pdf") for k in range(12)] + [("x/prose.pdf", 0, english, 80.0, 100.0, ["Times"])] + [("x/scan.pdf", k, "", 80.0, 100.0, []) for k in range(120)]
    pages = spark.createDataFrame(pages, "path string, page int, text string, width double, height double, fonts array<string>")
    manifest = jobs.build_manifest(files, pages)
    rows = {r["path"]: r for r in manifest.collect()}
    assert {p: (r["category"], r["in_scope"], r["tier"], r["is_primary"], r["dup_group"], r["page_spread"]) for p, r in rows.items()} == {
        "B/kosh.pdf": ("good_text", 1, 1, 1, "D01", 1),
        "a/kosh.pdf": ("good_text", 1, 1, 0, "D01", 1),
        "x/prose.pdf": ("english_prose", 0, 9, 1, "", 0),
        "x/broken.pdf": ("image_only", 0, 9, 1, "", 0),
        "x/scan.pdf": ("image_only", 1, 3, 1, "", 0),
    }
    texts, books = jobs.extract_clean_text(manifest, pages)
    assert texts.count() == 12 and books.first()["doc_id"] == "kosh" and books.first()["pages"] == 12
    credits = jobs.build_credits(manifest, files.where("path like 'B%'").select("path")).collect()
    assert [(r["filename"], r["scope"], r["notes"]) for r in credits] == [("kosh.pdf", "in_scope", "Dictionary / glossary volume")]


def test_scores(spark):
    rows = [("p", None, "one two three four"), ("p", "gemini_3.6_flash_v1", "one two"), ("p", "gemini_3.6_flash_v2", "one two three five"), ("p", "composer_v1", "one two three four")]
    out = jobs.score_gold(spark.createDataFrame(rows, "page_id string, tag string, text string"))
    assert {r["family"]: (r["errors"], r["gold_words"]) for r in out["families"].collect()} == {"gemini": (3, 8), "composer": (0, 4)}
    assert [(r["tag"], r["errors"]) for r in out["latest"].collect()] == [("gemini_3.6_flash_v2", 1)]
    assert out["chat_totals"].first()["wer"] == 0.0 and out["samples"].count() == 3


def test_glyph_census(spark):
    font = "A+UrduTypesetting"
    rows = [(1, 0.0, 10.0 * k, 10.0 * k + 5, 9.0, font, 7, 0x628) for k in range(9)] + [(2, 0.0, 0.0, 5.0, 9.0, font, 7, 0xFFFD), (2, 0.0, 20.0, 25.0, 9.0, font, 8, 0xFFFD), (2, 0.0, 40.0, 45.0, 9.0, "Times", 9, 65)]
    out = jobs.glyph_census(spark.createDataFrame(rows, schemas.GLYPHS), spark.createDataFrame([("UrduTypesetting:1", "x")], "key string, text string"))
    seed = {r["key"]: (r["text"], r["evidence"]) for r in out["seed"].collect()}
    assert seed["UrduTypesetting:7"] == ("ب", "auto ToUnicode U+0628 n=9/10 first_p001") and len(seed) == 2
    found = out["coverage"].first()
    assert (found["mapped_n"], found["unknown_n"], found["unknown_keys"], found["unknown_once"]) == (10, 1, 1, 1)
    boxes = jobs.crop_boxes(spark.createDataFrame(rows, schemas.GLYPHS), out["unknown"], 100.0, 100.0, 5).collect()
    assert [(r["key"], r["box"]["left"], r["box"]["top"]) for r in boxes] == [("UrduTypesetting:8", 16.0, 0.0)]


def test_lexicon_passes(spark):
    pages = spark.createDataFrame([(1, "भाषा (bhasha) nm: language\nपानी water"), (2, "घर (ghar) nm: house")], "page int, text string")
    first = jobs.lexicon_pass1(pages, lambda w: w[::-1])
    assert {r["devanagari"]: r["nastaliq_pass1"] for r in first.collect()} == {"भाषा": "भाषा"[::-1], "पानी": "पानी"[::-1], "घर": "घर"[::-1]}

    def model(prompt):
        asked = json.loads(prompt.removeprefix("Q: "))
        return "```json\n" + json.dumps([{"id": a["id"], "nastaliq": a["english"] or "none"} for a in asked if a["roman"]]) + "\n```"

    second = jobs.lexicon_pass2(first, "Q: ", model)
    assert {r["entry_id"]: r["nastaliq_pass2"] for r in second.collect()} == {"p0001:L1": "language", "p0001:L2": "", "p0002:L1": "house"}


def test_candidates(spark):
    wanted = spark.createDataFrame([("one", "a.pdf", 3, False, "n"), ("two", "b.pdf", 4, True, "n"), ("gone", "c.pdf", 1, False, "n")], "id string, source_pdf string, page_1idx int, spread boolean, note string")
    present = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "path string")
    assert [r["id"] for r in jobs.gold_candidates(wanted, present).orderBy("id").collect()] == ["one", "two_a_right", "two_b_left"]
    assert F.lit(1) is not None
