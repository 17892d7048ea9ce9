"""Scalars against Python's own semantics, on literals."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions import textfn as X
from glyphlake.functions import udfs
from glyphlake.operators.decode import char_of, codepoint


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())).select(column.alias("x")).first()["x"]


TEXTS = ["", " ", "گوجری زبان", "देवनागरी", "a b c", "x�￿", "", "ﭐﮀﻼ", "naïve “q”", "ᝀ junk ɓ", "plain ascii 123", "line\x0bmore\x85end z"]


def test_class_counts(spark):
    found = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", *(c.alias(n) for n, c in C.class_counts(F.col("text")).items())).collect()
    for row in found:
        visible = [c for c in TEXTS[row["i"]] if not c.isspace()]
        code = [ord(c) for c in visible]
        assert row["total_chars"] == len(visible)
        assert row["arabic_chars"] == sum(0x600 <= c <= 0x6FF or 0x750 <= c <= 0x77F for c in code)
        assert row["devanagari_chars"] == sum(0x900 <= c <= 0x97F for c in code)
        assert row["pua_chars"] == sum(0xE000 <= c <= 0xF8FF for c in code)
        assert row["presentation_chars"] == sum(0xFB50 <= c <= 0xFDFF or 0xFE70 <= c <= 0xFEFF for c in code)
        assert row["replacement_chars"] == sum(c in (0xFFFD, 0xFFFF) for c in code)


def test_garbage_differs_between_manifest_and_extractor(spark):
    text = "abé�"
    assert one(spark, C.class_counts(F.col("t"))["garbage_chars"], t=text) == 0
    assert one(spark, C.garbage_ratio(F.col("t")), t=text) == pytest.approx(2 / 4)
    assert one(spark, C.garbage_ratio(F.col("t")), t="") == 0.0


def test_lines_and_words_are_pythons(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "a\n", "a\n\nb", "\n", "a\r\nb\rc"])], "i int, t string").select("t", X.lines(F.col("t")).alias("l"), X.words(F.col("t")).alias("w"), X.strip(F.col("t")).alias("s"))
    for row in rows.collect():
        assert row["l"] == row["t"].splitlines(), repr(row["t"])
        assert row["w"] == row["t"].split(), repr(row["t"])
        assert row["s"] == row["t"].strip()


def test_scoring_tokens(spark):
    text = "first  line :\n[illustration: a tree]\n[[dropped guess]]\nkept [[guess]] word ، next\n\n[Photo]\n"
    assert one(spark, X.scoring_tokens(F.col("t")), t=text) == ["first", "line:", "kept", "guess", "word،", "next"]
    assert one(spark, X.scoring_tokens(F.col("t")), t="") == []


def test_substitution_categories(spark):
    cases = {("گُل", "گل"): "diacritic", ("محمدؐ", "محمد"): "honorific", ("ہم", "ھم"): "heh", ("۱۲", "12"): "digit_system", ("word,", "word"): "punct_other", ("one", "two"): "letter_or_word"}
    for (gold, found), wanted in cases.items():
        assert one(spark, X.substitution_category(F.col("g"), F.col("f")), g=gold, f=found) == wanted


def test_slug_and_snippet_and_tag(spark):
    for path, wanted in {"a/b/My Book (1).pdf": "my-book-1", "x/--.pdf": "book", "Name.v2.pdf": "name-v2", "گوجری.pdf": "book", ".hidden": "hidden"}.items():
        assert one(spark, X.slug(F.col("p")), p=path) == wanted
    assert one(spark, X.english_snippet(F.col("p")), p="शब्द (shabd) nm: a word; sound") == "a word; sound"
    assert one(spark, X.english_snippet(F.col("p")), p="शब्द (shabd) Some gloss here. more") == "Some gloss here"
    assert one(spark, X.english_snippet(F.col("p")), p="nothing") == ""
    assert one(spark, X.tag_of_run(F.col("p"), F.col("s")), p="page", s="page_gemini_v2_original") == "gemini_v2"


def test_sampled_pages(spark):
    for n in range(0, 60):
        wanted = list(range(n)) if n <= 10 else sorted({min(n - 1, int(i * (n / 10))) for i in range(10)})[1:]
        assert one(spark, X.sampled_pages(F.col("n")), n=n) == wanted


def test_json_array(spark):
    schema = "array<struct<id string, nastaliq string>>"
    assert one(spark, X.json_array(F.col("t"), schema), t='```json\n[{"id": "a", "nastaliq": "b"}]\n```')[0]["nastaliq"] == "b"
    with pytest.raises(Exception, match="JSON array"):
        one(spark, X.json_array(F.col("t"), schema), t='{"id": 1}')


def test_normal_forms_and_characters(spark):
    assert one(spark, udfs.nfc(F.col("t")), t="é") == "é"
    for c in "aé گ\U0001f600":
        assert one(spark, codepoint(F.col("t")), t=c) == ord(c)
        assert one(spark, char_of(F.col("t")), t=ord(c)) == c
    assert one(spark, udfs.nfkc(F.col("t")), t="ﻼ") == unicodedata.normalize("NFKC", "ﻼ")
    assert one(spark, C.hex_key(F.col("t")), t=0xF05D) == "F05D" and one(spark, C.hex_key(F.col("t")), t=7) == "0007" and one(spark, C.hex_key(F.col("t")), t=0x1F600) == "1F600"
    assert one(spark, C.glyph_key(F.col("f"), F.lit(5)), f="ABCDEF+Urdu,Bold") == "Urdu:5"


WORDS = st.lists(st.sampled_from(["a", "b", "ab", "گ", "c"]), max_size=9)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_edit_script_is_shortest_and_rebuilds_both_sides(a, b):
    script = udfs.edit_script(a, b)
    assert sum(o != "eq" for o, _, _ in script) == plain_distance(a, b)
    assert [r for _, r, _ in script if r is not None] == a and [h for _, _, h in script if h is not None] == b
    assert udfs.join_splits(script) == script


def test_ties_prefer_deletions_at_the_end():
    assert udfs.edit_script(["a", "a"], ["a"]) == [("eq", "a", "a"), ("del", "a", None)]
    assert udfs.edit_script(["a"], ["a", "a"]) == [("eq", "a", "a"), ("ins", None, "a")]


def test_join_splits_on_made_scripts():
    assert udfs.join_splits([("del", "to", None), ("del", "day", None), ("ins", None, "today")]) == [("split_join", "to day", "today")]
    assert udfs.join_splits([("ins", None, "ab"), ("del", "a", None), ("del", "b", None), ("eq", "x", "x")]) == [("split_join", "a b", "ab"), ("eq", "x", "x")]
    assert udfs.join_splits([("del", "a", None), ("ins", None, "b")]) == [("del", "a", None), ("ins", None, "b")]


def test_word_distance_needs_no_python(spark):
    random.seed(3)
    pairs = [([random.choice(["x", "y", "گوجری", "zz", "é"]) for _ in range(random.randint(0, 12))], [random.choice(["x", "y", "گوجری", "w"]) for _ in range(random.randint(0, 12))]) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").select("i", X.word_distance(F.col("a"), F.col("b")).alias("d"), udfs.align("a", "b").alias("s")).collect()
    for r in rows:
        wanted = plain_distance(*pairs[r["i"]])
        assert r["d"] == wanted and sum(s["op"] != "eq" for s in r["s"]) == wanted


def test_model_calls_are_tried_again_and_fail_whole(spark):
    batches = spark.createDataFrame([(1, "p"), (2, "q")], "batch long, prompt string")
    assert {r["answer"] for r in udfs.call_model(batches, lambda p: p.upper(), wait=0).collect()} == {"P", "Q"}

    def broken(prompt):
        raise ValueError("no answer")

    with pytest.raises(Exception, match="no answer"):
        udfs.call_model(batches, broken, tries=2, wait=0).collect()


def test_marks_and_letters(spark):
    assert one(spark, C.combining(F.col("t")), t="ًّ") and not one(spark, C.combining(F.col("t")), t="") and not one(spark, C.combining(F.col("t")), t="aّ")
    assert one(spark, C.arabic_letter(F.col("t")), t="ب") and not one(spark, C.arabic_letter(F.col("t")), t="۱")
    assert re.search("x", "x")
