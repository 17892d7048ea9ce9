"""PDF and image adapters with stand-ins for the libraries, model calls on images, and small helpers."""

import datetime

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import textfn as X
from glyphlake.functions.udfs import call_image_model
from glyphlake.operators import decode, lexicon, ranking, scoring, triage
from glyphlake.sources import adapters, pagefiles, readers, sinks


def stand_in():
    """A library whose files are text: pages by form feeds, "bad" does not open, a page "broken" fails."""
    from types import SimpleNamespace as N

    class Page:
        def __init__(self, text):
            self.text, self.rect = text, N(width=100.0, height=50.0)

        def get_text(self):
            if self.text == "broken":
                raise ValueError("page")
            return self.text

        def get_fonts(self):
            return [(7, "n/a", "Type0", "AA+F", "F1", "Identity-H"), (8, "n/a", "Type1", "G", "F2", "WinAnsi")]

        def get_texttrace(self):
            return [{"font": "F", "chars": [(1576, 5, (0, 0), (1.0, 2.0, 3.0, 4.0)), ("x", 5, (0, 0), (1.0, 2.0, 3.0, 4.0)), (65, 6, (0, 0), (1.0,)), (66,)]}, {"font": None, "chars": None}]

        def get_pixmap(self, matrix):
            return N(tobytes=lambda kind: f"{kind}:{self.text}:{matrix}".encode())

    class Book:
        def __init__(self, stream):
            if stream == b"bad":
                raise ValueError("cannot open")
            self.pages = [Page(t) for t in stream.decode().split("\f")]
            self.page_count = len(self.pages)

        def __getitem__(self, k):
            return self.pages[k]

        def xref_object(self, xref):
            return "<< /ToUnicode 9 0 R >>" if xref == 7 else "<< >>"

    return N(open=lambda stream, filetype: Book(bytes(stream)), Matrix=lambda a, b: (a, b))


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("a.pdf", b"one\fbroken\fthree"), ("b.pdf", b"bad")], "path string, content binary")


def test_pages_of_files(files):
    rows = adapters.pdf_pages(files, stand_in()).orderBy("path", "page").collect()
    assert [(r["path"], r["page"], r["pages"], r["text"], r["error"]) for r in rows] == [("a.pdf", 1, 3, "one", ""), ("a.pdf", 3, 3, "three", ""), ("b.pdf", None, 0, None, "cannot open")]
    assert rows[0]["fonts"] == ["AA+F", "G"] and (rows[0]["width"], rows[0]["height"]) == (100.0, 50.0)


def test_fonts_of_files(files):
    rows = adapters.pdf_fonts(files.where("path = 'a.pdf'"), stand_in()).where("page = 1").orderBy("xref").collect()
    assert [(r["name"], r["type"], r["encoding"], r["to_unicode"]) for r in rows] == [("AA+F", "Type0", "Identity-H", True), ("G", "Type1", "WinAnsi", False)]


def test_traced_glyphs_without_malformed_ones(files):
    trace = adapters.pdf_trace(files.where("path = 'a.pdf'"), stand_in()).where("page = 1")
    rows = decode.traced_glyphs(trace).collect()
    assert [(r["y0"], r["x0"], r["x1"], r["y1"], r["font"], r["gid"], r["ucs"]) for r in rows] == [(2.0, 1.0, 3.0, 4.0, "F", 5, 1576)]


def test_rendered_pages(spark):
    wanted = spark.createDataFrame([("a.pdf", b"one\ftwo\fthree", 3), ("a.pdf", b"one\ftwo\fthree", 9)], "path string, content binary, page int")
    rows = adapters.rendered(wanted, 2.0, stand_in()).collect()
    assert {r["page"]: bytes(r["image"]) for r in rows} == {3: b"png:three:(2.0, 2.0)", 9: b"png:two:(2.0, 2.0)"}


def test_cropped_images(spark):
    from types import SimpleNamespace as N

    def picture(stream):
        data = stream.read()
        return N(crop=lambda box: N(save=lambda out, kind: out.write(f"{kind}{box}".encode() + data)))

    images = spark.createDataFrame([("x", b"im", 1, 2, 3, 4)], "id string, image binary, left int, top int, right int, bottom int")
    assert bytes(adapters.cropped(images, N(open=picture)).first()["image"]) == b"PNG(1, 2, 3, 4)im"


def test_absent_libraries_are_an_error(files):
    if adapters.fitz is None:
        with pytest.raises(RuntimeError, match="not installed"):
            adapters.pdf_pages(files)


def test_models_read_images_with_retries(spark):
    images = spark.createDataFrame([("p", "read", b"abc")], "id string, prompt string, image binary")
    made = call_image_model(images, lambda prompt, image: {"text": f"{prompt}{len(image)}", "input_tokens": 1, "output_tokens": 2, "stop_reason": "end"}).first()
    assert (made["id"], made["text"], made["output_tokens"]) == ("p", "read3", 2)

    def fails(prompt, image):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        call_image_model(images, fails, tries=2, wait=0.0).collect()


def test_two_models_on_the_same_gold(spark):
    rows = [("p", "a", "one two three".split(), "one tvo three".split()), ("p", "b", "one two three".split(), "one tvo".split())]
    pairs = spark.createDataFrame(rows, "page_id string, tag string, gold array<string>, hyp array<string>")
    found = scoring.agreement(scoring.two_models(pairs, "a", "b")).first()
    assert (found["gold_words"], found["agree"], found["agree_wrong"]) == (3, 2, 1)


def test_unfinished_sorted_maps_quality_and_time(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "page int")
    at = f"file://{tmp_path}/out"
    assert sinks.unfinished(rows, spark, at, "page").count() == 2
    rows.where("page = 1").write.parquet(at)
    assert [r["page"] for r in sinks.unfinished(rows, spark, at, "page").collect()] == [2]
    one = spark.range(1)
    assert list(one.select(sinks.sorted_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("m")).first()["m"]) == ["a", "b"]
    assert one.select(X.iso_utc(F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5))).alias("t")).first()["t"] == "2024-01-02T03:04:05+00:00"
    kinds = [lexicon.quality(*(F.lit(x) for x in c)) for c in (("v", "a", "b"), (None, "a", "b"), ("", "a", "a"), ("", "a", ""))]
    assert list(one.select(*kinds).first()) == ["human_verified", "pass2_refined", "pass1_kept", "pass1_kept"]


def test_page_files_keep_their_text(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "a\nb"), ("d", 2, "c\n"), ("d", 3, ""), ("d", 4, None)], "doc_id string, page int, text string")
    sinks.page_texts(rows, f"file://{tmp_path}/p")
    assert {r["page"]: r["text"] for r in readers.page_folder(spark, f"file://{tmp_path}/p").collect()} == {1: "a\nb\n", 2: "c\n", 3: "\n", 4: "\n"}


def test_page_files_cost_one_file_and_no_task_each(spark, tmp_path):
    rows = spark.range(700).select((F.col("id") % 90).alias("doc_id"), F.expr("int(id div 90)").alias("page"), F.concat(F.lit("t"), "id").alias("text"))
    sinks.page_texts(rows, f"file://{tmp_path}/p")
    folders = [d for d in (tmp_path / "p").glob("doc_id=*/page=*")]
    assert len(folders) == 700 and all(len(list(d.iterdir())) == 1 for d in folders) and (tmp_path / "p/_SUCCESS").exists()
    found = readers.page_folder(spark, f"file://{tmp_path}/p")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((str(k % 90), k // 90, f"t{k}\n") for k in range(700))


ODD = ["a/b=c%", "..", "é\n\t", "__HIVE", "a b", "{x}[^]'\"#*?:\\\x7f"]


def test_page_files_of_odd_names_and_repeated_pages(spark, tmp_path):
    rows = [(d, p, f"{d}{p}") for d in ODD for p in (-1, 0, 7)] + [(None, 1, "b"), ("", 1, "a\n"), (pagefiles.NONE, 1, None), ("d", None, "x"), ("d", 2, "two"), ("d", 2, "again\n")]
    df, at = spark.createDataFrame(rows, "doc_id string, page int, text string"), f"file://{tmp_path}/p"
    sinks.page_texts(df, at)
    found = sorted((r["doc_id"] or "", -9 if r["page"] is None else r["page"], r["text"]) for r in readers.page_folder(spark, at).collect())
    assert found == sorted([(d, p, f"{d}{p}\n") for d in ODD for p in (-1, 0, 7)] + [("", 1, "\na\nb\n"), ("d", -9, "x\n"), ("d", 2, "again\ntwo\n")])
    # Java finds no names beyond ASCII where the locale is POSIX.
    spark_reads = spark.read.schema("value string, doc_id string, page int").text(at, wholetext=True).where("doc_id is null or doc_id not like 'é%'").collect()
    assert sorted((r["doc_id"] or "", -9 if r["page"] is None else r["page"], r["value"]) for r in spark_reads) == [r for r in found if r[0] != ODD[2]]


def test_page_files_replace_what_was_there_when_all_are_written(spark, tmp_path):
    def rows(*pages):
        return spark.createDataFrame([("d", p, f"t{p}") for p in pages], "doc_id string, page int, text string")

    at = f"file://{tmp_path}/p"
    sinks.page_texts(rows(1, 2), at)
    with pytest.raises(Exception, match="stop"):
        sinks.page_texts(rows(1, 3).withColumn("text", F.when(F.col("page") == 3, F.raise_error(F.lit("stop"))).otherwise("new")), at)
    assert sorted(r["text"] for r in readers.page_folder(spark, at).collect()) == ["t1\n", "t2\n"]
    sinks.page_texts(rows(3), at)
    assert [tuple(r) for r in readers.page_folder(spark, at).collect()] == [("d", 3, "t3\n")]
    sinks.page_texts(rows(), at)
    assert readers.page_folder(spark, at).collect() == [] and [p.name for p in tmp_path.iterdir()] == ["p"]


def test_page_files_in_another_file_system(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pages.link./in", f"file://{tmp_path}")
    rows = spark.createDataFrame([("d/e", 1, "a"), ("d/e", 2, None), (None, 3, "c\n")], "doc_id string, page int, text string")
    sinks.page_texts(rows, "viewfs://pages/in/p")
    for at in ("viewfs://pages/in/p", f"file://{tmp_path}/p"):
        assert {(r["doc_id"], r["page"], r["text"]) for r in readers.page_folder(spark, at).collect()} == {("d/e", 1, "a\n"), ("d/e", 2, "\n"), (None, 3, "c\n")}


def test_numbers_within_groups(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [(None, k) for k in range(7)] + [("b", 3)], "g string, v int").repartition(6)
    found = ranking.group_index(rows, ["g"], ["v"], "n").collect()
    assert sorted((r["g"] or "", r["n"], r["v"]) for r in found) == sorted([("a", k, k) for k in range(50)] + [("", k, k) for k in range(7)] + [("b", 0, 3)])
    clash = lexicon.batches(rows.withColumn("place", F.lit(1)), ["g"], ["v"], 20)
    assert clash.columns == ["g", "v", "place", "batch"] and clash.where("g = 'a' and batch = 2").count() == 10


def test_helper_columns_do_not_clash(spark):
    pages = spark.createDataFrame([("d", 0, "abc", 1, 2), ("e", 0, "￿￿￿", 1, 2)], "doc string, page int, text string, share int, n int")
    kept = triage.gate(pages, "doc", "page", "text")
    assert kept.columns == pages.columns and [r["doc"] for r in kept.collect()] == ["d"]
    scored = spark.createDataFrame([("p", "v1", 5), ("p", "v2", 6)], "page_id string, tag string, rank int")
    assert [tuple(r) for r in scoring.latest_runs(scored, ["page_id"]).collect()] == [("p", "v2", 6)]
    marked = triage.mark_primary(spark.createDataFrame([("m", "bb", 1), ("m", "a", 2), (None, "c", 3), (None, "d", 4)], "md5 string, path string, first int"), "md5", "path")
    assert {(r["path"], r["first"], r["is_primary"]) for r in marked.collect()} == {("bb", 1, 0), ("a", 2, 1), ("c", 3, 1), ("d", 4, 1)}


def test_distance_of_rows_from_long_lists(spark):
    words = [f"w{k}" for k in range(60_000)]
    row = spark.createDataFrame([(words, words[1:] + ["x"])], "a array<string>, b array<string>").select(X.word_distance(F.slice("a", 59_000, 300), F.slice("b", 59_000, 300)).alias("d")).first()
    assert row["d"] == 2
