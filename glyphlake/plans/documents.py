"""Queries over documents, pages, conversations and labels, and DuckDB SQL for each.

The driver's tables hold no Arabic, Devanagari or private-use characters; where an operator counts those, its
class parameter is bound to Latin letters with accents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions import textfn as X
from glyphlake.operators import lexicon, records, triage
from glyphlake.operators.layout import spread_halves

LOWER_ACCENTS, UPPER_ACCENTS = r"\x{00E0}-\x{00FF}", r"\x{00C0}-\x{00DF}"
BOUND_CLASSES = {
    "total_chars": r"[^\t-\r\x{001C}-\x{0020}\x{0085}\x{00A0}]",
    "arabic_chars": f"[{LOWER_ACCENTS}]",
    "devanagari_chars": f"[{UPPER_ACCENTS}]",
    "pua_chars": "[0-9]",
    "replacement_chars": "[%]",
    "latin_chars": "[A-Za-z]",
    "garbage_chars": "[#$&*|]",
}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


def _sql_count(pattern: str, text: str = "text") -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"


def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(c.cast("long").alias(n) for n, c in C.class_counts(F.col("text"), BOUND_CLASSES).items()))


SCRIPT_CENSUS = "SELECT doc_id, " + ", ".join(f"({_sql_count(p)})::BIGINT AS {n}" for n, p in BOUND_CLASSES.items()) + " FROM documents"


def manifest_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes as the manifest counts them, by language."""
    names = ("arabic_chars", "devanagari_chars", "pua_chars", "replacement_chars", "presentation_chars", "latin_chars")
    counts = C.class_counts(F.col("text"), {n: C.MANIFEST_CLASSES[n] for n in names})
    return _table(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(*(F.sum(c).cast("long").alias(n) for n, c in counts.items()))


MANIFEST_CENSUS = (
    "SELECT lang, "
    + ", ".join(
        f"sum({_sql_count('[' + p + ']')})::BIGINT AS {n}"
        for n, p in {"arabic_chars": C.ARABIC, "devanagari_chars": C.DEVANAGARI, "pua_chars": C.PRIVATE_USE, "replacement_chars": C.REPLACEMENT, "presentation_chars": C.PRESENTATION, "latin_chars": C.LATIN}.items()
    )
    + " FROM documents GROUP BY lang"
)

SPACED = "' ' || regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') || ' '"
HITS = " + ".join(f"contains({{}}, '{w}')::INT" for w in C.ENGLISH_WORDS)


def english_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = C.english_hits(F.col("text"))
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hits.alias("hits"), (hits >= 3).cast("int").alias("likely_english"))


ENGLISH_MARKERS = f"WITH d AS (SELECT doc_id, {SPACED} AS s FROM documents), h AS (SELECT doc_id, ({HITS.replace('{}', 's')})::INT AS hits FROM d) SELECT doc_id, hits, (hits >= 3)::INT AS likely_english FROM h"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")
    counts = C.class_counts(F.col("text"), BOUND_CLASSES)
    fonts = F.array("lang")
    docs = docs.withColumn("c", triage.classify(counts, fonts, C.english_hits(F.left("text", F.lit(4000))) >= 3))
    path = F.concat_ws("/", "source", F.concat("lang", F.when(F.col("doc_id") % 7 == 0, "-Dictionary").when(F.col("doc_id") % 11 == 0, "-grammar").otherwise("")))
    parallel = triage.parallel_source(path)
    pages = F.floor(F.col("n_chars") / 40).cast("long")
    docs = docs.select("doc_id", "text", "source", pages.alias("pages"), path.alias("path"), "c.*", parallel.alias("parallel_source"))
    scope = triage.in_scope(F.col("category"), F.col("parallel_source"), F.lit(""))
    return docs.withColumn("in_scope", scope).withColumn("tier", triage.tier(F.col("path"), F.col("in_scope"), F.col("parallel_source"), F.col("pages")))


CLASSIFIED = f"""WITH n AS (SELECT doc_id, source, lang, n_chars, text, {", ".join(f"{_sql_count(p)} AS {k}" for k, p in BOUND_CLASSES.items())},
    {SPACED.replace("text", "left(text, 4000)")} AS s,
    source || '/' || lang || CASE WHEN doc_id % 7 = 0 THEN '-Dictionary' WHEN doc_id % 11 = 0 THEN '-grammar' ELSE '' END AS path FROM documents),
  e AS (SELECT *, (({HITS.replace("{}", "s")}) >= 3)::INT AS eng FROM n),
  k AS (SELECT *, CASE WHEN total_chars < 30 THEN 'image_only,none,none,0'
      WHEN arabic_chars > 20 AND arabic_chars >= pua_chars THEN 'good_text,clean_unicode,perso_arabic,' || eng
      WHEN devanagari_chars > 20 THEN 'good_text,clean_unicode,devanagari,' || eng
      WHEN pua_chars > 20 THEN 'bad_text,pua,legacy_encoded,' || eng
      WHEN eng = 1 THEN 'english_prose,clean_unicode,latin,1'
      ELSE 'bad_text,legacy_8bit,legacy_encoded,' || eng END AS c,
      (contains(lower(path), 'dictionary') OR contains(lower(path), 'kosh') OR contains(lower(path), 'glossar') OR contains(lower(path), 'lughat') OR contains(lower(path), 'vocab'))::INT AS parallel_source FROM e),
  m AS (SELECT doc_id, text, source, (n_chars // 40)::BIGINT AS pages, path, split_part(c, ',', 1) AS category, split_part(c, ',', 2) AS encoding_scheme, split_part(c, ',', 3) AS script_found, split_part(c, ',', 4)::INT AS likely_english, parallel_source FROM k),
  p AS (SELECT *, CASE WHEN category = 'english_prose' AND parallel_source = 0 THEN 0 ELSE 1 END AS in_scope FROM m),
  t AS (SELECT *, CASE WHEN in_scope = 0 THEN 9 WHEN parallel_source = 1 OR contains(lower(path), 'grammar') THEN 1 WHEN pages >= 100 THEN 3 ELSE 2 END AS tier FROM p)"""


def triage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "category", "encoding_scheme", "script_found", "likely_english", "parallel_source", "in_scope", "tier", triage.needs_ocr(F.col("category")).alias("needs_ocr"))


TRIAGE_CLASSIFY = CLASSIFIED + " SELECT doc_id, category, encoding_scheme, script_found, likely_english, parallel_source, in_scope, tier, (category IN ('bad_text', 'image_only'))::INT AS needs_ocr FROM t"


def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: classify every document, keep one of each exact copy, and total by category, script, scheme and tier."""
    manifest = _classified(spark, sf_dir).withColumn("md5", F.md5("text")).drop("text")
    return triage.summary(triage.mark_primary(manifest, "md5", "path", "doc_id"))


TRIAGE_SUMMARY = (
    CLASSIFIED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY length(path), path, doc_id) AS rn FROM t), q AS (SELECT * FROM r WHERE rn = 1),
  b AS (SELECT 'all' AS block, 'all' AS key, pages FROM r UNION ALL SELECT 'category', category, pages FROM q UNION ALL SELECT 'script', script_found, pages FROM q WHERE in_scope = 1 AND script_found <> 'latin'
    UNION ALL SELECT 'scheme', encoding_scheme, pages FROM q UNION ALL SELECT 'needs_ocr', 'all', pages FROM q WHERE in_scope = 1 AND category IN ('bad_text', 'image_only')
    UNION ALL SELECT 'parallel', 'all', pages FROM q WHERE in_scope = 1 AND parallel_source = 1
    UNION ALL SELECT 'tier', tier::VARCHAR, pages FROM q WHERE in_scope = 1 UNION ALL SELECT 'out_of_scope', category, pages FROM r WHERE in_scope = 0)
  SELECT block, key, count(*) AS files, sum(pages)::BIGINT AS pages FROM b GROUP BY block, key"""
)


def garbage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = C.garbage_ratio(F.col("text"), UPPER_ACCENTS)
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(ratio, 6).alias("garbage_ratio"), (ratio > 0.08).cast("int").alias("rejected"))


GARBAGE_GATE = rf"""WITH d AS (SELECT doc_id, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS n, {_sql_count("[^\\x{0000}-\\x{007F}\\x{00C0}-\\x{00DF}]")} AS bad FROM documents)
  SELECT doc_id, round(CASE WHEN n > 0 THEN bad / n ELSE 0.0 END, 6)::DOUBLE AS garbage_ratio, (CASE WHEN n > 0 THEN bad / n ELSE 0.0 END > 0.08)::INT AS rejected FROM d"""


def dedup_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", F.md5("text").alias("md5"))
    return triage.mark_primary(docs, "md5", "source", "doc_id").select("doc_id", "md5", "is_primary")


DEDUP_PRIMARY = "SELECT doc_id, md5(text) AS md5, (row_number() OVER (PARTITION BY md5(text) ORDER BY length(source), source, doc_id) = 1)::INT AS is_primary FROM documents"


def dup_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("md5"))
    return docs.join(triage.duplicate_groups(docs, "md5", "doc_id"), "md5").select("doc_id", "dup_group")


DUP_GROUP_IDS = "WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) SELECT doc_id, 'D' || lpad(dense_rank() OVER (ORDER BY first)::VARCHAR, greatest(2, length(dense_rank() OVER (ORDER BY first)::VARCHAR))::INT, '0') AS dup_group FROM f WHERE n > 1"


def dup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "n_chars", "text")
    groups = docs.groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("copies"), F.max("n_chars").alias("pages")).where("copies > 1")
    return triage.duplicate_totals(groups, "pages")


DUP_TOTALS = "SELECT count(*) AS dup_groups, sum(n - 1)::BIGINT AS redundant_copies, sum((n - 1) * c)::BIGINT AS wasted_pages FROM (SELECT count(*) AS n, max(n_chars) AS c FROM documents GROUP BY md5(text)) WHERE n > 1"


def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a document would be looked at."""
    n = F.size(F.split("text", "\n"))
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", n.alias("pages"), F.explode(X.sampled_pages(n)).alias("page"))


SAMPLED_PAGES = """WITH d AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents),
  s AS (SELECT doc_id, n, i FROM d, range(0, 10) r(i) WHERE n <= 10 AND i < n UNION SELECT doc_id, n, least(n - 1, floor(i * (n / 10.0))) FROM d, range(1, 10) r(i) WHERE n > 10)
  SELECT doc_id, n::INT AS pages, i::INT AS page FROM s"""


def book_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = triage.assemble(_table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")
    return made.select("conv_id", "pages", "chars", F.md5("book").alias("book_md5"), F.length(F.left("book", F.lit(4000))).alias("sample_chars"))


BOOK_ASSEMBLE = "SELECT conv_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS book_md5, least(4000, length(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)))::INT AS sample_chars FROM conversations GROUP BY conv_id"


def page_slice_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations whose sixth to fifteenth turns are clean enough."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    turns = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return triage.gate(turns, "conv_id", "at", "text", 0.02).groupBy("conv_id").agg(F.count("*").alias("turns"))


PAGE_SLICE_GATE = r"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  c AS (SELECT *, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS v, length(text) - length(regexp_replace(text, '[^\x{0000}-\x{007F}]', '', 'g')) AS b, k >= least(5, n - 1) AND k < least(15, n) AS s FROM t),
  g AS (SELECT conv_id, count(*) AS turns, coalesce(sum(CASE WHEN s THEN b END) / nullif(sum(CASE WHEN s THEN v END), 0), 0.0) AS share FROM c GROUP BY conv_id)
  SELECT conv_id, turns FROM g WHERE share <= 0.02"""


def font_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document in the role of fonts: the six most frequent."""
    words = _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "[ \\n]+")).alias("pos", "font"))
    return triage.font_order(words, "doc_id").select("doc_id", F.array_join(F.slice("fonts", 1, 6), "; ").alias("fonts"))


FONT_FREQUENCY = """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS font, unnest(range(0, len(regexp_split_to_array(text, '[ \\n]+')))) AS pos FROM documents),
  c AS (SELECT doc_id, font, count(*) AS n, min(pos) AS first FROM w GROUP BY doc_id, font),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM c)
  SELECT doc_id, string_agg(font, '; ' ORDER BY rn) AS fonts FROM r WHERE rn <= 6 GROUP BY doc_id"""


def landscape_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", F.col("l_quantity").alias("width"), (F.col("l_linenumber") * 6.0).alias("height"))
    return triage.landscape_vote(lines, "l_orderkey")


LANDSCAPE_VOTE = "SELECT l_orderkey, (sum((l_quantity > l_linenumber * 6.0 * 1.15)::INT) * 2 > count(*))::INT AS landscape FROM lineitem GROUP BY l_orderkey"


def headword_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("int").alias("page"), F.regexp_replace("text", r"\.\n", " (roman).\n").alias("text"))
    found = lexicon.parse_lines(pages, r"[A-Za-z\x{00C0}-\x{00FF}]", ("A",))
    return found.select("entry_id", "page", "line", F.md5("devanagari").alias("head"), "roman")


HEADWORD_PARSE = r"""WITH p AS (SELECT doc_id::INT AS page, string_split(regexp_replace(text, '\.\n', ' (roman).' || chr(10), 'g'), chr(10)) AS a FROM documents),
  l AS (SELECT page, unnest(range(1, len(a) + 1)) AS line, trim(unnest(a), ' ' || chr(9) || chr(13)) AS s FROM p),
  f AS (SELECT *, regexp_extract(s, '^([A-Za-z\x{00C0}-\x{00FF}]+(?:\s+[A-Za-z\x{00C0}-\x{00FF}]+)*)\s*(?:\(([A-Za-z][^)]*)\))?(.*)$', ['head', 'roman', 'rest']) AS g FROM l
    WHERE s <> '' AND NOT regexp_matches(s, '^\[\d+\]\s*$') AND NOT regexp_matches(s, '^[A-Za-z\x{00C0}-\x{00FF}]\s*/\s*[A-Za-z/]') AND s <> 'A' AND regexp_matches(s, '^[A-Za-z\x{00C0}-\x{00FF}]'))
  SELECT 'p' || lpad(page::VARCHAR, greatest(4, length(page::VARCHAR))::INT, '0') || ':L' || line AS entry_id, page, line::INT AS line, md5(trim(g.head)) AS head, trim(g.roman) AS roman FROM f WHERE NOT regexp_matches(trim(g.rest), '^\d')"""


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.regexp_replace(F.regexp_replace("text", "\n", " "), "[,|]", ")").alias("raw"))
    return lines.select("doc_id", F.md5(X.english_snippet(F.regexp_replace("raw", "é", "nm:"))).alias("snippet"))


SNIPPET = r"""WITH l AS (SELECT doc_id, replace(regexp_replace(replace(text, chr(10), ' '), '[,|]', ')', 'g'), 'é', 'nm:') AS raw FROM documents)
  SELECT doc_id, md5(trim(CASE WHEN regexp_matches(raw, '(nm:|nf:|v:|adj\.|adv\.|conj\.|A\.)\s*(.{0,120})') THEN regexp_extract(raw, '(nm:|nf:|v:|adj\.|adv\.|conj\.|A\.)\s*(.{0,120})', 2) ELSE regexp_extract(raw, '\)\s*([A-Za-z][^.\n]{3,80})', 1) END)) AS snippet FROM l"""


def verify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four languages, asked for in a given order, cut at 120 rows, with a label where there is one."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "source").select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("page"), F.col("doc_id").alias("line"), F.col("source").alias("nastaliq_pass1"))
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("entry_id"), F.when(F.col("quality") == 1, "good").otherwise("").alias("nastaliq_pass2"))
    order = spark.createDataFrame([("fr", 0), ("de", 1), ("fr", 2), ("en", 3)], "page string, ord int")
    return lexicon.verification(docs, labels, order, 120).select("entry_id", "page", "ord", "nastaliq_pass2", "nastaliq_verified")


VERIFY_BATCH = """WITH o(page, ord) AS (VALUES ('fr', 0), ('de', 1), ('fr', 2), ('en', 3)),
  a AS (SELECT d.doc_id AS entry_id, lang AS page, ord, source FROM documents d JOIN o ON lang = page ORDER BY ord, doc_id LIMIT 120)
  SELECT entry_id, page, ord, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS nastaliq_pass2, CASE WHEN quality = 1 THEN 'good' ELSE source END AS nastaliq_verified FROM a LEFT JOIN labels l ON l.doc_id = entry_id"""


def verify_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_batch(spark, sf_dir).groupBy("page").agg(F.count("*").alias("entries"))


VERIFY_BATCH_COUNTS = VERIFY_BATCH.replace("SELECT entry_id, page, ord, CASE", "SELECT page, count(*) AS entries FROM (SELECT page, CASE").replace("= entry_id", "= entry_id) GROUP BY page")


def upsert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").withColumn("origin", F.lit("label"))
    docs = _table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit("rule").alias("origin"))
    return lexicon.upsert(labels, docs, "doc_id")


UPSERT_UNION = "SELECT doc_id, quality, 'label' AS origin FROM labels UNION ALL SELECT doc_id, (n_chars > 500)::INT, 'rule' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text length of each source, at its first place."""
    return lexicon.last_wins(_table(spark, sf_dir, "documents", "source", "doc_id", "lang", "n_chars"), "source", "doc_id")


LAST_WINS = "SELECT source, min(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source"


def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the documents of each language in batches of twenty."""
    rows = lexicon.batches(_table(spark, sf_dir, "documents", "doc_id", "lang", "source"), ["lang"], ["doc_id"], 20)
    return rows.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


MODEL_BATCHES = "SELECT lang, batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT lang, doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 20)::INT AS batch FROM documents) GROUP BY lang, batch"


def semi_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "lang").join(_table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")


SEMI_DOCS = "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def anti_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "lang").join(_table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


ANTI_DOCS = SEMI_DOCS.replace("WHERE EXISTS", "WHERE NOT EXISTS")


def credits_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ((("example.com", "site1"), "one"), (("7", "8"), "two"), (("org",), "three"))
    notes = ((("1",), "has one"), (("page",), "a page"))
    made = records.credits(F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id").cast("string"), rules, notes, ("a", "b"), "nobody")
    return _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", made.alias("c")).select("page_id", "c.credits", "c.notes")


CREDITS_RULES = """WITH p AS (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '') || ' ' || page_id) AS low, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^(.*)/[^/]*$', 1) AS folder FROM pages)
  SELECT page_id, coalesce(nullif(concat_ws('; ', CASE WHEN contains(low, 'example.com') OR contains(low, 'site1') THEN 'one' END, CASE WHEN contains(low, '7') OR contains(low, '8') THEN 'two' END, CASE WHEN contains(low, 'org') THEN 'three' END), ''), 'nobody') AS credits,
  concat_ws('; ', CASE WHEN folder = 'a' THEN 'Local folder: a/' END, CASE WHEN folder = 'b' THEN 'Local folder: b/' END, CASE WHEN contains(low, '1') THEN 'has one' END, CASE WHEN contains(low, 'page') THEN 'a page' END) AS notes FROM p"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", X.slug(F.col("url")).alias("slug"))


SLUGS = r"""WITH n AS (SELECT page_id, split_part(url, '/', -1) AS name FROM pages), s AS (SELECT page_id, lower(regexp_replace(regexp_replace(CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END, '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM n)
  SELECT page_id, CASE WHEN slug = '' THEN 'book' ELSE slug END AS slug FROM s"""


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    box = spread_halves(F.col("p_size") * 1.0, F.lit(0.0), F.col("p_size") + F.col("p_retailprice"), F.col("p_size") * 2.0)
    return rows.select("p_partkey", F.inline(box)).select("p_partkey", "half", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), "y1")


HALVES = """WITH p AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS a, p_size + p_retailprice AS b, p_size * 2.0::DOUBLE AS y1 FROM part)
  SELECT p_partkey, 'a_right' AS half, round(a + (b - a) / 2, 4) AS x0, round(b, 4) AS x1, y1 FROM p UNION ALL SELECT p_partkey, 'b_left', round(a, 4), round(a + (b - a) / 2, 4), y1 FROM p"""

QUERIES = {f.__name__: f for f in (script_census, manifest_census, english_markers, triage_classify, triage_summary, garbage_gate, dedup_primary, dup_group_ids, dup_totals, sampled_pages, book_assemble, page_slice_gate, font_frequency, landscape_vote, headword_parse, snippet, verify_batch, verify_batch_counts, upsert_union, last_wins, model_batches, semi_docs, anti_docs, credits_rules, slugs)} | {"spread_halves": halves}
ORACLE = {
    "script_census": SCRIPT_CENSUS,
    "manifest_census": MANIFEST_CENSUS,
    "english_markers": ENGLISH_MARKERS,
    "triage_classify": TRIAGE_CLASSIFY,
    "triage_summary": TRIAGE_SUMMARY,
    "garbage_gate": GARBAGE_GATE,
    "dedup_primary": DEDUP_PRIMARY,
    "dup_group_ids": DUP_GROUP_IDS,
    "dup_totals": DUP_TOTALS,
    "sampled_pages": SAMPLED_PAGES,
    "book_assemble": BOOK_ASSEMBLE,
    "page_slice_gate": PAGE_SLICE_GATE,
    "font_frequency": FONT_FREQUENCY,
    "landscape_vote": LANDSCAPE_VOTE,
    "headword_parse": HEADWORD_PARSE,
    "snippet": SNIPPET,
    "verify_batch": VERIFY_BATCH,
    "verify_batch_counts": VERIFY_BATCH_COUNTS,
    "upsert_union": UPSERT_UNION,
    "last_wins": LAST_WINS,
    "model_batches": MODEL_BATCHES,
    "semi_docs": SEMI_DOCS,
    "anti_docs": ANTI_DOCS,
    "credits_rules": CREDITS_RULES,
    "slugs": SLUGS,
    "spread_halves": HALVES,
}
