"""Queries over events, word sequences, glyph keys and numbers, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions import textfn as X
from glyphlake.functions.udfs import align
from glyphlake.operators import decode, layout, records, scoring

LETTERS = r"[^A-Za-z0-9\x{00C0}-\x{00FF}]"
ACCENTS = "[éèêñçäöüß]"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def line_filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.scoring_tokens(F.col("text"), ":,")
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens"))


LINE_FILTER_TOKENS = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^\[(illustration|photo|blank|badge|footer|stamp|handwritten|oval|logo)[:\]]') AND NOT (s[1] = '[' AND s[-1] = ']')) AS a FROM documents),
  t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(a, ' '), '\[\[([^\]]+)\]\]', '\1', 'g'), '[ \t\n\r\f\v]+([:,])', '\1', 'g'), '([:,])[ \t\n\r\f\v]+', '\1 ', 'g') AS s FROM l),
  w AS (SELECT doc_id, list_filter(regexp_split_to_array(s, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM t)
  SELECT doc_id, len(w)::INT AS n, md5(coalesce(array_to_string(w, ' '), '')) AS tokens FROM w"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words next to those of the turn before it, as a page's gold and a run of some model."""
    # A number of partitions that is named stays: distances cost far more than the few bytes they are of.
    dealt = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    turns = dealt.withColumn("w", F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    tag = F.concat(F.when(F.col("turn") % 3 == 0, "gemini_").when(F.col("turn") % 3 == 1, "sonnet_4.6_").otherwise("composer_"), F.when(F.col("turn") % 2 == 0, "v2").otherwise("v1"))
    return turns.select("conv_id", "turn", tag.alias("tag"), before.alias("gold"), F.col("w").alias("hyp")).where("gold is not null")


#: Distances by a table whose rows are built one after another.
TURNS = """WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS h FROM conversations),
  p AS (SELECT conv_id, turn, (CASE WHEN turn % 3 = 0 THEN 'gemini_' WHEN turn % 3 = 1 THEN 'sonnet_4.6_' ELSE 'composer_' END) || (CASE WHEN turn % 2 = 0 THEN 'v2' ELSE 'v1' END) AS tag, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS r, h FROM t),
  d AS (SELECT conv_id, turn, 0::BIGINT AS i, unnest(range(0, len(h) + 1)) AS j, unnest(range(0, len(h) + 1)) AS c FROM p WHERE r IS NOT NULL
    UNION ALL SELECT conv_id, turn, i + 1, j, (j + min(base - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING))::BIGINT
    FROM (SELECT d.conv_id, d.turn, i, j, CASE WHEN j = 0 THEN c + 1 ELSE least(c + 1, lag(c) OVER (PARTITION BY d.conv_id, d.turn ORDER BY j) + (h[j] <> r[i + 1])::INT) END AS base FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn WHERE i < len(r))),
  s AS (SELECT p.conv_id, p.turn, tag, len(r) AS gold_words, len(h) AS hyp_words, c::INT AS errors, CASE WHEN len(r) > 0 THEN 100.0 * c / len(r) ELSE 0.0 END AS wer FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.turn AND d.i = len(r) AND d.j = len(h) WHERE r IS NOT NULL)"""


def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_turns(spark, sf_dir)).select("conv_id", "turn", "gold_words", "hyp_words", "errors", F.round("wer", 4).alias("wer"))


WER_PAIRS = TURNS + " SELECT conv_id, turn, gold_words::INT AS gold_words, hyp_words::INT AS hyp_words, errors, round(wer, 4)::DOUBLE AS wer FROM s"


def wer_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(_turns(spark, sf_dir))
    return scoring.pooled(scored, scoring.family(F.col("tag"))).withColumn("wer", F.round("wer", 4))


WER_POOLED = TURNS + """, f AS (SELECT *, CASE WHEN starts_with(tag, 'composer') THEN 'composer' WHEN starts_with(tag, 'gemini') THEN 'gemini' WHEN starts_with(tag, 'sonnet_4.6') THEN 'sonnet_4.6' END AS family FROM s)
  SELECT family, count(*) AS runs, sum(errors)::BIGINT AS errors, sum(gold_words)::BIGINT AS gold_words, round(100.0 * sum(errors) / sum(gold_words), 4)::DOUBLE AS wer FROM f GROUP BY family"""


def wer_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(_turns(spark, sf_dir)).withColumn("family", scoring.family(F.col("tag")))
    one = scored.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "tag").orderBy("turn"))).where("_r = 1")
    return scoring.latest_runs(one, ["conv_id", "family"]).select("conv_id", "family", "tag", "errors", "gold_words")


WER_BEST_RUN = TURNS + """, f AS (SELECT *, CASE WHEN starts_with(tag, 'composer') THEN 'composer' WHEN starts_with(tag, 'gemini') THEN 'gemini' ELSE 'sonnet_4.6' END AS family, row_number() OVER (PARTITION BY conv_id, tag ORDER BY turn) AS k FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, family ORDER BY contains(tag, 'v2') DESC, tag DESC) AS n FROM f WHERE k = 1)
  SELECT conv_id, family, tag, errors, gold_words::INT AS gold_words FROM r WHERE n = 1"""


def edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit script of each run, and how many errors it has."""
    steps = _turns(spark, sf_dir).select("conv_id", "turn", align("gold", "hyp").alias("s"))
    told = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["op"], F.coalesce(s["ref"], F.lit("")), F.coalesce(s["hyp"], F.lit("")))), "|")
    return steps.select("conv_id", "turn", F.size(F.filter("s", lambda s: s["op"] != "eq")).alias("errors"), F.md5(told).alias("script"))


#: Walks back through the table of distances; of several ways a deletion goes first, then an insertion.
SCRIPTS = TURNS + """, rows AS (SELECT conv_id, turn, i, list(c ORDER BY j) AS c FROM d GROUP BY conv_id, turn, i),
  b AS (SELECT conv_id, turn, len(r)::BIGINT AS i, len(h)::BIGINT AS j, 0 AS step, '' AS op, '' AS ref, '' AS hyp FROM p WHERE r IS NOT NULL
    UNION ALL SELECT conv_id, turn, CASE WHEN k.op = 'ins' THEN k.i ELSE k.i - 1 END, CASE WHEN k.op = 'del' THEN k.j ELSE k.j - 1 END, step + 1, k.op, CASE WHEN k.op = 'ins' THEN '' ELSE r[k.i] END, CASE WHEN k.op = 'del' THEN '' ELSE h[k.j] END
    FROM (SELECT b.conv_id, b.turn, b.i, b.j, step, p.r, p.h, CASE WHEN b.i > 0 AND x.c[b.j + 1] = u.c[b.j + 1] + 1 THEN 'del' WHEN b.j > 0 AND x.c[b.j + 1] = x.c[b.j] + 1 THEN 'ins' WHEN r[b.i] = h[b.j] THEN 'eq' ELSE 'sub' END AS op
      FROM b JOIN p ON p.conv_id = b.conv_id AND p.turn = b.turn JOIN rows x ON x.conv_id = b.conv_id AND x.turn = b.turn AND x.i = b.i LEFT JOIN rows u ON u.conv_id = b.conv_id AND u.turn = b.turn AND u.i = b.i - 1 WHERE b.i > 0 OR b.j > 0) k)"""
EDIT_SCRIPTS = SCRIPTS + """, told AS (SELECT conv_id, turn, count(*) FILTER (op <> 'eq') AS errors, string_agg(op || ':' || ref || ':' || hyp, '|' ORDER BY step DESC) AS script FROM b WHERE step > 0 GROUP BY conv_id, turn)
  SELECT s.conv_id, s.turn, coalesce(told.errors, 0)::INT AS errors, md5(coalesce(script, '')) AS script FROM s LEFT JOIN told ON told.conv_id = s.conv_id AND told.turn = s.turn"""

SUB = {"diacritics": r"[\x{00C0}-\x{00FF}]", "honorifics": "[!%&*#$|]", "letters": r"A-Za-z0-9_\x{00C0}-\x{00FF}", "heh": ("sdt", "HHH"), "digits": ("0123456789", "1234567890")}


def sub_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of neighbouring words taken as gold and found, by language."""
    words = _table(spark, sf_dir, "documents", "lang", "text").withColumn("w", F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    pairs = words.select("lang", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("g"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("h"))).alias("p"))
    # A category is found once for each distinct pair.
    distinct = pairs.groupBy("lang", "p.g", "p.h").agg(F.count("*").alias("n"))
    category = X.substitution_category(F.col("g"), F.col("h"), **SUB)
    return distinct.groupBy("lang", category.alias("category")).agg(F.sum("n").alias("n"))


SUB_CATEGORY = r"""WITH w AS (SELECT lang, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT lang, unnest(w[1:len(w) - 1]) AS g, unnest(w[2:]) AS h FROM w WHERE len(w) > 1),
  c AS (SELECT lang, CASE WHEN regexp_replace(g, '[\x{00C0}-\x{00FF}]', '', 'g') = regexp_replace(h, '[\x{00C0}-\x{00FF}]', '', 'g') THEN 'diacritic'
    WHEN regexp_replace(g, '[!%&*#$|\x{00C0}-\x{00FF}]', '', 'g') = regexp_replace(h, '[!%&*#$|\x{00C0}-\x{00FF}]', '', 'g') THEN 'honorific'
    WHEN regexp_replace(translate(g, 'sdt', 'HHH'), '[\x{00C0}-\x{00FF}]', '', 'g') = regexp_replace(translate(h, 'sdt', 'HHH'), '[\x{00C0}-\x{00FF}]', '', 'g') THEN 'heh'
    WHEN translate(g, '0123456789', '1234567890') = translate(h, '0123456789', '1234567890') AND g <> h THEN 'digit_system'
    WHEN regexp_replace(g, '[^A-Za-z0-9_\x{00C0}-\x{00FF}]', '', 'g') <> '' AND regexp_replace(g, '[^A-Za-z0-9_\x{00C0}-\x{00FF}]', '', 'g') = regexp_replace(h, '[^A-Za-z0-9_\x{00C0}-\x{00FF}]', '', 'g') THEN 'punct_other'
    ELSE 'letter_or_word' END AS category FROM p)
  SELECT lang, category, count(*)::BIGINT AS n FROM c GROUP BY lang, category"""


def bounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight labelled documents of each language and label."""
    rows = _table(spark, sf_dir, "documents", "doc_id", "lang").join(_table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    return scoring.first_samples(rows, ["lang", "quality"], ["doc_id"])


BOUNDED_SAMPLES = "SELECT doc_id, lang, quality, sample FROM (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id)::INT AS sample FROM documents d JOIN labels l ON l.doc_id = d.doc_id) WHERE sample <= 8"


def category_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "events", "user_id", "event_type").select(F.col("user_id").alias("page_id"), F.lit("x").alias("tag"), F.col("event_type").alias("category"))
    return scoring.category_counts(found).select("page_id", F.array_join(F.transform(F.map_entries("cats"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("cats"))


CATEGORY_MAPS = "SELECT user_id AS page_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS cats FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id"


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accented letters of documents as glyph codes, by source in the role of the font and document in that of the page."""
    return _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text").select("doc_id", "source", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(f"({ACCENTS})"), 1)).alias("pos", "ch"))


CHARS = f"a AS (SELECT doc_id, source, lang, regexp_extract_all(text, '{ACCENTS}') AS l FROM documents), c AS (SELECT doc_id, source, lang, unnest(l) AS ch, unnest(range(0, len(l))) AS pos FROM a)"
# A table of the commoner half of the letters.
SEED = [("00E9", "e"), ("00E8", "e"), ("00FC", "u"), ("00DF", "ss"), ("00F1", "n")]
SEED_SQL = "seed(code, txt) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in SEED) + ")"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chars(spark, sf_dir).withColumn("code", C.hex_key(decode.codepoint(F.col("ch"))))


def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))
    found = decode.coverage(totals, spark.createDataFrame(SEED, "code string, text string"), "code")
    return found.withColumn("mapped_pct", F.round("mapped_pct", 4))


SEED_COVERAGE = f"""WITH {CHARS}, {SEED_SQL}, k AS (SELECT printf('%04X', unicode(ch)) AS code, count(*) AS n FROM c GROUP BY 1), j AS (SELECT n, txt FROM k LEFT JOIN seed USING (code))
  SELECT coalesce(sum(n) FILTER (txt IS NOT NULL), 0)::BIGINT AS mapped_n, coalesce(sum(n) FILTER (txt IS NULL), 0)::BIGINT AS unknown_n, count(*) FILTER (txt IS NULL) AS unknown_keys, count(*) FILTER (txt IS NULL AND n = 1) AS unknown_once, round(100.0 * coalesce(sum(n) FILTER (txt IS NOT NULL), 0) / sum(n), 4)::DOUBLE AS mapped_pct FROM j"""


def codes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.codes_by_page(_codes(spark, sf_dir), spark.createDataFrame(SEED, "code string, text string"), "source", "code")


CODES_BY_PAGE = f"WITH {CHARS}, {SEED_SQL}, k AS (SELECT DISTINCT source, printf('%04X', unicode(ch)) AS code FROM c), j AS (SELECT source, k.code, seed.code AS s FROM k LEFT JOIN seed USING (code)) SELECT source, count(DISTINCT code) AS codes, count(DISTINCT s) AS known_codes FROM j GROUP BY ROLLUP (source)"


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of a document as the table decodes them, unknown ones as [CODE]."""
    joined = decode.mapped(_codes(spark, sf_dir), spark.createDataFrame(SEED, "code string, text string"), "code")
    shown = joined.withColumn("shown", F.coalesce("mapped", F.concat(F.lit("["), F.col("code"), F.lit("]"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"])
    return shown.groupBy("doc_id").agg(F.md5(F.array_join(ordered, "")).alias("decoded"), F.count("*").alias("letters"))


PLACEHOLDERS = f"WITH {CHARS}, {SEED_SQL}, k AS (SELECT doc_id, pos, printf('%04X', unicode(ch)) AS code FROM c) SELECT doc_id, md5(string_agg(coalesce(txt, '[' || k.code || ']'), '' ORDER BY pos)) AS decoded, count(*) AS letters FROM k LEFT JOIN seed USING (code) GROUP BY doc_id"


def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _codes(spark, sf_dir).select("lang", "code").distinct()
    return decode.unmapped(keys, spark.createDataFrame(SEED, "code string, text string"), "code").select("lang", "code")


UNMAPPED_KEYS = f"WITH {CHARS}, {SEED_SQL}, k AS (SELECT DISTINCT lang, printf('%04X', unicode(ch)) AS code FROM c) SELECT lang, code FROM k WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.code = k.code)"


def topk_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty commonest codes that the table lacks, ties by first page; the limit is the report's."""
    totals = _codes(spark, sf_dir).withColumn("key", F.concat_ws(":", "source", "code")).groupBy("key", "code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_page"))
    left = decode.unmapped(totals, spark.createDataFrame(SEED, "code string, text string"), "code")
    return left.select("key", "n", "first_page").orderBy(F.desc("n"), "first_page", "key").limit(40)


TOPK_UNKNOWN = f"WITH {CHARS}, {SEED_SQL}, k AS (SELECT source || ':' || printf('%04X', unicode(ch)) AS key, printf('%04X', unicode(ch)) AS code, doc_id FROM c) SELECT key, count(*) AS n, min(doc_id) AS first_page FROM k WHERE code NOT IN (SELECT code FROM seed) GROUP BY key ORDER BY n DESC, first_page, key LIMIT 40"


def mode_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that makes up at least half of a source's documents, odd sources' German not being good."""
    rows = _table(spark, sf_dir, "documents", "doc_id", "source", "lang").withColumn("seq", F.col("doc_id"))
    found = decode.harvest(rows, "source", "lang", "doc_id")
    return decode.likely_values(found, "source", "lang", F.col("lang") != "de", 0.5)


MODE_SEED = """WITH h AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first_page FROM documents GROUP BY source, lang),
  t AS (SELECT source, sum(n)::BIGINT AS total, min(first_page) AS first_page FROM h GROUP BY source),
  g AS (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_page) AS k FROM h WHERE lang <> 'de')
  SELECT source, lang, n, total, t.first_page FROM g JOIN t USING (source) WHERE k = 1 AND n / total >= 0.5"""


def transfer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _codes(spark, sf_dir).groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    found = decode.transfer(totals, spark.createDataFrame(SEED, "code string, text string"), "doc_id", "code")
    return found.groupBy("bucket").agg(F.count("*").alias("documents"))


TRANSFER_SCAN = f"WITH {CHARS}, {SEED_SQL}, k AS (SELECT doc_id, count(*) FILTER (txt IS NOT NULL) / count(*) AS share FROM c LEFT JOIN seed ON code = printf('%04X', unicode(ch)) GROUP BY doc_id) SELECT CASE WHEN share >= 0.9 THEN '90' WHEN share >= 0.5 THEN '50-89' WHEN share > 0 THEN '1-49' ELSE '0' END AS bucket, count(*) AS documents FROM k GROUP BY 1"


def code_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as code points: bucket, trust and glyph key."""
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    code = (F.col("p_partkey") * 37) % 66000
    font = F.concat_ws("+", "p_brand", F.concat_ws(",", "p_name", F.lit("Bold")))
    return rows.select("p_partkey", C.code_bucket(code).alias("bucket"), C.good_code(code).cast("int").alias("good"), C.hex_key(code).alias("hex"), C.glyph_key(font, F.col("p_partkey")).alias("key"))


CODE_BUCKETS = """WITH p AS (SELECT p_partkey, p_name, p_brand, (p_partkey * 37) % 66000 AS c FROM part)
  SELECT p_partkey, CASE WHEN c BETWEEN 57344 AND 63743 THEN 'pua' WHEN c BETWEEN 1536 AND 1791 OR c BETWEEN 1872 AND 1919 OR c BETWEEN 2208 AND 2303 THEN 'arabic' WHEN c BETWEEN 2304 AND 2431 THEN 'devanagari' WHEN c BETWEEN 32 AND 126 THEN 'ascii' WHEN c = 65533 THEN 'replacement' ELSE 'other' END AS bucket,
  ((c BETWEEN 32 AND 126 OR c BETWEEN 1536 AND 1791 OR c BETWEEN 1872 AND 1919 OR c BETWEEN 2208 AND 2303 OR c BETWEEN 64336 AND 65023 OR c BETWEEN 65136 AND 65279 OR c IN (8204, 8205, 8206, 8207, 1564)) AND c NOT IN (65533, 65535))::INT AS good,
  printf('%04X', c) AS hex, split_part(split_part(p_brand || '+' || p_name || ',Bold', '+', -1), ',', 1) || ':' || p_partkey AS key FROM p"""


def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in clusters with no gap above six hours."""
    rows = _table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    found = layout.by_gaps(rows, ["user_id"], "sec", 6 * 3600, ties=("event_id",))
    return found.groupBy("user_id", "row_id").agg(F.count("*").alias("n"), F.round(F.avg("sec"), 3).alias("mean_sec"))


GAP_CLUSTER = """WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events),
  g AS (SELECT *, coalesce((sec - lag(sec) OVER w > 21600)::INT, 0) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
  r AS (SELECT *, (sum(s) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING))::INT AS row_id FROM g)
  SELECT user_id, row_id, count(*) AS n, round(avg(sec), 3)::DOUBLE AS mean_sec FROM r GROUP BY user_id, row_id"""


def run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    runs = layout.by_change(rows, ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", "run_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


RUN_SEGMENTS = """WITH g AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, (sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::INT AS run_id FROM g)
  SELECT user_id, run_id, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run_id, event_type"""


def asof_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest event before and after each that is not a click."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    skip = F.col("event_type") == "click"
    rows = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return rows.select("event_id", layout.neighbour(F.col("event_id"), skip, window, False).alias("before"), layout.neighbour(F.col("event_id"), skip, window, True).alias("after"))


ASOF_NEIGHBOR = """SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events"""


def nearest_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest in time to each purchase of the same user, ties to the smaller id."""
    rows = _table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    found = layout.nearest_on_axis(rows, ["user_id"], "us", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "view")
    return found.select("event_id", "host", F.col("distance").cast("long").alias("distance"))


NEAREST_HOST = """WITH p AS (SELECT a.event_id, b.event_id AS host, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS distance FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view')
  SELECT event_id, host, distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, host) AS k FROM p) WHERE k = 1"""


def mark_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as glyph boxes: each return joins the line of its order whose box it lies over or is nearest to."""
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    marks = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 2).alias("x1"))
    hosts = rows.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").alias("host"), (F.col("l_quantity") - 3).alias("hx0"), (F.col("l_quantity") + 4).alias("hx1"))
    inside = layout.nearest(marks, hosts, ["l_orderkey"], layout.inside_or_edge(F.col("x0"), F.col("x1"), F.col("hx0"), F.col("hx1")), ["l_linenumber"], "host")
    return inside.select("l_orderkey", "l_linenumber", "host", "distance")


MARK_HOSTS = """WITH j AS (SELECT m.l_orderkey, m.l_linenumber, h.l_linenumber AS host, m.l_quantity + 1 AS mx, h.l_quantity - 3 AS a, h.l_quantity + 4 AS b FROM lineitem m JOIN lineitem h ON m.l_orderkey = h.l_orderkey AND m.l_returnflag = 'R' AND h.l_returnflag <> 'R'),
  d AS (SELECT *, CASE WHEN mx BETWEEN a AND b THEN 0.0 ELSE least(abs(mx - a), abs(mx - b)) END AS distance FROM j)
  SELECT l_orderkey, l_linenumber, host, distance FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY distance, host) AS k FROM d) WHERE k = 1"""


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines read from right to left, with a space where the gap to the next is above one."""
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    gap = F.lag("l_quantity").over(order) - (F.col("l_quantity") + 2) > 1.0
    pieces = rows.select("l_orderkey", "l_quantity", "l_linenumber", F.concat(F.when(gap, " ").otherwise(""), F.col("l_linenumber").cast("string")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "t")))
    return pieces.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("line"))


WORD_GAPS = """WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) - (l_quantity + 2) > 1.0, false) AS s FROM lineitem)
  SELECT l_orderkey, string_agg((CASE WHEN s THEN ' ' ELSE '' END) || l_linenumber, '' ORDER BY l_quantity DESC, l_linenumber) AS line FROM g GROUP BY l_orderkey"""


def run_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "events", "event_type", "user_id", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    log = log.select("event_type", (F.col("user_id") % 3).alias("model"), F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), (F.col("k") * 3).alias("total_tokens"))
    return records.token_totals(log, ["event_type", "model"])


RUN_LOG_ROLLUP = "SELECT event_type, user_id % 3 AS model, count(*) AS runs, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS input_tokens, sum(2 * json_extract(props, '$.k')::BIGINT)::BIGINT AS output_tokens, sum(3 * json_extract(props, '$.k')::BIGINT)::BIGINT AS total_tokens FROM events GROUP BY 1, 2"


def bbox_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    box = layout.clamp_box(size - 10, size - 20, price / 2, price / 3, price / 2 + 5, price / 3 + 2, 12.0)
    rows = _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").withColumn("b", box)
    percent, tokens = layout.area_percent(F.col("b"), price / 2 + 5, price / 3 + 2), layout.token_estimate(F.col("b"))
    return rows.select("p_partkey", F.round("b.left", 3).alias("x0"), F.round("b.top", 3).alias("y0"), F.round("b.right", 3).alias("x1"), F.round("b.bottom", 3).alias("y1"), F.round(percent, 3).alias("area_pct"), F.round(tokens, 3).alias("tokens"))


BBOX_CLAMP = """WITH b AS (SELECT p_partkey, p_retailprice / 2 + 5 AS w, p_retailprice / 3 + 2 AS h, greatest(0, p_size::DOUBLE - 22) AS x0, greatest(0, p_size::DOUBLE - 32) AS y0, least(p_retailprice / 2 + 5, p_retailprice / 2 + 12) AS x1, least(p_retailprice / 3 + 2, p_retailprice / 3 + 12) AS y1 FROM part)
  SELECT p_partkey, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1, round(100.0 * (x1 - x0) * (y1 - y0) / (w * h), 3) AS area_pct, round((x1 - x0) * (y1 - y0) / 750, 3) AS tokens FROM b"""


def content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_quantity").select("l_suppkey", F.col("l_partkey").alias("x"), F.col("l_orderkey").alias("y"), (F.col("l_quantity") * 6).alias("value"))
    return layout.content_box(pixels, "l_suppkey")


CONTENT_BOXES = 'SELECT l_suppkey, min(l_partkey) AS "left", min(l_orderkey) AS top, max(l_partkey) + 1 AS "right", max(l_orderkey) + 1 AS bottom FROM lineitem WHERE l_quantity * 6 < 245 GROUP BY l_suppkey'


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each letter of a source is first seen, how often it is, and its first three places."""
    rows = _codes(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("source", "code").orderBy("doc_id", "pos"))
    total = F.count("*").over(Window.partitionBy("source", "code"))
    return rows.withColumns({"sample": rank, "n": total}).where("sample <= 3").select("source", "code", "n", "sample", "doc_id", "pos")


FIRST_OCCURRENCE = f"WITH {CHARS}, k AS (SELECT source, printf('%04X', unicode(ch)) AS code, doc_id, pos::INT AS pos, count(*) OVER (PARTITION BY source, ch) AS n, row_number() OVER (PARTITION BY source, ch ORDER BY doc_id, pos)::INT AS sample FROM c) SELECT source, code, n, sample, doc_id, pos FROM k WHERE sample <= 3"

NAMES = "line_filter_tokens wer_pairs wer_pooled wer_best_run edit_scripts sub_category bounded_samples category_maps seed_coverage codes_by_page placeholders unmapped_keys topk_unknown mode_seed transfer_scan code_buckets gap_cluster run_segments asof_neighbor nearest_host mark_hosts word_gaps run_log_rollup bbox_clamp content_boxes first_occurrence".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE = {name: globals()[name.upper()] for name in NAMES}
