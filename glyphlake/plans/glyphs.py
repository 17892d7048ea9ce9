"""Queries over glyph tables made from order lines, and DuckDB SQL for each.

A supplier is a page; an order line is a glyph, whose part number picks code, font and width. Private-use codes and glyph ids
are decoded by tables of the reference's kind, so every contextual rule, mark, dot and gap occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions.udfs import nfkc
from glyphlake.operators import decode, records

# Code, text in the table (None: not in it), by the remainder of the part number.
CODES = [(0xF001, "ا"), (0xF002, "ب"), (0xF003, "َ"), (0xF004, ""), (0xF0F1, "ئ"), (0xF031, "ے"), (0xF060, "ہ"), (0xF061, "ہ"), (0xF010, "ن"), (0xF011, "ی"), (0xF012, "م"), (0xF013, "د"), (0xF020, None), (0x61, None), (0x62, None)]
# Font, glyph id, ToUnicode value, width.
KEPT = "AA+UrduTypesetting,Bold"
GLYPHS = [(KEPT, 1, 0x628, 0.3), (KEPT, 2, 0xFFFD, 0.3), (KEPT, 3, 0x627, 0.3), (KEPT, 4, 0x62A, 0.1), (KEPT, 5, 0x64E, 0.2), (KEPT, 6, 0x20, 0.3), ("Times", 7, 0x41, 0.3), (KEPT, 8, 0xFEFB, 0.3), ("Times", 9, 0xFFFF, 0.3), (KEPT, 10, 0xE001, 0.3), (KEPT, 11, 0xFFFD, 0.3)]
KEYS = [("UrduTypesetting:10", "ک"), ("UrduTypesetting:11", ""), ("Times:99", "x")]


def _pick(values: list, at: Column, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1).cast(kind)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y0, x0 and the part number of every order line."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    y0 = (F.col("l_orderkey") % 12) * F.lit(30.0) + F.col("l_linenumber") * F.lit(1.5)
    x0 = (F.col("l_orderkey") % 1000) * F.lit(0.05) + F.col("l_linenumber") * F.lit(0.01)
    return rows.select(F.col("l_suppkey").cast("int").alias("page"), y0.alias("y0"), x0.alias("x0"), F.col("l_partkey").alias("part"))


PLACES = "SELECT l_suppkey::INT AS page, ((l_orderkey % 12)::DOUBLE * 30.0::DOUBLE + l_linenumber::DOUBLE * 1.5::DOUBLE) AS y0, ((l_orderkey % 1000)::DOUBLE * 0.05::DOUBLE + l_linenumber::DOUBLE * 0.01::DOUBLE) AS x0, l_partkey AS part FROM lineitem"


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("part") % len(CODES)).cast("int")
    cp = _pick([c for c, _ in CODES], at, "int")
    width = F.when(cp == 0xF003, F.lit(0.2)).otherwise(F.lit(0.3))
    rows = _places(spark, sf_dir).withColumns({"cp": cp, "w": width})
    return rows.select("page", "y0", "x0", (F.col("x0") + F.col("w")).alias("x1"), F.when(F.col("cp") > 0xE000, "Batool").otherwise("Times").alias("font"), decode.char_of(F.col("cp")).alias("ch"), "cp")


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values) + "]"


CHARS = f"""place AS ({PLACES}), g AS (SELECT page, y0, x0, {_list([c for c, _ in CODES])}[part % {len(CODES)} + 1]::INT AS cp FROM place),
  chars AS (SELECT page, y0, x0, x0 + CASE WHEN cp = {0xF003} THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS x1, CASE WHEN cp > {0xE000} THEN 'Batool' ELSE 'Times' END AS font, chr(cp) AS ch, cp FROM g)"""
MARK = r"regexp_matches({}, '^[\p{Mn}\p{Mc}]+$')"
SEED = "seed(code, txt) AS (VALUES " + ", ".join(f"('{c:04X}', '{t}')" for c, t in CODES if t is not None) + ")"


def _seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{c:04X}", t) for c, t in CODES if t is not None], "code string, text string")


def private_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page, decoded by the table of private-use codes."""
    return decode.decode_private(_chars(spark, sf_dir), _seed(spark), wrap=True)


def _rows(gap: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0 DESC, tie) AS seq FROM glyph),
  st AS (SELECT *, coalesce((y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, seq) > {gap})::INT, 0) AS st FROM n),
  ro AS (SELECT *, (sum(st) OVER (PARTITION BY page ORDER BY y0, seq ROWS UNBOUNDED PRECEDING))::INT AS row_id FROM st)"""


NEAR = "last_value(CASE WHEN NOT skip THEN {} END IGNORE NULLS) OVER (PARTITION BY page, row_id, run_id ORDER BY x0 DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
AHEAD = "first_value(CASE WHEN NOT skip THEN {} END IGNORE NULLS) OVER (PARTITION BY page, row_id, run_id ORDER BY x0 DESC, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
PRIVATE = f"""WITH {CHARS}, {SEED}, glyph AS (SELECT *, cp AS tie, font LIKE '%Batool%' OR cp BETWEEN 57344 AND 63743 AS private FROM chars), {_rows("14.0")},
  ch AS (SELECT *, (private IS DISTINCT FROM lag(private) OVER w AND row_number() OVER w > 1)::INT AS c FROM ro WINDOW w AS (PARTITION BY page, row_id ORDER BY x0, seq)),
  ru AS (SELECT *, (sum(c) OVER (PARTITION BY page, row_id ORDER BY x0, seq ROWS UNBOUNDED PRECEDING))::INT AS run_id FROM ch),
  other AS (SELECT page, row_id, run_id, string_agg(ch, '' ORDER BY x0, seq) AS part FROM ru WHERE NOT private GROUP BY ALL),
  co AS (SELECT ru.*, printf('%04X', cp) AS code, coalesce(txt, '[' || printf('%04X', cp) || ']') AS base, coalesce(txt, '') = '' AND txt IS NOT NULL OR {MARK.replace("{}", "coalesce(txt, '')", 1)} AS skip FROM ru LEFT JOIN seed ON seed.code = printf('%04X', cp) WHERE private),
  nb AS (SELECT *, {NEAR.format("code")} AS bc, coalesce({NEAR.format("base")}, '') AS b, coalesce({AHEAD.format("code")}, '') AS ac, coalesce({AHEAD.format("base")}, '') AS a, row_number() OVER (PARTITION BY page, row_id, run_id ORDER BY x0 DESC, seq) AS pos FROM co),
  it AS (SELECT page, row_id, run_id, pos, x0, x1, CASE WHEN base = '' THEN NULL WHEN code = 'F031' AND coalesce(bc = 'F0F1', false) THEN NULL WHEN code = 'F0F1' AND ac = 'F031' THEN CASE WHEN starts_with(b, 'ا') OR starts_with(b, 'آ') THEN 'ئے' ELSE 'ائے' END
    WHEN code = 'F060' AND starts_with(b, 'ن') AND starts_with(a, 'ی') THEN 'ھ' WHEN code = 'F060' AND starts_with(b, 'م') AND starts_with(a, 'ا') THEN 'ه' WHEN code = 'F061' AND starts_with(a, 'د') THEN 'ھ' ELSE base END AS t FROM nb),
  im AS (SELECT *, {MARK.replace("{}", "t", 1)} AS mark FROM it WHERE t IS NOT NULL),
  jo AS (SELECT m.page, m.row_id, m.run_id, m.pos, m.t, h.pos AS host, row_number() OVER (PARTITION BY m.page, m.row_id, m.run_id, m.pos ORDER BY CASE WHEN (m.x0 + m.x1) / 2 BETWEEN least(h.x0, h.x1) AND greatest(h.x0, h.x1) THEN 0.0::DOUBLE ELSE least(abs((m.x0 + m.x1) / 2 - h.x0), abs((m.x0 + m.x1) / 2 - h.x1)) END, h.pos) AS k
    FROM im m JOIN im h ON m.page = h.page AND m.row_id = h.row_id AND m.run_id = h.run_id AND m.mark AND NOT h.mark),
  ex AS (SELECT page, row_id, run_id, host AS pos, string_agg(t, '' ORDER BY pos) AS extra FROM jo WHERE k = 1 GROUP BY page, row_id, run_id, host),
  me AS (SELECT im.page, im.row_id, im.run_id, im.pos, x0, x1, t || coalesce(extra, '') AS t FROM im LEFT JOIN ex USING (page, row_id, run_id, pos) WHERE NOT mark OR NOT EXISTS (SELECT 1 FROM jo WHERE jo.page = im.page AND jo.row_id = im.row_id AND jo.run_id = im.run_id AND jo.pos = im.pos)),
  sp AS (SELECT *, coalesce(lag(x0) OVER (PARTITION BY page, row_id, run_id ORDER BY pos) - x1 > 1.0, false) AS gap FROM me),
  de AS (SELECT page, row_id, run_id, '{{' || string_agg(CASE WHEN gap THEN ' ' || t ELSE t END, '' ORDER BY pos) || '}}' AS part FROM sp GROUP BY ALL),
  li AS (SELECT page, row_id, string_agg(part, '' ORDER BY run_id) AS line FROM (SELECT * FROM other UNION ALL SELECT * FROM de) GROUP BY page, row_id)"""
PRIVATE_LINES = PRIVATE + " SELECT page, row_id, line FROM li"
PAGES = " SELECT page, string_agg(trim(line), chr(10) ORDER BY row_id) AS text FROM li WHERE trim(line) <> '' GROUP BY page"


def private_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page of private-use glyphs."""
    return decode.page_text(decode.decode_private(_chars(spark, sf_dir), _seed(spark)))


PRIVATE_PAGES = PRIVATE.replace("'{' || ", "").replace(" || '}'", "") + PAGES


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("part") % len(GLYPHS)).cast("int")
    font, gid, ucs, width = (_pick([g[k] for g in GLYPHS], at, kind) for k, kind in enumerate(("string", "int", "int", "double")))
    rows = _places(spark, sf_dir).withColumns({"font": font, "gid": gid, "ucs": ucs, "w": width})
    return rows.select("page", "y0", "x0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 1).alias("y1"), "font", "gid", "ucs")


GLYPH = (
    f"place AS ({PLACES}), p AS (SELECT *, (part % {len(GLYPHS)} + 1)::INT AS k FROM place), glyph AS (SELECT page, y0, x0, x0 + {_list([g[3] for g in GLYPHS])}[k] AS x1, y0 + 1 AS y1, {_list([g[0] for g in GLYPHS])}[k] AS font, {_list([g[1] for g in GLYPHS])}[k] AS gid, {_list([g[2] for g in GLYPHS])}[k] AS ucs, gid AS tie FROM p), "
    "keys(key, txt) AS (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in KEYS) + ")"
)
# What the glyphs above can stand for: kept fonts by trusted values, others by any character.
LOOKUP = "CASE WHEN txt IS NOT NULL THEN txt WHEN font LIKE '%Urdu%' THEN CASE ucs WHEN 1576 THEN 'ب' WHEN 1575 THEN 'ا' WHEN 1578 THEN 'ت' WHEN 1614 THEN chr(1614) WHEN 32 THEN ' ' WHEN 65275 THEN 'لا' END WHEN ucs = 65 THEN 'A' END"
KEY = "split_part(split_part(font, '+', -1), ',', 1) || ':' || gid"


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYS, "key string, text string")


def glyph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each glyph key and value stand for, and how often they occur."""
    seen = _glyphs(spark, sf_dir).withColumn("key", C.glyph_key(F.col("font"), F.col("gid"))).groupBy("key", "font", "ucs").agg(F.count("*").alias("n"))
    text = decode.lookup_text(F.col("mapped"), F.col("font"), F.col("ucs"), nfkc(decode.char_of(F.col("ucs"))))
    return decode.mapped(seen, _keys(spark), "key").select("key", "ucs", "n", text.alias("text"))


GLYPH_TEXTS = f"WITH {GLYPH}, k AS (SELECT {KEY} AS key, font, ucs, count(*) AS n FROM glyph GROUP BY ALL) SELECT k.key, ucs, n, {LOOKUP} AS text FROM k LEFT JOIN keys ON keys.key = k.key"


def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page, decoded by the table of glyph keys."""
    return decode.decode_glyphs(_glyphs(spark, sf_dir), _keys(spark))


GLYPH_ROWS = f"""WITH {GLYPH}, {_rows("10.0")},
  lo AS (SELECT ro.*, {KEY} AS key, font LIKE '%Urdu%' AS kept, {LOOKUP} AS t, row_number() OVER (PARTITION BY page, row_id ORDER BY x0 DESC, seq) AS pos FROM ro LEFT JOIN keys ON keys.key = {KEY}),
  dt AS (SELECT *, x1 - x0 < 0.4 AND kept AND ucs IN (1576, 1575, 1578) AS dot, kept AND (t IS NULL OR t <> ' ') AS ho FROM lo),
  hs AS (SELECT *, CASE WHEN dot THEN first_value(CASE WHEN ho THEN pos END IGNORE NULLS) OVER (PARTITION BY page, row_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS host FROM dt),
  na AS (SELECT page, row_id, host AS pos, arg_max(chr(ucs), pos) AS named FROM hs WHERE host IS NOT NULL GROUP BY page, row_id, host),
  ov AS (SELECT hs.page, hs.row_id, hs.pos, x0, x1, key, CASE WHEN named IS NOT NULL AND (t IS NULL OR t = '' OR t[1] IN ('ب', 'ت', 'ث', 'ن', 'پ', 'ٹ', 'ی', 'ي', 'ے', 'ئ')) THEN named ELSE t END AS t FROM hs LEFT JOIN na ON na.page = hs.page AND na.row_id = hs.row_id AND na.pos = hs.pos WHERE host IS NULL),
  ga AS (SELECT *, coalesce(lag(x0) OVER (PARTITION BY page, row_id ORDER BY pos) - x1 > 1.2, false) AND NOT coalesce({MARK.replace("{}", "t", 1)}, false) AS gap FROM ov WHERE t IS NULL OR t <> ''),
  pc AS (SELECT page, row_id, 2 * pos + 1 AS pos, x0, x1, coalesce(t, '[' || key || ']') AS t FROM ga UNION ALL SELECT page, row_id, 2 * pos, x0, x1, ' ' FROM ga WHERE gap),
  im AS (SELECT *, {MARK.replace("{}", "t", 1)} AS mark FROM pc),
  jo AS (SELECT m.page, m.row_id, m.pos, m.t, h.pos AS host, row_number() OVER (PARTITION BY m.page, m.row_id, m.pos ORDER BY abs((h.x0 + h.x1) / 2 - (m.x0 + m.x1) / 2), h.pos) AS k FROM im m JOIN im h ON m.page = h.page AND m.row_id = h.row_id AND m.mark AND NOT h.mark),
  ex AS (SELECT page, row_id, host AS pos, string_agg(t, '' ORDER BY pos) AS extra FROM jo WHERE k = 1 GROUP BY page, row_id, host),
  li AS (SELECT im.page, im.row_id, string_agg(t || coalesce(extra, ''), '' ORDER BY im.pos) AS line FROM im LEFT JOIN ex ON ex.page = im.page AND ex.row_id = im.row_id AND ex.pos = im.pos WHERE NOT mark OR NOT EXISTS (SELECT 1 FROM jo WHERE jo.page = im.page AND jo.row_id = im.row_id AND jo.pos = im.pos) GROUP BY im.page, im.row_id)"""
GLYPH_LINES = GLYPH_ROWS + " SELECT page, row_id, line FROM li"


def glyph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page of glyph ids."""
    return decode.page_text(glyph_lines(spark, sf_dir))


GLYPH_PAGES = GLYPH_ROWS + PAGES


def page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of nested page trees: an order is a page, a line of it a line, and blocks of another type hold no text."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    char = F.struct(F.col("l_returnflag").alias("c"), F.array(F.col("l_quantity"), F.lit(1.0), F.col("l_quantity") + 0.25, F.lit(9.0)).alias("bbox"))
    span = F.struct(F.col("l_linestatus").alias("font"), F.lit(9.0).alias("size"), F.array(char).alias("chars"))
    block = F.struct((F.col("l_linenumber") % 3).cast("int").alias("type"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    pages = rows.groupBy(F.col("l_orderkey").cast("int").alias("page")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return decode.chars_of(pages).groupBy("page", "font", "ch", "cp").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


PAGE_TREES = "SELECT l_orderkey::INT AS page, l_linestatus AS font, l_returnflag AS ch, unicode(l_returnflag)::INT AS cp, count(*) AS n, min(l_quantity) AS x0, max(l_quantity + 0.25::DOUBLE) AS x1 FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY ALL"


def stored_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug records of conversations' characters in stored order: a turn is a line, its first words are spans."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    word = lambda w, k: F.struct(F.lit("f").alias("font"), F.lit(9.5).alias("size"), F.array(F.struct(w.alias("c"), F.array(k * 1.25, k * 2.0, k * 3.75, k * 1.0).alias("bbox"))).alias("chars"))
    line = F.struct(F.col("turn"), F.struct(F.transform(F.split("text", "[ \\n]+"), word).alias("spans")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    pages = rows.groupBy(F.col("conv_id").cast("int").alias("page")).agg(F.array(F.struct(F.lit(0).alias("type"), lines.alias("lines"))).alias("blocks"))
    return decode.debug_chars(pages).groupBy("page", "bucket").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"), F.max("l").alias("last_line"), F.round(F.sum("w"), 1).alias("w"))


STORED_CHARS = r"""WITH t AS (SELECT conv_id::INT AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS l, regexp_split_to_array(text, '[ \n]+') AS a FROM conversations),
  w AS (SELECT page, l, unnest(a) AS w, unnest(range(0, len(a))) AS k FROM t), o AS (SELECT *, CASE WHEN w = '' THEN -1 ELSE unicode(w) END AS ord FROM w)
  SELECT page, CASE WHEN ord BETWEEN 32 AND 126 THEN 'ascii' ELSE 'other' END AS bucket, count(*) AS n, sum(ord)::BIGINT AS ords, max(l)::INT AS last_line, round(sum(round(k * 3.75::DOUBLE - k * 1.25::DOUBLE, 1)), 1) AS w FROM o GROUP BY ALL"""


def traced_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of traced pages; those with a code that is no number or a box that lacks one are left out."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_linestatus", "l_returnflag")
    x = F.col("l_quantity")
    box = F.when(F.col("l_partkey") % 7 == 0, F.array(x, F.lit(1.0), x)).otherwise(F.array(x, F.lit(1.0), x + 2, F.lit(3.0)))
    code = F.when(F.col("l_partkey") % 5 == 0, F.lit("bad")).otherwise(F.col("l_partkey").cast("string"))
    char = F.struct(code.alias("ucs"), F.col("l_linenumber").cast("string").alias("gid"), box.alias("bbox"))
    span = F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("font"), F.array(char).alias("chars"))
    pages = rows.groupBy(F.col("l_orderkey").cast("int").alias("page")).agg(F.collect_list(span).alias("spans"))
    return decode.traced_glyphs(pages)


TRACED_GLYPHS = "SELECT l_orderkey::INT AS page, 1.0::DOUBLE AS y0, l_quantity AS x0, l_quantity + 2 AS x1, 3.0::DOUBLE AS y1, CASE WHEN l_returnflag <> 'R' THEN l_linestatus ELSE '' END AS font, l_linenumber AS gid, l_partkey::INT AS ucs FROM lineitem WHERE l_partkey % 7 <> 0 AND l_partkey % 5 <> 0"


def glyph_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, marks and kept fonts among the code points and names that part numbers give."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    code = (1536 + F.col("p_partkey") % 384).cast("int")
    char = decode.char_of(code)
    font = F.concat(F.lit("AB+"), F.element_at(F.array(F.lit("UrduTypesetting,Bold"), F.lit("Times"), F.lit("TraditionalArabic"), F.lit("x,ArabicTypesetting")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return rows.select("p_partkey", C.arabic_letter(char).cast("int").alias("letter"), C.combining(char).cast("int").alias("mark"), C.font_family(font).alias("family"), C.kept_font(font).cast("int").alias("kept"))


GLYPH_TESTS = r"""WITH p AS (SELECT p_partkey, chr((1536 + p_partkey % 384)::INT) AS c, 1536 + p_partkey % 384 AS o, ['UrduTypesetting', 'Times', 'TraditionalArabic', 'x'][p_partkey % 4 + 1] AS family FROM part)
  SELECT p_partkey, (regexp_matches(c, '^\p{L}$') AND (o BETWEEN 1536 AND 1791 OR o BETWEEN 1872 AND 1919))::INT AS letter, regexp_matches(c, '^[\p{Mn}\p{Mc}]$')::INT AS mark, family, (family IN ('UrduTypesetting', 'TraditionalArabic'))::INT AS kept FROM p"""


def corpus_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and replacement marks of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file"), F.regexp_replace("text", "%", "￿").alias("text"))
    return records.corpus_sizes(docs)


CORPUS_SIZES = r"SELECT doc_id AS file, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''))::BIGINT AS words, (length(text) - length(replace(text, '%', '')))::BIGINT AS replaced FROM documents"


def overlay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of an order as overlays: each joins the nearest of the other lines by quantity."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_quantity", "l_returnflag")
    marks = rows.where("l_returnflag = 'R'").select("page", F.col("l_linenumber").alias("mark"), F.col("l_quantity").alias("y"))
    hosts = rows.where("l_returnflag <> 'R'").select("page", F.col("l_linenumber").alias("row_id"), F.col("l_quantity").alias("y"))
    return decode.overlays(marks, hosts)


OVERLAY_ROWS = "SELECT m.l_orderkey AS page, m.l_linenumber AS mark, arg_min(h.l_linenumber, (abs(m.l_quantity - h.l_quantity), h.l_linenumber)) AS row_id FROM lineitem m JOIN lineitem h ON m.l_orderkey = h.l_orderkey AND m.l_returnflag = 'R' AND h.l_returnflag <> 'R' GROUP BY ALL"

RULES = [("A", "N", None, "1", 1), ("A", None, "R", "2", 2), ("N", "A", "A", "", 1)]


def neighbour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of an order in line order as ligatures that their neighbours decide."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("key"), F.min("l_partkey").alias("part"))
    rows = lines.select("l_orderkey", "l_linenumber", "key", F.when(F.col("part") % 9 > 0, F.col("key")).otherwise("").alias("base"))
    return decode.by_neighbours(rows, spark.createDataFrame(RULES, "key string, before string, after string, text string, rank int"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "text")


NEIGHBOUR_RULES = """WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS key, CASE WHEN min(l_partkey) % 9 > 0 THEN min(l_returnflag) ELSE '' END AS base FROM lineitem GROUP BY l_orderkey, l_linenumber),
  n AS (SELECT *, last_value(nullif(base, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(nullif(base, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM g)
  SELECT l_orderkey, l_linenumber, CASE WHEN key = 'A' AND b = 'N' THEN '1' WHEN key = 'A' AND a = 'R' THEN '2' WHEN key = 'N' AND b = 'A' AND a = 'A' THEN '' ELSE base END AS text FROM n"""

NAMES = "private_lines private_pages glyph_texts glyph_lines glyph_pages page_trees stored_chars traced_glyphs glyph_tests corpus_sizes overlay_rows neighbour_rules".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE = {name: globals()[name.upper()] for name in NAMES}
