"""Font decode tables applied to positioned glyphs, and censuses of their keys. Windows and joins, no row code.

Joins with decode tables carry no hint: Spark broadcasts a table that it knows to be small and shuffles any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import charclass as C
from glyphlake.functions.textfn import strip
from glyphlake.functions.udfs import nfkc
from glyphlake.operators import layout

PUA_ROW_GAP, PUA_WORD_GAP = 14.0, 1.0
GID_ROW_GAP, GID_WORD_GAP = 10.0, 1.2
DOT_WIDTH = 0.4
TOOTH = "بتثنپٹيیےئ"  # fixed value: letters whose dots a zero-width glyph may name


def chars_of(pages: DataFrame) -> DataFrame:
    """(page, y0, x0, x1, font, ch, cp): the characters of the text blocks of nested page trees (page, blocks)."""
    spans = pages.select("page", F.inline("blocks")).where("type = 0").select("page", F.explode("lines").alias("l")).select("page", F.explode("l.spans").alias("s"))
    chars = spans.select("page", "s.font", F.explode("s.chars").alias("c"))
    box = F.col("c.bbox")
    return chars.select("page", box[1].alias("y0"), box[0].alias("x0"), box[2].alias("x1"), "font", F.col("c.c").alias("ch"), codepoint(F.col("c.c")).alias("cp"))


def traced_glyphs(pages: DataFrame) -> DataFrame:
    """(page, y0, x0, x1, y1, font, gid, ucs): the glyphs of traced pages (page, spans), malformed ones left out.

    A glyph is (ucs, gid, bbox) as text and numbers as they come; one whose code or id is no integer, or whose box lacks
    a number, is malformed. A span without a font has the font "".
    """
    chars = pages.select("page", F.explode("spans").alias("s")).select("page", F.coalesce("s.font", F.lit("")).alias("font"), F.explode("s.chars").alias("c"))
    box = F.col("c.bbox")
    found = chars.select("page", *(F.get(box, F.lit(k)).alias(n) for n, k in (("y0", 1), ("x0", 0), ("x1", 2), ("y1", 3))), "font", F.col("c.gid").try_cast("int").alias("gid"), F.col("c.ucs").try_cast("int").alias("ucs"))
    return found.dropna(subset=["y0", "x0", "x1", "y1", "gid", "ucs"])


def overlays(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Extension: (page, mark, row_id) of overlay glyphs (page, mark, y) with the nearest row (page, row_id, y) of their page, ties to the first."""
    hosts = rows.select("page", F.col("row_id").alias("host"), F.col("y").alias("row_y"))
    found = layout.nearest(marks.select("page", "mark", "y"), hosts, ["page"], F.abs(F.col("y") - F.col("row_y")), ["mark"], "host")
    return found.select("page", "mark", F.col("host").alias("row_id"))


def by_neighbours(glyphs: DataFrame, rules: DataFrame, by: list[str], order: str) -> DataFrame:
    """Extension: glyphs (by, order, key, base) with text, by rules (key, before, after, text, rank) on the base texts beside a glyph.

    The first rule by rank whose key is the glyph's and whose before and after begin the neighbours' base texts (null: any) decides; else
    the glyph's own base text stays. Neighbours whose base text is empty are passed over.
    """
    skip = F.coalesce(F.col("base"), F.lit("")) == ""
    near = Window.partitionBy(*by).orderBy(order)
    seen = glyphs.withColumns({"prev": layout.neighbour(F.col("base"), skip, near, False), "next": layout.neighbour(F.col("base"), skip, near, True)})
    fits = lambda want, have: F.col(want).isNull() | F.coalesce(F.col(have).startswith(F.col(want)), F.lit(False))
    told = seen.join(rules.select("key", "before", "after", F.col("text").alias("ruled"), "rank"), "key", "left").withColumn("holds", F.col("rank").isNotNull() & fits("before", "prev") & fits("after", "next"))
    best = told.groupBy(*by, order, "key", "base").agg(F.min_by(F.when(F.col("holds"), F.struct("ruled")), F.when(F.col("holds"), F.col("rank"))).alias("best"))
    return best.select(*by, order, "key", "base", F.when(F.col("best").isNotNull(), F.col("best.ruled")).otherwise(F.col("base")).alias("text"))


def debug_chars(pages: DataFrame) -> DataFrame:
    """Characters in stored order with bucket and coordinates rounded to one place."""
    spans = pages.select("page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0").select("page", "b", F.posexplode("block.lines").alias("l", "line")).select("page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    chars = spans.select("page", "b", "l", "s", "span.font", "span.size", F.posexplode("span.chars").alias("n", "c"))
    box, code = F.col("c.bbox"), F.coalesce(codepoint(F.col("c.c")), F.lit(-1))
    return chars.select("page", "b", "l", "s", "n", "font", "size", F.col("c.c").alias("char"), code.alias("ord"), C.code_bucket(code).alias("bucket"), F.round(box[0], 1).alias("x"), F.round(box[1], 1).alias("y"), F.round(box[2] - box[0], 1).alias("w"))


def codepoint(char: Column) -> Column:
    """The first code point of a string; null for an empty one."""
    return F.when(F.length(char) > 0, F.conv(F.hex(F.encode(F.substr(char, F.lit(1), F.lit(1)), "UTF-32")), 16, 10).cast("int"))


def char_of(code: Column) -> Column:
    """The character of a code point; null outside Unicode."""
    fine = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))


def seed_table(seeds: DataFrame, key: str = "code") -> DataFrame:
    """(font_family, key, text) of seed files read with a map column."""
    return seeds.select("font_family", F.explode("map").alias(key, "text"))


def mapped(glyphs: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """glyphs with text from the seed (key, text), null where it has none."""
    return glyphs.join(seed.select(key, F.col("text").alias("mapped")), key, "left")


def unmapped(keys: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Rows whose key the seed lacks."""
    return keys.join(seed.select(key), key, "left_anti")


def _joined(rows: DataFrame, by: list[str], order: list[str], text: str, name: str, between: str = "") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[text]), between).alias(name))


def decode_private(glyphs: DataFrame, seed: DataFrame, wrap: bool = False) -> DataFrame:
    """(page, row_id, line): glyphs (page, y0, x0, x1, font, ch, cp) as text by a table of private-use codes (code, text).

    Rows come from gaps in y. Within a row, runs of private-use glyphs are read from right to left: neighbours
    decide some letters, combining marks join the host they lie over, and gaps become spaces. Codes that the table
    lacks show as [CODE]; a code mapped to "" is dropped.
    """
    private = F.contains("font", F.lit("Batool")) | F.col("cp").between(0xE000, 0xF8FF)
    numbered = glyphs.withColumns({"private": private, "seq": F.row_number().over(Window.partitionBy("page").orderBy("y0", F.desc("x0"), "cp"))})
    rows = layout.by_gaps(numbered, ["page"], "y0", PUA_ROW_GAP, ties=("seq",))
    runs = layout.by_change(rows, ["page", "row_id"], ["x0", "seq"], F.col("private"))
    other = _joined(runs.where(~F.col("private")), ["page", "row_id", "run_id"], ["x0", "seq"], "ch", "part")

    by = ["page", "row_id", "run_id"]
    codes = mapped(runs.where("private").withColumn("code", C.hex_key(F.col("cp"))), seed, "code")
    codes = codes.withColumn("base", F.coalesce("mapped", F.concat(F.lit("["), F.col("code"), F.lit("]"))))
    right_to_left = Window.partitionBy(*by).orderBy(F.desc("x0"), "seq")
    skip = (F.col("base") == "") | C.combining(F.coalesce("mapped", F.lit("")))
    pair = F.struct("code", "base")
    codes = codes.withColumns({"before": layout.neighbour(pair, skip, right_to_left, False), "after": layout.neighbour(pair, skip, right_to_left, True), "pos": F.row_number().over(right_to_left)})
    code, before, after = F.col("code"), F.coalesce("before.base", F.lit("")), F.coalesce("after.base", F.lit(""))
    after_code = F.coalesce("after.code", F.lit(""))
    text = (
        F.when(F.col("base") == "", None)
        .when((code == "F031") & F.coalesce(F.col("before.code") == "F0F1", F.lit(False)), None)
        .when((code == "F0F1") & (after_code == "F031"), F.when(before.startswith("ا") | before.startswith("آ"), "ئے").otherwise("ائے"))
        .when((code == "F060") & before.startswith("ن") & after.startswith("ی"), "ھ")
        .when((code == "F060") & before.startswith("م") & after.startswith("ا"), "ه")
        .when((code == "F061") & after.startswith("د"), "ھ")
        .otherwise(F.col("base"))
    )
    items = codes.withColumn("text", text).where("text is not null").select(*by, "pos", "x0", "x1", "text")
    merged = with_marks(items, by, layout.inside_or_edge)
    spaced = Window.partitionBy(*by).orderBy("pos")
    gap = F.lag("x0").over(spaced) - F.col("x1") > PUA_WORD_GAP
    merged = merged.withColumn("text", F.when(gap, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    decoded = _joined(merged, by, ["pos"], "text", "part")
    if wrap:
        decoded = decoded.withColumn("part", F.concat(F.lit("{"), F.col("part"), F.lit("}")))
    return _joined(other.unionByName(decoded), ["page", "row_id"], ["run_id"], "part", "line")


def with_marks(items: DataFrame, by: list[str], distance) -> DataFrame:
    """items (by, pos, x0, x1, text) with combining marks appended to the text of their nearest hosts, in order.

    A mark without any host in its run stays.
    """
    flagged = items.withColumn("mark", C.combining(F.col("text")))
    hosts = flagged.where(~F.col("mark")).select(*by, F.col("pos").alias("host"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"))
    marks = flagged.where("mark").select(*by, F.col("pos").alias("mark_pos"), "x0", "x1", F.col("text").alias("mark_text"))
    found = layout.nearest(marks, hosts, by, distance(F.col("x0"), F.col("x1"), F.col("hx0"), F.col("hx1")), ["mark_pos"], "host")
    extra = _joined(found, [*by, "host"], ["mark_pos"], "mark_text", "extra").withColumnRenamed("host", "pos")
    kept = flagged.join(found.select(*by, F.col("mark_pos").alias("pos")), [*by, "pos"], "left_anti").join(extra, [*by, "pos"], "left")
    return kept.select(*by, "pos", "x0", "x1", F.concat("text", F.coalesce("extra", F.lit(""))).alias("text"))


def lookup_text(mapped_text: Column, font: Column, ucs: Column, composed: Column) -> Column:
    """A glyph's text: from the table, else from a trusted ToUnicode value; null if neither. composed is NFKC of the character."""
    presentation = ucs.between(0xFB50, 0xFDFF) | ucs.between(0xFE70, 0xFEFF)
    char = F.when(presentation, composed).otherwise(char_of(ucs))
    printable = char.rlike(r"^[^\p{C}\p{Z}]$|^ $") | char.rlike(f"^[{C.SPACE}]$")
    own = F.when(C.kept_font(font), F.when(C.good_code(ucs), char)).when(~ucs.isin(0xFFFD, 0xFFFF) & (presentation | printable), char)
    return F.coalesce(mapped_text, own)


def decode_glyphs(glyphs: DataFrame, seed: DataFrame) -> DataFrame:
    """(page, row_id, line): glyphs (page, y0, x0, x1, font, gid, ucs) as text by a table of glyph keys (key, text).

    Zero-width letters of kept fonts are dots: they are dropped and, where the next glyph is unknown, blank or a tooth,
    name it. Gaps become spaces, except before a combining mark; marks join the nearest centre, spaces included.
    """
    keyed = glyphs.withColumns({"key": C.glyph_key(F.col("font"), F.col("gid")), "seq": F.row_number().over(Window.partitionBy("page").orderBy("y0", F.desc("x0"), "gid"))})
    rows = layout.by_gaps(mapped(keyed, seed, "key"), ["page"], "y0", GID_ROW_GAP, ties=("seq",))
    by = ["page", "row_id"]
    order = Window.partitionBy(*by).orderBy(F.desc("x0"), "seq")
    rows = rows.withColumns({"pos": F.row_number().over(order), "composed": nfkc(char_of(F.col("ucs"))), "kept": C.kept_font(F.col("font"))})
    rows = rows.withColumn("text", lookup_text(F.col("mapped"), F.col("font"), F.col("ucs"), F.col("composed")))
    dot = (F.col("x1") - F.col("x0") < DOT_WIDTH) & F.col("kept") & C.arabic_letter(char_of(F.col("ucs"))) & C.good_code(F.col("ucs"))
    host = F.col("kept") & ~F.col("text").eqNullSafe(F.lit(" "))
    rows = rows.withColumn("host", F.when(dot, layout.neighbour(F.col("pos"), ~host, order, True)))
    names = rows.where("host is not null").groupBy(*by, F.col("host").alias("pos")).agg(F.max_by(char_of(F.col("ucs")), "pos").alias("named"))
    tooth = F.col("text").isNull() | (F.col("text") == "") | F.substr("text", F.lit(1), F.lit(1)).isin(*TOOTH)
    rows = rows.where("host is null").join(names, [*by, "pos"], "left").withColumn("text", F.when(F.col("named").isNotNull() & tooth, F.col("named")).otherwise(F.col("text")))
    rows = rows.where("text is null or text <> ''")
    spaced = Window.partitionBy(*by).orderBy("pos")
    gap = F.coalesce(F.lag("x0").over(spaced) - F.col("x1") > GID_WORD_GAP, F.lit(False)) & ~C.combining(F.col("text"))
    shown = F.coalesce("text", F.concat(F.lit("["), F.col("key"), F.lit("]")))
    pieces = rows.withColumn("gap", gap).withColumn("piece", F.explode(F.when(F.col("gap"), F.array(F.struct(F.lit(0).alias("k"), F.lit(" ").alias("t")), F.struct(F.lit(1).alias("k"), shown.alias("t")))).otherwise(F.array(F.struct(F.lit(1).alias("k"), shown.alias("t"))))))
    pieces = pieces.select(*by, (F.col("pos") * 2 + F.col("piece.k")).alias("pos"), "x0", "x1", F.col("piece.t").alias("text"))
    return _joined(with_marks(pieces, by, layout.between_centres), by, ["pos"], "text", "line")


def page_text(decoded: DataFrame) -> DataFrame:
    """(page, text): the lines of a page that are not blank, stripped, one below the other."""
    return _joined(decoded.withColumn("line", strip(F.col("line"))).where("line <> ''"), ["page"], ["row_id"], "line", "text", "\n")


def harvest(glyphs: DataFrame, key: str, value: str, page: str) -> DataFrame:
    """(key, value, n, first_page, first_seen): how often each key has each value. Partial sums in each task, then by key."""
    return glyphs.groupBy(key, value).agg(F.count("*").alias("n"), F.min(page).alias("first_page"), F.min("seq").alias("first_seen"))


def likely_values(harvested: DataFrame, key: str, value: str, good: Column, least: float = 0.9) -> DataFrame:
    """(key, value, n, total, first_page): the commonest good value where it makes up at least this share of all of a key's."""
    rank = F.struct("n", -F.col("first_seen"))
    top = harvested.groupBy(key).agg(F.sum("n").alias("total"), F.min("first_page").alias("first_page"), F.max_by(F.when(good, F.struct(value, "n")), F.when(good, rank)).alias("top"))
    return top.where(F.col("top.n") / F.col("total") >= least).select(key, f"top.{value}", "top.n", "total", "first_page")


def evidence(value: Column, n: Column, total: Column, first_page: Column) -> Column:
    return F.format_string("auto ToUnicode U+%s n=%d/%d first_p%03d", C.hex_key(value), n, total, first_page)


def coverage(totals: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """One row: instances mapped and unknown, their percentage, unknown keys, and those seen once. totals has key and n."""
    flagged = totals.join(seed.select(key, F.lit(True).alias("known")), key, "left")
    known = F.coalesce("known", F.lit(False))
    out = flagged.agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("mapped_n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown_n"), F.count_if(~known).alias("unknown_keys"), F.count_if(~known & (F.col("n") == 1)).alias("unknown_once"))
    total = F.col("mapped_n") + F.col("unknown_n")
    return out.withColumn("mapped_pct", F.when(total > 0, 100.0 * F.col("mapped_n") / total).otherwise(0.0))


def codes_by_page(codes: DataFrame, seed: DataFrame, page: str, key: str) -> DataFrame:
    """(page, codes, known_codes): distinct codes and mapped ones by page, and over all pages where page is null."""
    flagged = codes.select(page, key).distinct().join(seed.select(key, F.lit(1).alias("known")), key, "left")
    return flagged.rollup(page).agg(F.countDistinct(key).alias("codes"), F.countDistinct(F.when(F.col("known") == 1, F.col(key))).alias("known_codes"))


def transfer(totals: DataFrame, seed: DataFrame, doc: str, key: str) -> DataFrame:
    """Extension: (doc, mapped_share, bucket): how much of each document a table decodes."""
    known = totals.join(seed.select(key, F.lit(True).alias("known")), key, "left").groupBy(doc).agg((F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("mapped_share"))
    return known.withColumn("bucket", F.when(F.col("mapped_share") >= 0.9, "90").when(F.col("mapped_share") >= 0.5, "50-89").when(F.col("mapped_share") > 0, "1-49").otherwise("0"))
