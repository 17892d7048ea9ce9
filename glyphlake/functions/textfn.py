"""Text scalars as column expressions, with Python's idea of white space and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.charclass import SPACE

# Marks that scoring leaves out, line ends, and the letters of a headword.
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08E4}-\x{08FF}]"
HONORIFICS = r"[\x{0610}-\x{0615}]"
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{0085}\x{2028}\x{2029}]"
# Fixed value: lines of a transcription that describe the page.
SKIPPED_LINE = r"(?i)^\[(illustration|photo|blank|badge|footer|stamp|handwritten|oval|logo)[:\]]"
DEVANAGARI_CLASS = r"[\x{0900}-\x{097F}\x{097D}\x{093D}\x{0964}\x{0965}]"


# Fixed value: the characters that Python's strip() takes off.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the end starts no further line, and an empty text has none."""
    cut = F.split(text, LINE_END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def words(text: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def scoring_tokens(text: Column, marks: str = ":،۔,") -> Column:
    """Words of a transcription as they are scored. The text must be in normal form C (functions.udfs.nfc).

    Blank lines and lines that describe the page are dropped, [[x]] is unwrapped, and no white space stays before
    the marks, one space after them.
    """
    kept = F.filter(F.transform(lines(text), strip), lambda s: (s != "") & ~s.rlike(SKIPPED_LINE) & ~(s.startswith("[") & s.endswith("]")))
    flat = F.regexp_replace(F.array_join(kept, " "), r"\[\[([^\]]+)\]\]", "$1")
    flat = F.regexp_replace(flat, f"[{SPACE}]+([{marks}])", "$1")
    return words(F.regexp_replace(flat, f"([{marks}])[{SPACE}]+", "$1 "))


def without_diacritics(word: Column) -> Column:
    return F.regexp_replace(word, DIACRITICS, "")


def fold_heh(word: Column) -> Column:
    return F.translate(word, "ہھه", "HHH")


def fold_digits(word: Column) -> Column:
    return F.translate(word, "۰۱۲۳۴۵۶۷۸۹", "0123456789")


def substitution_category(gold: Column, found: Column, diacritics: str = DIACRITICS, honorifics: str = HONORIFICS, letters: str = r"\p{L}\p{N}\p{Nd}_\x{0600}-\x{06FF}", heh: tuple[str, str] = ("ہھه", "HHH"), digits: tuple[str, str] = ("۰۱۲۳۴۵۶۷۸۹", "0123456789")) -> Column:
    """Why two words differ; the first reason that holds."""
    bare = lambda w: F.regexp_replace(w, diacritics, "")
    plain = lambda w: bare(F.regexp_replace(w, honorifics, ""))
    core = lambda w: F.regexp_replace(w, f"[^{letters}]", "")
    return (
        F.when(bare(gold) == bare(found), "diacritic")
        .when(plain(gold) == plain(found), "honorific")
        .when(bare(F.translate(gold, *heh)) == bare(F.translate(found, *heh)), "heh")
        .when((F.translate(gold, *digits) == F.translate(found, *digits)) & (gold != found), "digit_system")
        .when((core(gold) != "") & (core(gold) == core(found)), "punct_other")
        .otherwise("letter_or_word")
    )


def slug(path: Column) -> Column:
    """A file name's stem as a slug; "book" if nothing is left."""
    name = F.substring_index(path, "/", -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    made = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_]+", "-"), "^-+|-+$", ""))
    return F.when(made == "", "book").otherwise(made)


def parent_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def page_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"-(\d+)\.txt$", 1).cast("int")


def english_snippet(line: Column) -> Column:
    """A short gloss: what follows the first part-of-speech marker, else the Latin run after a closing bracket, else ""."""
    marked = F.regexp_extract(line, r"(?:nm:|nf:|v:|adj\.|adv\.|conj\.|A\.)\s*(.{0,120})", 1)
    has = line.rlike(r"(?:nm:|nf:|v:|adj\.|adv\.|conj\.|A\.)\s*(.{0,120})")
    return F.coalesce(strip(F.when(has, marked).otherwise(F.regexp_extract(line, r"\)\s*([A-Za-z][^.\n]{3,80})", 1))), F.lit(""))


def json_array(text: Column, schema: str) -> Column:
    """A JSON array of a model's answer, with or without a code fence around it; fails if it is none."""
    bare = F.regexp_replace(strip(text), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    return F.when(bare.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("expected a JSON array")).cast(schema))


def newline_at_end(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def tag_of_run(page: Column, stem: Column) -> Column:
    """The part of a transcription's file name between the page and "_original"."""
    return F.regexp_replace(F.substr(stem, F.length(page) + 2), "_original$", "")


def sampled_pages(n: Column, k: int = 10) -> Column:
    """Page indexes spread over a document of n pages without the first; all of them up to k pages."""
    spread = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(n - 1, F.floor(i * (n / F.lit(float(k)))).cast("int")))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n - 1)).when(F.size(spread) > 1, F.slice(spread, 2, k)).otherwise(spread)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays: each distinct word becomes one character, and Spark's levenshtein does the rest.

    There are characters for a million distinct words a pair; more are an error.
    """
    known = F.array_distinct(F.concat(a, b))

    def char(word: Column) -> Column:
        at = F.array_position(known, word) + 0x100
        return F.decode(F.unhex(F.lpad(F.hex(F.when(at < 0xD800, at).otherwise(at + 0x800)), 8, "0")), "UTF-32")

    as_text = lambda ws: F.array_join(F.transform(ws, char), "")
    return F.when(F.size(known) > 1_000_000, F.raise_error(F.lit("more than a million distinct words in a pair")).cast("int")).otherwise(F.levenshtein(as_text(a), as_text(b)))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
