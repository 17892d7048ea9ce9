"""Credits of a corpus, the log of model runs, and totals over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.charclass import SPACE, contains_any, count_of
from glyphlake.functions.textfn import parent_folder

# Fixed values: (substrings of path and name, text) of credits, and of notes; folders with a note of their own.
CREDITS = (
    (("javaidrahi", "javaid_rahi", "rahi"), "Dr. Javaid Rahi (editor/compiler on many volumes in this set)"),
    (("anjum", "rafiq", "rafique"), "Prof. (Dr.) Rafique Anjum / Anjum Shanasi-linked publications where applicable"),
    (("ruksana", "sadiq"), "Ms. Ruksana Sadiq (where credited on the title page)"),
)
DEFAULT_CREDIT = "Original author(s) and publisher as printed in the book; check the title page"
FOLDERS = ("anjumshanasi", "javaidrahi-blog")
NOTES = (
    (("dictionary", "kosh", "lughat"), "Dictionary / glossary volume"),
    (("quran",), "Quranic translation volume"),
    (("textbook", "kitab", "pehli", "shingar"), "Textbook / primer material"),
)


def joined(text: Column, rules: tuple, before: tuple[Column, ...] = ()) -> Column:
    """The texts of all rules that hold, in order, joined by "; "."""
    return F.concat_ws("; ", *before, *(F.when(contains_any(text, words), said) for words, said in rules))


def credits(path: Column, name: Column, rules: tuple = CREDITS, notes: tuple = NOTES, folders: tuple = FOLDERS, default: str = DEFAULT_CREDIT) -> Column:
    """struct(credits, notes) of a file."""
    low = F.lower(F.concat_ws(" ", path, name))
    folder = parent_folder(path)
    own = tuple(F.when(folder == f, f"Local folder: {f}/") for f in folders)
    return F.struct(F.coalesce(F.nullif(joined(low, rules), F.lit("")), F.lit(default)).alias("credits"), joined(low, notes, own).alias("notes"))


def scope_label(flag: Column) -> Column:
    return F.when(flag == 1, "in_scope").otherwise("out_of_scope")


def corpus_sizes(files: DataFrame) -> DataFrame:
    """Extension: (file, words, replaced): words and U+FFFF marks of each file (file, text)."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), f"[{SPACE}]+"), lambda w: w != ""))
    return files.select("file", words.cast("long").alias("words"), count_of(F.col("text"), r"\x{FFFF}").cast("long").alias("replaced"))


def token_totals(log: DataFrame, by: list[str]) -> DataFrame:
    """Runs, and tokens in, out and in all, by group."""
    return log.groupBy(*by).agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))
