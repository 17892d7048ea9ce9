"""Code-point classes as column expressions: counts, tests and ratios, all inside the JVM.

Ranges are Java regular expressions. The manifest's, the extractor's and the glyph tests' ideas of "Arabic" and
"garbage" differ and are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
ARABIC_EXTENDED = r"\x{08A0}-\x{08FF}"
DEVANAGARI = r"\x{0900}-\x{097F}"
PRIVATE_USE = r"\x{E000}-\x{F8FF}"
REPLACEMENT = r"\x{FFFD}\x{FFFF}"
PRESENTATION = r"\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
LATIN = "A-Za-z"
QUIET = r"\x{00A0}-\x{00FF}\x{2000}-\x{206F}"
BIDI_CONTROLS = r"\x{200C}\x{200D}\x{200E}\x{200F}\x{061C}"
SPACE = r"\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Font names, function words and path words that decide a category.
NASTALIQ_FONTS = ("noorin", "noori", "nastaliq", "nastaleeq", "batool", "aseer", "sadaf", "unwan", "zakharif", "jameel", "alvi", "faiz", "urdu", "naskh", "arabic")
ENGLISH_WORDS = (" the ", " and ", " of ", " in ", " to ", " is ", " was ", " that ", " for ")
PARALLEL_NAMES = ("dictionary", "kosh", "glossar", "lughat", "vocab")
KEPT_FONTS = ("urdutypesetting", "arabictypesetting", "traditionalarabic")

#: What the manifest counts; each is a regular expression class.
MANIFEST_CLASSES = {
    "total_chars": f"[^{SPACE}]",
    "arabic_chars": f"[{ARABIC}]",
    "devanagari_chars": f"[{DEVANAGARI}]",
    "pua_chars": f"[{PRIVATE_USE}]",
    "replacement_chars": f"[{REPLACEMENT}]",
    "presentation_chars": f"[{PRESENTATION}]",
    "latin_chars": f"[{LATIN}]",
    "garbage_chars": rf"[^\x{{0000}}-\x{{007F}}{ARABIC}{DEVANAGARI}{PRIVATE_USE}{REPLACEMENT}{PRESENTATION}{QUIET}{SPACE}]",
}


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of text are in a class; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def class_counts(text: Column, classes: dict[str, str] | None = None) -> dict[str, Column]:
    return {name: count_of(text, pattern) for name, pattern in (classes or MANIFEST_CLASSES).items()}


def garbage_ratio(text: Column, kept: str = ARABIC + DEVANAGARI + PRESENTATION) -> Column:
    """Share of visible characters that are neither ASCII nor in a kept script, replacement characters included; 0.0 for none."""
    visible = count_of(text, f"[^{SPACE}]")
    bad = count_of(text, rf"[^\x{{0000}}-\x{{007F}}{kept}{SPACE}]")
    return F.when(visible > 0, bad / visible).otherwise(0.0)


def code_bucket(code: Column) -> Column:
    """Debug bucket of one code point."""
    return (
        F.when(code.between(0xE000, 0xF8FF), "pua")
        .when(code.between(0x0600, 0x06FF) | code.between(0x0750, 0x077F) | code.between(0x08A0, 0x08FF), "arabic")
        .when(code.between(0x0900, 0x097F), "devanagari")
        .when(code.between(32, 126), "ascii")
        .when(code == 0xFFFD, "replacement")
        .otherwise("other")
    )


def good_code(code: Column) -> Column:
    """Whether a ToUnicode value can be trusted as text."""
    ranges = ((32, 126), (0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
    inside = code.isin(0x200C, 0x200D, 0x200E, 0x200F, 0x061C)
    for low, high in ranges:
        inside = inside | code.between(low, high)
    return F.coalesce(inside & ~code.isin(0xFFFD, 0xFFFF), F.lit(False))


def arabic_letter(char: Column) -> Column:
    return F.coalesce(char.rlike(rf"^[\p{{L}}&&[{ARABIC}]]$"), F.lit(False))


def combining(text: Column) -> Column:
    """Whether text is not empty and has combining marks only."""
    return F.coalesce(text.rlike(r"^[\p{Mn}\p{Mc}]+$"), F.lit(False))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def english_hits(text: Column, words: tuple[str, ...] = ENGLISH_WORDS) -> Column:
    """How many of the function words occur in the text in lower case with white space collapsed."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "), F.lit(" "))
    hits = bind(flat, lambda t: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)))
    return F.coalesce(hits, F.lit(0))


def nastaliq_font(fonts: Column) -> Column:
    """Whether the font names, joined by spaces, hold a hint of Perso-Arabic typesetting."""
    return contains_any(F.lower(F.array_join(fonts, " ")), NASTALIQ_FONTS)


def font_family(font: Column) -> Column:
    """A font's name without subset prefix and style."""
    return F.substring_index(F.substring_index(font, "+", -1), ",", 1)


def kept_font(font: Column) -> Column:
    return contains_any(F.lower(font_family(font)), KEPT_FONTS)


def glyph_key(font: Column, gid: Column) -> Column:
    return F.concat_ws(":", font_family(font), gid.cast("string"))


def hex_key(code: Column) -> Column:
    """A code point as four or more upper-case hexadecimal digits."""
    digits = F.hex(code.cast("long"))
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
