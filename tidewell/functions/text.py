"""Text repair, folding and tokens as column expressions (null in, null out unless said otherwise)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page furniture that precedes an article, as alternatives of one pattern.
LEAD_INS = (
    r"(?:\+\d+\s+)?video\s+(?:için|icin)\s+play['’]e\s+(?:tıklayın|tiklayin)",
    r"(?:\+\d+\s+)?haber\s+alb(?:ü|u)m(?:ü|u)\s+(?:için|icin)\s+resme\s+(?:tıklayın|tiklayin)",
    r"(?:büyütmek|buyutmek)\s+(?:için|icin)\s+resme\s+(?:tıklayın|tiklayin)",
    r"(?:whatsapp|twitle|paylaş|paylas|abone ol|google news)",
)
INLINE = (
    r"\b(?:büyütmek|buyutmek)\s+(?:için|icin)\s+resme\s+(?:tıklayın|tiklayin)\b\s*(?:[-+|]\s*)*",
    r"\bhaber\s+alb(?:ü|u)m(?:ü|u)\s+(?:için|icin)\s+resme\s+(?:tıklayın|tiklayin)\b\s*(?:[-+|]\s*)*",
)

#: Case endings in the order in which they are tried.
CASE_SUFFIXES = (
    "dekiler dakiler tekiler takiler deki daki teki taki nde nda de da te ta nden ndan den dan ten tan ne na ye ya "
    "ni nı nu nü yi yı yu yü nin nın nun nün in ın un ün yle yla le la ler lar"
).split()



def plain(char: str) -> str:
    """A character decomposed for comparison, without marks; dotless i is an i."""
    return "i" if char == "\u0131" else "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


#: Letters of the scripts that put marks on letters (Latin, Greek, Cyrillic, and the presentation forms of Latin), with
#: what they decompose to: one character goes into one translation, several are replaced one by one.
LETTERS = [c for lo, hi in ((0xAA, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFB00, 0xFB07)) for c in map(chr, range(lo, hi)) if c.isalpha() and plain(c) not in (c, "")]
FOLD_FROM = "".join(c for c in LETTERS if len(plain(c)) == 1)
FOLD_TO = "".join(plain(c) for c in FOLD_FROM)
EXPANSIONS = {c: plain(c) for c in LETTERS if len(plain(c)) > 1}

#: The lookahead turns other characters away by one comparison; the list alone is tried letter by letter.
EXPANDED = f"(?=[{min(EXPANSIONS)}-{max(EXPANSIONS)}])[{''.join(EXPANSIONS)}]"

WORD = r"[\p{L}\p{N}_]+"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_mojibake(c) -> Column:
    """UTF-8 that was read as Latin-1, undone where both steps succeed; else unchanged."""
    c = as_column(c)
    raw = F.when(c.rlike(r"^[\x00-\xFF]*$"), F.encode(c, "ISO-8859-1"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), c)


def clean_text(c) -> Column:
    """Repaired text without page furniture, single spaces, no edge punctuation; blank gives null.

    The alternation repeats at the start of the text, which is the fixpoint of stripping one lead-in at a time.
    """
    text = F.regexp_replace(repair_mojibake(c), r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?iU)^(?:[-+|/ ]*\s*(?:" + "|".join(LEAD_INS) + r")\s*(?:[-+|/]\s*)*)+", "")
    text = F.regexp_replace(text, r"(?U)^[-+|/\s]+", "")
    for pattern in INLINE:
        text = F.regexp_replace(text, "(?iU)" + pattern, "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.nullif(F.regexp_replace(text, r"^[ \-+|/]+|[ \-+|/]+$", ""), F.lit(""))


def fold(c) -> Column:
    """Comparison form: letters without marks, no apostrophes, lower case, hyphens as spaces, single spaces."""
    text = F.translate(as_column(c), FOLD_FROM, FOLD_TO)
    spelled = text
    for letter, letters in EXPANSIONS.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    # few texts have such a letter: the others are not copied
    text = F.when(text.rlike(EXPANDED), spelled).otherwise(text)
    text = F.lower(F.regexp_replace(text, "[’']", ""))
    text = F.replace(F.regexp_replace(text, r"\p{M}", ""), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_token(c) -> Column:
    """Identifier form: folded, words joined by single underscores."""
    text = F.regexp_replace(fold(c), r"[\s_]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def strip_suffix(c, suffixes=CASE_SUFFIXES) -> Column:
    """The root before an apostrophe, or without the first listed ending that leaves over two letters."""
    text = F.trim(as_column(c))
    head = F.trim(F.regexp_extract(text, r"^([^'’`ʼ]*)['’`ʼ]", 1))
    # endings are tried in order, which a plain alternation at the end of the text would not do
    cut = text
    for s in reversed(suffixes):
        cut = F.when(F.lower(text).endswith(s) & (F.length(text) > len(s) + 2), F.left(text, F.length(text) - len(s))).otherwise(cut)
    return F.when(head != "", head).otherwise(cut)


def suffix_candidates(c) -> Column:
    """Spellings of a span in the order in which a dictionary is asked."""
    c = F.trim(as_column(c))
    return F.filter(F.array_distinct(F.array(c, strip_suffix(c), strip_suffix(strip_suffix(c)))), lambda x: x != "")


def normalize_place(c) -> Column:
    return strip_suffix(F.regexp_replace(as_column(c), r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def words(c) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(WORD), 0)


def summary(body, size: int = 280) -> Column:
    return F.trim(F.left(clean_text(body), F.lit(size)))


def text_payload(title, summary_, content, size: int = 4000) -> Column:
    """Title, summary and the first part of the content on lines of their own; null parts are left out."""
    return F.concat_ws("\n", F.nullif(F.trim(as_column(title)), F.lit("")), F.nullif(F.trim(as_column(summary_)), F.lit("")), F.nullif(F.left(F.trim(as_column(content)), F.lit(size)), F.lit("")))


def executive_summary(summary_, content, size: int = 240) -> Column:
    """The longer of content and summary, cut at the last sentence end within size, or else at size."""
    text = F.when(F.length(F.coalesce(as_column(content), F.lit(""))) > F.length(F.coalesce(as_column(summary_), F.lit(""))), as_column(content)).otherwise(as_column(summary_))
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    whole = F.regexp_extract(F.left(text, F.lit(size)), r"^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= size, text).when(whole != "", whole).otherwise(F.concat(F.rtrim(F.left(text, F.lit(size))), F.lit("…")))


def displayed_location(text, district) -> Column:
    """The location text if it names the district, else the district."""
    t, d = as_column(text), as_column(district)
    return F.when(F.contains(fold(t), fold(d)), t).otherwise(F.coalesce(d, t))


def strip_noise(c, patterns: list[str]) -> Column:
    text = as_column(c)
    for p in patterns:
        text = F.regexp_replace(text, "(?iU)" + p, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def embedded_district(c, districts: list[str]) -> Column:
    """The first listed district with which the text starts, followed by a space; null if none."""
    t = fold(c)
    return F.coalesce(*[F.when(F.startswith(t, F.concat(fold(F.lit(d)), F.lit(" "))), F.lit(d)) for d in districts], F.lit(None).cast("string"))


def extract_neighborhood(c, words: list[str]) -> Column:
    """The trimmed text if it holds one of the neighbourhood words as a whole word; null if not."""
    text = F.trim(as_column(c))
    some = "|".join(re.escape(w) + (r"\b" if w[-1:].isalnum() else r"(?=\w)") for w in words)
    return F.when(text.rlike(rf"(?iU)\b(?:{some or '(?!)'})"), text)
