"""Text functions on columns: normalisation, ids, cleaning, words. Nulls stay null unless said otherwise."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from polyweave.functions import fixed as X

_SPACES = r"(?U)\s+"


@arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normal form C; Spark has no built-in for it, and Arrow's does not compose. One text at a time is a Python string."""
    return pa.array((None if s is None else unicodedata.normalize("NFC", s) for s in (x.as_py() for x in text)), pa.string(), size=len(text))


def _digits() -> tuple[str, str]:
    """Every character with a digit value beyond ASCII, and its ASCII digit."""
    found = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(128, sys.maxunicode + 1) if chr(c).isdigit()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_DIGITS = _digits()


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, X.ZERO_WIDTH, "")


def collapse_space(text: Column) -> Column:
    """Runs of any white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def map_punctuation(text: Column) -> Column:
    plain = F.translate(text, X.PUNCTUATION[0] + X.TATWEEL, X.PUNCTUATION[1])
    return F.replace(plain, F.lit(X.ELLIPSIS), F.lit("..."))


def map_digits(text: Column) -> Column:
    return F.translate(text, *_DIGITS)


def fold_arabic(text: Column) -> Column:
    joined = F.replace(text, F.lit("يٰ"), F.lit("ي"))
    return F.translate(joined, X.ARABIC[0] + X.HARAKAT + X.TATWEEL, X.ARABIC[1])


def fold_nukta(text: Column, full: bool = False) -> Column:
    """Nukta off the two decomposed consonants (all with ``full``), chandrabindu to anusvara."""
    if full:
        text = F.regexp_replace(text, "([\\u0915-\\u0939])\\u093C", "$1")
    for pair in X.NUKTA:
        text = F.replace(text, *map(F.lit, pair))
    return F.translate(text, X.CHANDRABINDU, X.ANUSVARA)


def tidy_bengali(text: Column) -> Column:
    """Stray vowel signs off, split ones joined, doubled nukta single."""
    base, signs, vowels = X.BENGALI_BASE, X.BENGALI_SIGNS, X.BENGALI_VOWELS
    text = F.regexp_replace(text, f"(?<![{base}])[{signs}]", "")
    text = F.regexp_replace(text, "(?U)([োো])\\s+[োো]", "$1")
    text = F.regexp_replace(text, f"(?U)([{base}])\\s+([{vowels}])", "$1$2")
    text = F.regexp_replace(text, f"^[{vowels}]+", "")
    text = F.regexp_replace(text, "়+", "়")
    return F.replace(F.replace(text, F.lit("্ী"), F.lit("ী")), F.lit("  "), F.lit(" "))


def normalize(text: Column, code: Column | str) -> Column:
    """Full normalisation for a language's text code."""
    code = F.lit(code) if isinstance(code, str) else code
    plain = collapse_space(map_digits(map_punctuation(strip_zero_width(nfc(text)))))
    own = F.when(code.contains("urd") | code.contains("arabic"), fold_arabic(plain))
    own = own.when(code.isin("asm", "ben"), tidy_bengali(plain)).when(code.isin(*X.INDIC_CODES), fold_nukta(plain))
    return collapse_space(own.otherwise(plain))


def safe_component(part: Column) -> Column:
    return F.regexp_replace(F.trim(part), _SPACES, "_")


def sentence_id(language: Column, episode: Column, normalized: Column) -> Column:
    """``<episode>_<language>_<16 hex digits>`` from the normalised text; null if any part is."""
    key = F.concat(language, F.lit("|"), episode, F.lit("|"), collapse_space(normalized))
    return F.concat(safe_component(episode), F.lit("_"), safe_component(language), F.lit("_"), F.substring(F.sha1(key.cast("binary")), 1, 16))


def tsv_field(text: Column) -> Column:
    """Null to empty; tabs and line breaks to a space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\r\n]+", " "))


def clean_underscores(text: Column, language: Column) -> Column:
    return F.when(language == "Assamese", F.replace(text, F.lit("_"), F.lit(" "))).otherwise(text)


def flatten_paragraph(text: Column) -> Column:
    return collapse_space(F.regexp_replace(text, r"(?U)\s*\n\s*", " "))


def words(text: Column) -> Column:
    """White-space words; none for a blank text."""
    return F.filter(F.split(F.trim(text), _SPACES), lambda w: w != "")


def has_words(text: Column, n: int) -> Column:
    """Whether ``words`` finds ``n`` or more; looks at no more than these."""
    if n > 64:  # a pattern's repeats are nested calls
        return F.size(words(text)) >= n
    return text.rlike(f"(?U)^\\s*+(?:\\S++\\s++){{{n - 1}}}\\S") if n > 0 else text.isNotNull()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?U)(?<=[.!?।॥])\s+"), lambda p: F.trim(p) != "")


def drop_weak_leading(text: Column, weak: int = 3, strong: int = 6) -> Column:
    """Parts of at most ``weak`` words go, but for the last, if some part has ``strong`` words."""

    def cut(parts: Column) -> Column:
        kept = F.filter(parts, lambda p, i: has_words(p, weak + 1) | (i == F.size(parts) - 1))
        return F.when((F.size(parts) > 1) & F.exists(parts, lambda p: has_words(p, strong)), F.array_join(kept, " ")).otherwise(F.trim(text))

    return bound(_parts(text), cut)


def drop_fragments(text: Column, weak: int = 3, strong: int = 4) -> Column:
    """Unfinished parts of at most ``weak`` words go, if some part is finished or has ``strong`` words."""
    finished = lambda p: p.rlike(r"[.!?।॥]$")

    def cut(parts: Column) -> Column:
        real = F.exists(parts, lambda p: finished(p) | has_words(p, strong))
        kept = F.filter(parts, lambda p: finished(p) | has_words(p, weak + 1))
        return F.when(real, F.array_join(kept, " ")).otherwise(F.trim(text))

    return bound(_parts(text), cut)


def keep_letters(text: Column, numbers: bool = True) -> Column:
    """Letters, marks, spaces and, by default, numbers; all else is deleted."""
    spaced = F.regexp_replace(text, r"\p{Zs}", " ")
    return collapse_space(F.regexp_replace(spaced, r"[^\p{L}\p{M}" + (r"\p{N}" if numbers else "") + " ]", ""))


def display_similarity(raw: Column, aligned: Column, band: float = X.DISPLAY_BAND) -> Column:
    return F.bround(F.when(aligned, raw).otherwise(raw * band), 4)


def parse_units(text: Column) -> Column:
    """Unit list from its text; null where it is none."""
    return F.from_json(text, "array<int>")


def episode_number(episode: Column) -> Column:
    """Number of an episode name; infinite where it has none."""
    found = F.regexp_extract(episode, r"MKB_(\d+)", 1)
    return F.when(found != "", found.cast("double")).otherwise(F.lit(float("inf")))


def mixes_scripts(word: Column, script: str) -> Column:
    """Whether one word holds letters of the script and other letters."""
    own = X.SCRIPTS[script]
    return word.rlike(f"[\\p{{L}}&&[{own}]]") & word.rlike(f"[\\p{{L}}&&[^{own}]]")


def margin(similarity: Column, threshold: Column) -> Column:
    return F.when(threshold != 0, (similarity - threshold) / threshold)
