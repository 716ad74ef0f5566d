"""Text functions: line splits, folds, words and shingles, surfaces, keys of names and places."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: LF, CR, CRLF, NEL and the Unicode separators.
LINE_BREAK = "\\r\\n|[\\n\\r\\u0085\\u2028\\u2029]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def lines(text: Column) -> Column:
    """The lines of a text; an empty last one isn't one."""
    return let(F.split(text, LINE_BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def trim(text: Column) -> Column:
    """Without white space of any kind at either end; Spark's own trim() takes spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased, sharp s as two."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Runs of a-z and 0-9, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, n: int) -> Column:
    """64-bit hashes of all runs of n tokens, each once; none if there are fewer. Tokens are worked out once for a row, not for each run."""

    def runs(words: Column) -> Column:
        count = F.size(words) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
        return F.when(count > 0, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, runs)


def normalise_surface(text: str, drop_the: bool = False) -> str:
    """NFC, lower case and single spaces; for organizations also without a leading ``the``."""
    found = " ".join(unicodedata.normalize("NFC", text).lower().split())
    return found.removeprefix("the ") if drop_the else found


def nfkc(text: Column) -> Column:
    """NFKC and case-folded; an Arrow function, as there is no native one."""

    @F.arrow_udf(StringType())
    def fold(column):
        import pyarrow as pa

        return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in column.to_pylist()], pa.string())

    return fold(text)


def person_key(name: str) -> tuple[str, str] | None:
    """(given, surname) without accents and generation suffixes; reads ``Surname, Given`` too."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    last, comma, first = plain.partition(",")
    if comma:
        given, family = re.findall("[a-z]+", first), re.findall("[a-z]+", last)
        return (given[0], family[-1]) if given and family else None
    parts = re.findall("[a-z]+", plain)
    while parts and parts[-1] in {"jr", "sr", "ii", "iii", "iv"}:
        del parts[-1]
    return (parts[0], parts[-1]) if len(parts) > 1 else None


def plausible_span(text: Column) -> Column:
    """Has a letter, and isn't Latin text in lower case throughout."""
    return text.rlike(r"\p{L}") & ~(text.rlike(r"\p{IsLatin}") & (F.lower(text) == text))


def organization_shape(text: Column) -> Column:
    """acronym, long_name (four words or more) or other."""
    n = F.size(F.split(trim(text), r"(?U)\s+"))
    return F.when(text.rlike(r"^[A-Z][A-Z0-9&.-]{1,9}$"), "acronym").when(n >= 4, "long_name").otherwise("other")
