"""Tokenisers of the text indexes, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_folds() -> tuple[str, str]:
    """Latin letters with diacritics, and what they fold to: the base letter of the canonical decomposition, in lower case."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and "LATIN" in unicodedata.name(letter, ""):
            marked.append(letter)
            plain.append(parts[0].lower())
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_folds()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def lowered(text: Column) -> Column:
    """Lower case with one small sigma."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def folded(text: Column | str) -> Column:
    """Lower case without the diacritics of Latin letters; other scripts keep theirs."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.length(text)
    return lowered(F.when(plain, text).otherwise(F.translate(text, _MARKED, _PLAIN)))


def unicode_tokens(text: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def trigrams(text: Column) -> Column:
    """Every three characters in a row of the lower-case text, accents, spaces and punctuation kept."""
    chars = F.split(lowered(text), "")
    n = F.size(chars) - 2
    # Shifted slices: reaching into the string for each place would read it from its start each time.
    join = lambda a, b: F.concat(a, b)
    three = F.zip_with(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), join), F.slice(chars, 3, n), join)
    return F.when(n > 0, three).otherwise(F.array().cast("array<string>"))


TOKENIZERS = {"unicode": unicode_tokens, "trigram": trigrams}


def query_terms(query: Column) -> Column:
    """Distinct white-space separated terms of a lower-case query; none for a blank one."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda t: t != ""))
