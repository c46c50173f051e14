"""Text and date expressions, all native."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Every lower-case character of the basic plane whose canonical decomposition is one of a-z and marks."""
    pairs = []
    for i in range(0x80, 0x10000):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and len(base) == 1 and "a" <= base <= "z":
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def normalise(c: Column) -> Column:
    """Lower case, accents off, everything but a-z to single spaces, trimmed. Null gives the empty string."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Mn}", ""), _FROM, _TO)
    return F.trim(F.regexp_replace(bare, "[^a-z]+", " "))


def word_count(c: Column) -> Column:
    """Words after deleting (not replacing) all but letters and white space."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Mn}", ""), _FROM, _TO)
    return F.size(F.filter(F.split(F.regexp_replace(bare, r"(?U)[^a-z\s]", ""), r"(?U)\s+"), lambda w: w != ""))


def tokens(norm: Column, shortest: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.split(norm, " "), lambda w: F.length(w) >= shortest)
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def spanish_date(c: Column) -> Column:
    """The first "d de <month> de yyyy" in the text; null for unknown months and impossible days."""
    # fixed values: month names
    months = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
    pattern = r"(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
    low = F.lower(c)
    names = F.create_map(*[x for i, m in enumerate(months, 1) for x in (F.lit(m), F.lit(str(i)))])
    parts = [F.regexp_extract(low, pattern, i) for i in (1, 2, 3)]
    written = F.concat_ws("-", parts[2], F.try_element_at(names, parts[1]), parts[0])
    return F.to_date(F.try_to_timestamp(written, F.lit("yyyy-M-d")))


def sentences(c: Column) -> Column:
    """The pieces between white space that follows . ! ? , ; or :, without empty ones; the whole text if none is left."""
    parts = F.filter(F.split(c, r"(?<=[.!?,;:])[ \t\n\r\f]+"), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def truncated(c: Column, most: int = 800, mark: str = " [...]") -> Column:
    """At most ``most`` characters, cut after the last sentence end beyond the middle if there is one."""
    head = F.substring(c, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.?!]) ", 1)
    cut = F.when(F.length(sentence) > most // 2, sentence).otherwise(F.regexp_replace(head, r"(?U)\s+$", ""))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit(mark)))
