"""Lexicons, regimes and other parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """Keywords that make a paragraph relevant, terms of either direction, and cues that undo a match.

    Keywords and cues match whole words by prefix; a term's first word matches anywhere in a word, its others by prefix.
    Strong cues count in the last ``strong_window`` words before a match, weak ones (whole words) in the last
    ``weak_window``; gated cues are strong ones for negative terms only.
    """

    keywords: tuple[str, ...]
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    gated: tuple[str, ...]
    strong_window: int = 10
    weak_window: int = 3


#: The shipped Spanish fiscal keywords and cues.
FISCAL_KEYWORDS = (
    "deficit", "superavit", "gasto", "presupuest", "fiscal", "impuesto", "deuda", "inflacion", "ajuste", "subsidio", "recaudacion", "austeridad", "obra publica", "inversion publica",
    "inversion social", "emision", "jubil", "pension", "salario", "fmi", "privatiz", "pobreza",
)
STRONG_CUES = ("supuest*", "llamad*", "mal llamad*", "rechaz*", "critic*", "en contra", "opuest*", "en nombre de", "lo que llaman", "so pretexto", "negar*", "combat*", "fals*", "ideolog*")
GATED_CUES = ("elimin*",)
WEAK_CUES = ("no", "nunca", "jamas")

#: The Spanish lexicon without its terms, which come from files (see sources.tables.lexicon).
SPANISH = Lexicon(keywords=FISCAL_KEYWORDS, positive=(), negative=(), strong=STRONG_CUES, weak=WEAK_CUES, gated=GATED_CUES)

#: The lexicon of the synthetic tables (FIXTURES.md).
FIXTURE = Lexicon(
    keywords=("thing", "ring", "nicht", "mente", "elle", "thble"),
    positive=("tion the", "ing of", "ung der", "cion de", "ment de"),
    negative=("ble the", "ble of", "lich die", "ado de", "eux de"),
    strong=("with*", "pour*"),
    weak=("no", "pas", "nicht"),
    gated=("from*",),
)


@dataclass(frozen=True)
class Regimes:
    """Closed date intervals in order (the first that holds a date wins), the groups kept, the months in which a group takes
    over, and the first days of the later groups."""

    intervals: tuple[tuple[str, str, str, int], ...] = (
        ("2003-05-25", "2007-12-10", "Kirchner", 1),
        ("2007-12-10", "2015-12-10", "CFK", 2),
        ("2015-12-10", "2019-12-10", "Macri", 3),
        ("2019-12-10", "2023-12-10", "AF", 4),
        ("2023-12-10", "2099-12-31", "Milei", 5),
    )  # fixed values
    kept: tuple[str, ...] = ("Macri", "AF", "Milei")
    transitions: dict[str, str] = field(default_factory=lambda: {"2019-12": "AF", "2023-12": "Milei"})
