"""Regular expressions from lexicon entries."""

from __future__ import annotations

import re


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(r"\s+".join(re.escape(w) + r"\w*" for w in k.split()) for k in keywords) + ")"


def term_pattern(term: str) -> str:
    return r"\s+".join(re.escape(w) + r"\w*" for w in term.split())


def cue_pattern(cues: tuple[str, ...]) -> str:
    """A trailing * is a prefix."""
    one = lambda c: r"\s+".join(re.escape(w.rstrip("*")) + (r"\w*" if w.endswith("*") else "") for w in c.split())
    return r"\b(?:" + "|".join(map(one, cues)) + r")\b" if cues else r"[^\s\S]"
