"""Terms found by an index over words: the first word of a term lies anywhere in a word of the text, each next one begins the next word."""

from __future__ import annotations

import re

from .config import Lexicon
from .patterns import cue_pattern

#: Letters by which first words are indexed, words whose terms are remembered before the memory starts afresh, and letters of the
#: longest word that is remembered: so what is remembered is bounded in bytes too.
LETTERS, REMEMBERED, LONGEST = 3, 1 << 15, 64
NOTHING: list = []


class TermIndex:
    """Finds the terms of a lexicon in normalised texts (words of a-z, single spaces), in time that hardly depends on their number.

    A term ``w1 w2`` matches where a word holds w1 and the next begins with w2. Matches of one term do not overlap: a start inside
    the match before is dropped. Terms are independent of each other. What a word of the text can begin is looked up once per
    word, by the first letters of first words, and remembered unless the word is very long.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.strong, self.gated, self.weak = (re.compile(cue_pattern(c), re.A) for c in (lexicon.strong, lexicon.gated, lexicon.weak))
        self.by_letters: dict[str, dict[str, list[tuple[int, str, str, list[str]]]]] = {}
        for n, (direction, term) in enumerate([*(("pos", t) for t in lexicon.positive), *(("neg", t) for t in lexicon.negative)]):
            first, *rest = term.split()
            self.by_letters.setdefault(first[:LETTERS], {}).setdefault(first, []).append((n, direction, term, rest))
        self.sizes = sorted({len(x) for x in self.by_letters})
        self.known: dict[str, list[tuple[int, tuple[int, str, str, list[str]]]]] = {}

    def begun(self, word: str) -> list[tuple[int, tuple[int, str, str, list[str]]]]:
        """(place in word, term) of the terms whose first word it holds; the leftmost place counts."""
        found: dict[str, int] = {}
        for size in self.sizes:
            for i in range(len(word) - size + 1):
                for first in self.by_letters.get(word[i : i + size], ()):
                    if first not in found and word.startswith(first, i):
                        found[first] = i
        terms = [(i, t) for first, i in found.items() for t in self.by_letters[first[:LETTERS]][first]]
        terms = terms or NOTHING  # one object for the many words that begin nothing
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = terms
        return terms

    def negated(self, words: list[str], i: int, at: int, direction: str) -> bool:
        """Whether a cue stands in the last words before a match at letter ``at`` of word i; letters before it count as a word."""
        far, near = ((words[max(0, i - n + (at > 0)) : i] + [words[i][:at]] * (at > 0)) for n in (self.lexicon.strong_window, self.lexicon.weak_window))
        far = " ".join(far)
        return bool(self.strong.search(far) or (direction == "neg" and self.gated.search(far)) or self.weak.search(" ".join(near)))

    def matches(self, text: str) -> list[tuple[str, str, bool]]:
        """(direction, term, negated) of every match, by place."""
        words, known, out, ends = text.split(" "), self.known, [], {}
        for i, word in enumerate(words):
            terms = known.get(word)
            if terms is None:
                terms = self.begun(word)
            for at, (n, direction, term, rest) in terms:
                if i < ends.get(n, 0) or (rest and (i + len(rest) >= len(words) or not all(words[i + k].startswith(r) for k, r in enumerate(rest, 1)))):
                    continue
                ends[n] = i + 1 + len(rest)
                out.append((direction, term, self.negated(words, i, at, direction)))
        return out
