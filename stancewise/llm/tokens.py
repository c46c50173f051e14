"""Token ids by a public tokenizer, with a bounded word table in each Python worker."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .hashing import WORDS_OF, mixed_pieces, packed_pieces

#: Slots of a way of the word table (a power of two), ways, ids kept before the table starts afresh, words encoded in a call.
SLOTS, WAYS, KEPT, JOINED = 1 << 18, 4, 6_000_000, 200
#: Bytes of text looked at in one pass.
CHUNK = 1 << 19

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """0 white space, 1 ASCII letter, 2 ASCII punctuation but the apostrophe, 3 the rest."""
    kind = np.full(256, 3, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for i in range(33, 127):
        c = chr(i)
        kind[i] = 1 if c.isalpha() else 3 if c.isdigit() or c == "'" else 2
    return kind


class WordEncoder:
    """Encodes texts piece by piece.

    This kind of tokenizer lower-cases, splits at white space, which it drops, and between letters and punctuation. So a
    text's ids are those of its pieces one after another, where a piece ends at ASCII white space or between an ASCII
    letter and an ASCII punctuation mark other than the apostrophe (which begins contractions). Pieces are found for a whole
    batch at once. Those of up to 24 bytes (ASCII letters as lower case) are looked up in a set-associative table by a
    hash and compared with the bytes kept there, so that different pieces never meet; longer ones and those not in the table reach the tokenizer.
    """

    #: What stands between texts: no piece holds it.
    between = b"\n"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cls = _classes()
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((WAYS, SLOTS), np.uint64)  # 0: a free place
        self.words = {k: np.zeros((WAYS, SLOTS), np.uint64) for k in range(1, WORDS_OF)}
        self.bytes = np.zeros((WAYS, SLOTS), np.uint8)
        self.at = np.zeros((WAYS, SLOTS), np.int32)
        self.size = np.zeros((WAYS, SLOTS), np.int32)
        self.store = np.zeros(1 << 20, self.kind)
        self.used = 0
        self.turn = 0

    def _plain(self, words: list[str]) -> dict[str, np.ndarray]:
        return {w: np.array(e.ids, self.kind) for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True)} if words else {}

    def _joinable(self, word: str) -> bool:
        return word.isalpha()

    def _same(self, word: str) -> str:
        """Words of one such form have the same ids."""
        return word.lower() if word.isascii() else word

    def _letters(self, words: list[str]) -> dict[str, np.ndarray]:
        """Words of letters only, many in one call: each ends with the one token that carries a word end."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out, rest = {}, []
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # lower-casing or composing split some word
                rest += group
                continue
            at = [0, *stops.tolist()]
            out.update({w: ids[a:b] for w, a, b in zip(group, at, at[1:], strict=False)})
        return out | self._plain(rest)

    def _bounds(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of buf start and stop."""
        c = self.cls[buf]
        prev = np.empty_like(c)
        prev[0], prev[1:] = 0, c[:-1]
        start = (c != 0) & ((prev == 0) | ((c ^ prev) == 3))
        stop = np.empty(len(c), bool)
        stop[-1] = True
        stop[:-1] = (c[1:] == 0) | start[1:]
        return np.flatnonzero(start), np.flatnonzero(stop & (c != 0)) + 1

    def _whole(self, text: str) -> bool:
        """Whether the tokenizer must see text whole: it spells an added token."""
        return any(a in text for a in self.added)

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words into the store; their places and sizes there."""
        joined = {w for w in words if self._joinable(w)}
        known = self._letters(list(joined)) | self._plain(list(set(words) - joined))
        arrays = [known[w] for w in words]
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        flat = np.concatenate(arrays) if arrays else np.zeros(0, self.kind)
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store), self.kind)])
        self.store[self.used : self.used + len(flat)] = flat
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        return places, sizes

    def _chunk(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces in buf, and the place and size in the store of the ids of each."""
        if self.used > KEPT:
            self._clear()
        starts, stops = self._bounds(buf)
        if not len(starts):
            return starts, starts, starts
        long = stops - starts
        packed = packed_pieces(self.low[buf], starts, stops)
        key = mixed_pieces(packed, long)
        key[key == 0] = 1
        slot = (key >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        place, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        table = long <= 8 * WORDS_OF
        key[~table] = 0
        rest, other = np.arange(len(key)), []
        for way in range(WAYS):
            s = slot[rest]
            hit = self.keys[way][s] == key[rest]
            h, sh = rest[hit], s[hit]
            same = self.bytes[way][sh] == long[h]  # each step of the hash is a bijection: with equal later words the first are equal
            for k in range(1, WORDS_OF):
                more = np.flatnonzero(long[h] > 8 * k)
                same[more] &= self.words[k][way][sh[more]] == packed[k][h[more]]
            if not same.all():  # another piece of this hash, or one too long for the table
                other.append(h[~same])
                h, sh = h[same], sh[same]
            place[h], size[h] = self.at[way][sh], self.size[way][sh]
            rest = rest[~hit]
            if not len(rest):
                break
        rest = np.concatenate([rest, *other])
        if len(rest):
            words = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), stops[rest].tolist(), strict=True)]
            first: dict[str, int] = {}
            back = np.array([first.setdefault(self._same(w), i) for i, w in enumerate(words)])
            one = np.unique(back)
            p, n = self._add([words[i] for i in one.tolist()])
            which = np.searchsorted(one, back)
            place[rest], size[rest] = p[which], n[which]
            keep = table[rest[one]]
            of, p, n = rest[one][keep], p[keep], n[keep]
            for i in range(WAYS):  # each into the first free way, else in turn
                where = slot[of]
                _, lead = np.unique(where, return_index=True)
                free = np.zeros(len(of), bool)
                free[lead] = self.keys[i][where[lead]] == 0
                self._put(i, of[free], where[free], key, packed, long, p[free], n[free])
                of, p, n = of[~free], p[~free], n[~free]
            self.turn = (self.turn + 1) % WAYS
            where, lead = np.unique(slot[of], return_index=True)
            self._put(self.turn, of[lead], where, key, packed, long, p[lead], n[lead])
        return starts, place, size

    def _put(self, way: int, of: np.ndarray, where: np.ndarray, key: np.ndarray, packed: list[np.ndarray], long: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        self.keys[way][where], self.bytes[way][where], self.at[way][where], self.size[way][where] = key[of], long[of], place, size
        for k, held in self.words.items():
            held[way][where] = packed[k][of]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Some texts (``_whole``) go to the tokenizer whole."""
        special = [i for i, t in enumerate(texts) if self._whole(t)]
        if special:
            own = self._plain([texts[i] for i in special])
            rest = self.encode(["" if self._whole(t) else t for t in texts])
            for i in special:
                rest[i] = own[texts[i]]
            return rest
        out: list[np.ndarray] = []
        raw = [t.encode("utf-8", "replace") for t in texts]
        lo = 0
        while lo < len(raw):
            hi, n = lo, 0
            while hi < len(raw) and (hi == lo or n + len(raw[hi]) + 1 <= CHUNK):
                n += len(raw[hi]) + 1
                hi += 1
            joined = self.between.join(raw[lo:hi]) + self.between
            starts, place, size = self._chunk(np.frombuffer(joined, np.uint8))
            ends = np.cumsum(size)
            ids = self.store[np.repeat(place - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            doc_ends = np.cumsum([len(r) + 1 for r in raw[lo:hi]])
            cuts = np.append(0, ends)[np.searchsorted(starts, doc_ends)]
            out += [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            lo = hi
        return out


#: White space above ASCII, and the line end U+0085: a byte cannot tell it from letters.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ByteEncoder(WordEncoder):
    """Encodes texts piece by piece with a byte-level tokenizer, which drops nothing and keeps case.

    It takes one space before a word as part of it; of a longer run of white space the last character stands alone or, being a
    space, joins the word, and the rest is one token string; a run at the end of a text is one. Between an ASCII letter and an
    ASCII punctuation mark other than the apostrophe it always splits. Texts with other white space than ASCII's go to it whole.
    """

    between = b"\xff"

    def __init__(self, path: str):
        super().__init__(path)
        self.low = np.arange(256, dtype=np.uint8)
        self.cls[[9, 10, 11, 12, 13]], self.cls[32], self.cls[255] = 4, 5, 0
        self.opens = np.zeros(len(self.ends), bool)
        self.opens[[i for s, i in self.tok.get_vocab().items() if s.startswith("\u0120")]] = True

    def _bounds(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.cls[buf]
        prev, after = np.append(np.uint8(0), c[:-1]), np.append(c[1:], np.uint8(0))
        space, was_space = c >= 4, prev >= 4
        word_next = (after > 0) & (after < 4)
        start = (prev == 0) | (~space & ((prev == 4) | ((c ^ prev) == 3) & ~was_space)) | (space & (~was_space | word_next))
        start &= c != 0
        stop = np.append((c[1:] == 0) | start[1:], True)
        return np.flatnonzero(start), np.flatnonzero(stop & (c != 0)) + 1

    def _whole(self, text: str) -> bool:
        return super()._whole(text) or (not text.isascii() and _WIDE_SPACE.search(text) is not None)

    def _joinable(self, word: str) -> bool:
        return word[0] == " " and word[1:].isalpha()

    def _same(self, word: str) -> str:
        return word

    def _letters(self, words: list[str]) -> dict[str, np.ndarray]:
        """Words after a space, many in one call: each begins with the one token that begins with a space."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out = {}
        for group, e in zip(groups, self.tok.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.opens[ids]).tolist()
            if len(at) != len(group):
                out |= self._plain(group)
            else:
                out.update({w: ids[a:b] for w, a, b in zip(group, at, [*at[1:], len(ids)], strict=True)})
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the tokenizer file at path."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            kind = (json.load(file).get("pre_tokenizer") or {}).get("type")
        _encoders[path] = (ByteEncoder if kind == "ByteLevel" else WordEncoder)(path)
    return _encoders[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    return encoder(path).encode(texts)
