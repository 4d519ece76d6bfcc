"""Exact encoding of whole texts through a cache of pre-tokens.

A tokenizer's result for a text is the concatenation of its results for the
text's pre-tokens. Texts are split here: at special strings first, then by the
pattern over Unicode classes. The classes come from this Python's Unicode data
and are held against the library, code point by code point, when a worker meets
its first text beyond Latin-1; a text with a code point that the two class
differently goes to the library whole. Pre-tokens that a worker has not met yet
are encoded by the library in bulk.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

# Members of the Unicode classes L, N and White_Space below U+0100, and the ASCII controls that Python alone calls space.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
NO_SPACE = "\x1c\x1d\x1e\x1f"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

#: What one worker keeps beside any shared table.
CACHE_ENTRIES = 500_000


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def class_members() -> dict[str, list[str]]:
    """All code points but surrogates by class: L, N, S (white space) or O (any other)."""
    found: dict[str, list[str]] = {"L": [], "N": [], "S": [], "O": []}
    for point in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(point)
        kind = unicodedata.category(c)[0]
        found["S" if c.isspace() and c not in NO_SPACE else kind if kind in "LN" else "O"].append(c)
    return found


def disputed(offsets: Callable[[str], list[tuple[int, int]]], members: dict[str, list[str]], runs_of_numbers: bool) -> str:
    """Code points that the library's pre-tokenizer does not treat as their class.

    Each stands between two characters of a class; a pre-token over all three shows that it belongs to it.
    """

    def joins(chars: list[str], side: str) -> set[str]:
        if side != "!":
            spans = set(offsets("\n".join(side + c + side for c in chars)))
            return {c for k, c in enumerate(chars) if (4 * k, 4 * k + 3) in spans}
        out: set[str] = set()
        for at in range(0, len(chars), 1 << 16):  # long runs first: nearly all are of this class
            part = chars[at : at + (1 << 16)]
            if offsets("!" + "".join(part) + "!") == [(0, len(part) + 2)]:
                out.update(part)
            else:
                spans = set(offsets("\n".join("!" + c + "!" for c in part)))
                out.update(c for k, c in enumerate(part) if (4 * k, 4 * k + 3) in spans)
        return out

    wrong = set(members["L"]) - joins(members["L"], "a")
    wrong |= set(members["O"]) - joins(members["O"], "!") - {"\n"}
    rest = members["N"] + members["S"]
    wrong |= joins(rest, "a") | joins(rest, "!")
    if runs_of_numbers:
        numbers = joins(rest, "1")
    else:  # a numeral alone is a pre-token; white space is none
        spans = set(offsets("\n".join("1" + c + "1" for c in rest)))
        numbers = {c for k, c in enumerate(rest) if (4 * k + 1, 4 * k + 2) in spans}
    return "".join(sorted(wrong | (set(members["N"]) ^ numbers)))


def as_ranges(chars: list[str]) -> str:
    """Members of a regular expression's class."""
    points = np.array([ord(c) for c in chars])
    breaks = np.flatnonzero(np.diff(points) != 1)
    lows, highs = points[np.append(0, breaks + 1)], points[np.append(breaks, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(lows.tolist(), highs.tolist()))


def word_pattern(letter: str, number: str, space: str) -> str:
    """Words, single numerals and symbol runs; white space is dropped."""
    return f"{ENDINGS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"


def byte_pattern(letter: str, number: str, space: str) -> str:
    """Runs of letters, numerals or symbols with one space before; trailing white space apart."""
    return f"{ENDINGS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class Splitter:
    """Pre-tokens of a text, or None where only the library may split it."""

    def __init__(self, library, words: bool):
        self.library, self.words = library, words
        self.pattern = word_pattern if words else byte_pattern
        self.find = re.compile(self.pattern(LETTER, NUMBER, SPACE)).findall
        added = library.get_added_tokens_decoder().values()
        self.specials = {t.content for t in added}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("special strings that take more than themselves are not supported")
        self.at_specials = re.compile(f"({'|'.join(map(re.escape, sorted(self.specials, key=lambda t: (-len(t), t))))})").split
        self.find_wide = self.doubtful = None

    def _wide(self, text: str) -> list[str] | None:
        if self.find_wide is None:
            members = class_members()
            pre = self.library.pre_tokenizer
            odd = disputed(lambda t: [o for _, o in pre.pre_tokenize_str(t)], members, not self.words)
            self.find_wide = re.compile(self.pattern(*(as_ranges(members[k]) for k in "LNS"))).findall
            self.doubtful = re.compile(f"[{as_ranges(sorted(odd))}\ud800-\udfff]" if odd else "[\ud800-\udfff]").search
        if self.doubtful(text):
            return None
        return self.find_wide(self.library.normalizer.normalize_str(text) if self.words else text)

    def _plain(self, text: str) -> list[str] | None:
        if not in_latin1(text):
            return self._wide(text)
        return self.find(text.lower() if self.words else text)

    def __call__(self, text: str) -> list[str] | None:
        if not any(s in text for s in self.specials):
            return self._plain(text)
        out: list[str] = []
        for part in self.at_specials(text):
            found = [part] if part in self.specials else self._plain(part)
            if found is None:
                return None
            out += found
        return out


class Encoder:
    """Ids of whole texts by a tokenizers file, as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None
        self.split = Splitter(self.library, self.lower)
        self.dtype = np.dtype(dtype)
        self.cache: dict[str, bytes] = {}
        # Ids that end a word, or that begin with a space, tell where one pre-token of a joined text stops.
        vocab = self.library.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.lower else t.startswith("\u0120"))]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words joined so that the library splits them again, and each word's end; None if it doesn't."""
        ids = np.array(self.library.encode((" " if self.lower else "").join(words), add_special_tokens=False).ids, np.int64)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return None
        return ids, at + 1 if self.lower else np.append(at[1:], len(ids))

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int64), np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)))

    def encoded(self, words: list[str], at_once: int = 1000) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Pre-tokens in groups, with the ids of each group and where each word's ids end."""
        alone = {w for w in words if w in self.split.specials}
        plain = [w for w in words if w not in alone] if self.lower else [w for w in words if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        odd = list(alone) if self.lower else list(set(words).difference(plain))
        for i in range(0, len(plain), at_once):
            part = plain[i : i + at_once]
            yield part, *(self._joined(part) or self._apart(part))
        for i in range(0, len(odd), at_once):
            part = odd[i : i + at_once]
            yield part, *self._apart(part)

    def learn(self, words: list[str]) -> None:
        size = self.dtype.itemsize
        for part, ids, ends in self.encoded(words):
            blob, a = ids.astype(self.dtype).tobytes(), 0
            for word, b in zip(part, (ends * size).tolist()):
                self.cache[word] = blob[a:b]
                a = b

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        split = [self.split(t or "") for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        get = self.cache.get
        parts = [None if w is None else list(map(get, w)) for w in split]
        gaps = [(w, p, at) for w, p in zip(split, parts) if p is not None for at in gaps_in(p)]
        if gaps:
            self.learn(list({w[at]: None for w, _, at in gaps}))
            for w, p, at in gaps:
                p[at] = self.cache[w[at]]
        return [self.whole(t).tobytes() if p is None else b"".join(p) for t, p in zip(texts, parts)]


def gaps_in(found: list) -> list[int]:
    """Places of None."""
    at, out = -1, []
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder a worker process for each file."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]
