"""Token ids of whole texts with the public tokenizers, quick for texts whose words recur.

A pre-token never spans the place between a word and the white space after it, so a text's ids are the ids of its
units (white space and the word after it) in sequence. Units are encoded by the tokenizers library itself and kept in a
bounded table of each Python worker. A text with white space other than blank, tab, line feed and carriage return
is encoded in one piece, since there the libraries' ideas of white space could differ; so is a text that spells an added
token of the vocabulary, which the library gives its own id wherever it stands.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array
from functools import cache

import numpy as np

assert array("I").itemsize == 4 and sys.byteorder == "little"

_UNIT = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_SPACES = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029]
_SPACES += [0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_OTHER_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]")
#: Those of them that a text of Latin-1 characters can have.
_ODD_ASCII, _ODD_LATIN = (tuple(chr(x) for x in _SPACES if x < most) for most in (0x80, 0x100))
#: Runs of white space: without one, each blank and each line feed stands alone between two words.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: Units that a worker keeps (some 200 bytes each), and the longest that it keeps.
KEPT_UNITS, KEPT_CHARS = 1_000_000, 64


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


# A word of Latin letters and the marks after it: pre-tokenizers of both kinds cut it between the two.
_LATIN = re.compile(f"[A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}]+")
_MARKS = ".,;:!?#$%&*"
_PROBES = ("word", " Word", " caf" + chr(0xE9) + ",", " THE!!", "end.", " " + chr(0xC9) + "t" + chr(0xE9), "A" + chr(0xDF))
_PROBES += (" it,###", "\nOn$$$", " of.%%%", " At&&&", "so***", " a?#*!$:%&;.,", "\nz" + chr(0xFC) + ",***")


def _cut(unit: str) -> tuple[str, str, str] | None:
    """(blank or line feed, word of Latin letters, marks) if a unit is made of these alone."""
    lead = unit[0] if unit[0] in " \n" else ""
    rest = unit[1:] if lead else unit
    word = rest.rstrip(_MARKS)
    if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)):
        return lead, word, rest[len(word) :]
    return None


def _byte_letters() -> str:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    own = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(own[b] for b in range(256))


def _odd_space(text: str) -> bool:
    """Whether a text has white space other than blank, tab, line feed and carriage return."""
    if text.isascii():
        return any(c in text for c in _ODD_ASCII)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _OTHER_SPACE.search(text) is not None
    return any(c in text for c in _ODD_LATIN)


class _Units(dict):
    """Ids of units, learned where they are first met: each word of a text is looked up once."""

    def __init__(self, owner: Encoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, key: str) -> bytes:
        found = self.owner.learn(key if key[0] == "\n" else self.lead + key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.owner.kept:
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        # Normalised ones are found in other spellings too: then nothing short of the library will do.
        self.whole = any(token.normalized for token in added)
        self.kept = kept
        # Units as they are; words that stand for the unit of a blank and the word.
        self.units, self.words = _Units(self, ""), _Units(self, " ")
        self.parts: dict[str, bytes] = {}
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        # Whether the blank before a word belongs to it; without agreement on the probes there is no shortcut.
        self.joins_blank: bool | None = None
        for way in (True, False):
            self.joins_blank = way
            if [self._simple(*_cut(p)) for p in _PROBES] == self.direct(list(_PROBES)):
                break
        else:
            self.joins_blank = None

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token by the library's model."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.kept // 2:
                self.parts.clear()
            plain = part.isascii() and part.isalpha()  # letters that stand for themselves
            spelt = part if plain else codecs.charmap_decode(part.encode(), "strict", self.letters)[0]
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return found

    def _simple(self, lead: str, word: str, marks: str) -> bytes:
        if not self.joins_blank:
            ids = self._part(word.lower())
        elif lead == "\n":
            ids = self._part(lead) + self._part(word)
        else:
            ids = self._part(lead + word)
        return ids + self._part(marks) if marks else ids

    def learn(self, unit: str) -> bytes:
        """Ids of a unit: simple ones by the model, the others by the whole library."""
        found = _cut(unit) if self.joins_blank is not None else None
        return self._simple(*found) if found else self.direct([unit])[0]

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from the library, without the table."""
        out = []
        for at in range(0, len(texts), 2048):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)
            out += [np.asarray(e.ids, "<u4").tobytes() for e in found]
        return out

    def encode(self, text: str | None) -> bytes:
        """All ids of the whole text; null is the empty text."""
        if not text:
            return b""
        if self.whole or _odd_space(text) or any(token in text for token in self.added):
            return self.direct([text])[0]
        if any(run in text for run in _RUNS) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.units[first] + b"".join(map(self.words.__getitem__, rest))


@cache
def encoder(path: str, kept: int = KEPT_UNITS) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path, kept)


def vocabulary_size(name: str) -> int:
    """One more than the largest id of a vocabulary."""
    return max(encoder(vocabulary(name)).tokenizer.get_vocab(with_added_tokens=True).values()) + 1
