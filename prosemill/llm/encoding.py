"""Token ids and token counts of whole texts, each distinct part of a text given to the library once.

Both classes live in a Python worker and keep a bounded memo of parts that they have seen, in two
generations: a full one becomes the old one, and what is met again moves back to the young one.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache

#: Parts in each of the two generations of a memo.
MEMO_PARTS = 200_000
#: Longer parts aren't kept.
LONG_PART = 64


class Memo(dict):
    """``memo[part]`` is ``make(part)``; ``turn()`` must be called now and then."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, part):
        value = self.old.get(part)
        if value is None:
            value = self.make(part)
            if len(part) > LONG_PART:
                return value
        self[part] = value
        return value

    def turn(self) -> None:
        if len(self) > MEMO_PARTS:
            self.old = dict(self)
            self.clear()


#: Letters whose lower case and normal form are themselves one letter of the same kind.
_PLAIN = r"A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII without white space, controls and the apostrophe, and those letters.
_SIMPLE = re.compile(rf"[!-&(-~{_PLAIN}]+")
_SIMPLE_PARTS = re.compile(rf"[{_PLAIN}]+|[0-9]|[^{_PLAIN}0-9]+")
#: Strings that show whether the short way below gives what the library gives.
_PROBES = ("Plain words, 12 of them; x_y (Élan) ###,!! a-b", "ÀÖØöøÿ ß... [no] <b> #1", "A1b22 C/d+e=f@g \\ ^`~{|}")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class IdEncoder:
    """Ids by a file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    A vocabulary that drops white space and never joins what it parts can be encoded chunk by chunk
    between spaces. Chunks of plain letters, digits and punctuation go to the library's merge model
    directly, after the lower-casing and splitting that its file prescribes; all others go through
    the whole library. A file that isn't of this kind is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.by_chunk = all(
            self._library(p) == b"".join(map(self._library, p.split(" "))) and not self._library("  ") for p in _PROBES
        )
        self.parts = Memo(self._part)
        self.short = self.by_chunk and all(self._library(c) == self._short(c) for p in _PROBES for c in p.split(" "))
        self.chunks = Memo(self._chunk)

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.whole.model.tokenize(part)]).tobytes()

    def _short(self, chunk: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _SIMPLE_PARTS.findall(chunk.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if self.short and "<|" not in chunk and _SIMPLE.fullmatch(chunk):
            return self._short(chunk)
        return self._library(chunk) if chunk else b""

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._library(text)
        ids = b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        self.chunks.turn()
        self.parts.turn()
        return ids


class PieceCounter:
    """Number of pieces by a sentencepiece model: distinct pre-tokens are counted once.

    Where no piece of the model holds a letter beside another sign, nor anything but a space before
    a space, pieces never reach over such borders, so the pieces of a text are those of its
    pre-tokens. A model that isn't of this kind is given whole texts.
    """

    #: Signs between which a border may lie; superscript digits go with other signs.
    LETTER, OTHER = r"[^\W\d_¹²³]", r"(?:[^\w \n▁]|[\d_¹²³])"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [
            self.model.id_to_piece(i).lstrip("▁")
            for i in range(self.model.get_piece_size())
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))
        ]
        crossing = re.compile(rf"▁|\n|{self.LETTER}{self.OTHER}|{self.OTHER}{self.LETTER}")
        self.split = not any(crossing.search(p) for p in pieces) and self._prefixed()
        # Spaces and what follows them, up to a border between letters and other signs.
        self.pattern = re.compile(rf"[ ▁]*{self.LETTER}+|[ ▁]*{self.OTHER}+|\n|[ ▁]+")
        self.before = len(self.model.encode("\n"))
        self.counts = Memo(lambda p: len(self.model.encode("\n" + p)) - self.before)

    def _prefixed(self) -> bool:
        """Does the model put one space before a text, and change nothing in it?"""
        same = lambda a, b: self.model.encode(a, out_type=str) == b
        probe = "\n  a  \n"
        return same("\n", ["▁", "<0x0A>"]) and "".join(self.model.encode("x" + probe, out_type=str)) == "▁x<0x0A>▁▁a▁▁<0x0A>"

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.model.encode(text))
        frequencies = Counter(self.pattern.findall(" " + text))
        total = sum(n * self.counts[part] for part, n in frequencies.items())
        self.counts.turn()
        return total


class IdCounter:
    """Number of ids by a file of the tokenizers library."""

    def __init__(self, path: str):
        self.encoder = IdEncoder(path)

    def count(self, text: str) -> int:
        if not self.encoder.by_chunk:
            return len(self.encoder.encode(text)) // 4
        chunks = self.encoder.chunks
        total = sum(n * len(chunks[part]) for part, n in Counter(text.replace("\n", " ").split(" ")).items()) // 4
        chunks.turn()
        self.encoder.parts.turn()
        return total


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


@lru_cache(maxsize=2)
def token_counter(path: str) -> PieceCounter | IdCounter:
    return PieceCounter(path) if path.endswith(".model") else IdCounter(path)
