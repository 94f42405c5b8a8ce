"""Exact, fast encoding with the public tokenizer files.

A byte-pair tokenizer with a pre-tokenizer never merges across a run of blanks that follows other
text, nor from a run of letters into the mark behind it, so a text may be cut there and each chunk
encoded alone.  Chunks repeat heavily: every worker keeps a bounded dictionary from chunk to ids and
asks the ``tokenizers`` library only for chunks it has not met.  Chunks that are one run of Latin-1
letters go straight to the library's model, others through its whole chain.  Texts with other white
space than blank and newline, or with the opening of a special token, go to the library whole.  The
ids are those of the library for the whole text in each case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(rf"[ \n]*[{_LETTERS}]+(?=[ \n.,;:!?]|\Z)|[ \n]*[^ \n]+|[ \n]+").findall
_WORD = re.compile(rf"[{_LETTERS}]+(?=[ \n.,;:!?]|\Z)|[^ \n]+").findall
_PLAIN = re.compile(rf" ?[{_LETTERS}]+").fullmatch
#: What sends a text to the library whole: white space but blank and newline, and the opening of a special token.
_ODD_ASCII = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
_ODD_WIDE = tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())
_WIDE = re.compile(r"[^\x00-\xff]").search


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_BLANK = chr(_BYTE_LETTERS[32])


def _odd(text: str) -> bool:
    """Single searches are faster than a class of characters."""
    return any(c in text for c in _ODD_ASCII) or (not text.isascii() and any(c in text for c in _ODD_WIDE))


class _Known(dict):
    """Chunk to ids; looks up what it has not met.

    Beyond ``room`` entries it starts anew, but keeps the entries before as a second dictionary, from which chunks that
    come again are taken over; so frequent chunks stay.
    """

    def __init__(self, look_up: Callable[[str], bytes], room: int):
        super().__init__()
        self.look_up, self.room, self.before = look_up, room, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > self.room:
            self.clear()
        self[chunk] = ids = self.look_up(chunk)
        return ids


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; null and empty texts have none.

    Tokenizers that mark the ends of words drop white space and case, so blanks and (within Latin-1,
    where it means the same to all) case are left out of their chunks.
    """

    def __init__(self, path: str, room: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ends_words = getattr(self.model, "end_of_word_suffix", None) is not None
        self.chunks = _WORD if self.ends_words else _CHUNK
        self.known = _Known(self._chunk, room)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN(chunk):
            return self._whole(chunk)
        if self.ends_words:
            chunk = chunk.lower()
        spelled = chunk.replace(" ", _BLANK) if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text."""
        if not text:
            return b""
        if _odd(text):
            return self._whole(text)
        if self.ends_words and not _WIDE(text):
            text = text.lower()
        return b"".join(map(self.known.__getitem__, self.chunks(text)))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return map(self.encode, texts)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
