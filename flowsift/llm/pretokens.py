"""Cuts text into the pieces that a word-level BPE file encodes on their own.

White space separates pieces in such a file and is dropped, so a text is encoded chunk by chunk and a
chunk seen before need not be cut or encoded again. Plain chunks (ASCII, Latin-1 letters) are cut here;
all others go through the library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

# single letters that compose with nothing and lower to one letter
_LETTER = "a-zß-öø-ÿ"
_CHUNK = re.compile("[!-~" + "À-ÖØ-öø-ÿ" + "]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
# the same for plain chunks joined by line feeds, which stand by themselves
_LINES = re.compile("[!-~\nÀ-ÖØ-öø-ÿ]*")
_LINE_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9\n]+|\n")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Cutter:
    """Chunks and pieces of one tokenizer file; `path` names the file on every machine."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.description = json.load(file)
        added = self.description["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self._special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self._letters = byte_letters()

    def plain(self, chunk: str) -> bool:
        return _CHUNK.fullmatch(chunk) is not None and "<|" not in chunk

    def pieces(self, chunk: str) -> list[str | int]:
        """Byte-letter strings to encode, and the ids of special strings, in order."""
        if self.plain(chunk):
            return [p if p.isascii() else self._spelt(p) for p in _PIECE.findall(chunk.lower())]
        out: list[str | int] = []
        end = 0
        for match in self._special.finditer(chunk) if self.special else ():
            out += self._library(chunk[end : match.start()])
            out.append(self.special[match[0]])
            end = match.end()
        return out + self._library(chunk[end:])

    def lines(self, joined: str) -> list[str] | None:
        """Lower-cased pieces of chunks joined by line feeds, which stay between them; None if not all are plain."""
        if _LINES.fullmatch(joined) is None or "<|" in joined:
            return None
        return _LINE_PIECE.findall(joined.lower())

    def line_ids(self, piece: str) -> list[int]:
        """The library's ids of one of the `lines`."""
        return [token.id for token in self.tokenizer.model.tokenize(piece if piece.isascii() else self._spelt(piece))]

    def _library(self, text: str) -> list[str]:
        if not text:
            return []
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _spelt(self, piece: str) -> str:
        return "".join(self._letters[b] for b in piece.encode())

    def ids(self, chunk: str) -> list[int]:
        """The library's ids of one chunk."""
        out: list[int] = []
        encode = self.tokenizer.model.tokenize
        for piece in self.pieces(chunk):
            if isinstance(piece, int):
                out.append(piece)
            else:
                out += [token.id for token in encode(piece)]
        return out
