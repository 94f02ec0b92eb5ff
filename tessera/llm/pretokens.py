"""Splitting text for the merges of a byte-level vocabulary, with what was met before remembered.

A single space between two characters that are no white space always begins a
pre-token, so a text can be cut there and each chunk be encoded by itself.
Chunks repeat, so a worker looks most of them up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: White space of the pattern besides the space (fixed values: Unicode White_Space).
LINE_WS = "\t\n\x0b\x0c\r"
OTHER_WS = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else 256 and up in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_CHARS)


def chunks(text: str) -> list[str]:
    """The text cut before spaces that begin a pre-token; these spaces are left out."""
    plain = not (text[:1] == " " or text[-1:] == " " or "  " in text)
    for w in LINE_WS if plain else "":
        if w in text and (w + " " in text or " " + w in text):
            plain = False
    if plain and not text.isascii():
        plain = not any(w in text for w in OTHER_WS)
    return text.split(" ") if plain else _SAFE.split(text)


class _Seen(dict):
    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:  # a bound on memory; what it held is made again when met
            self.clear()
        out = self[chunk] = self.make(chunk)
        return out


class ChunkEncoder:
    """Ids of whole texts, as packed little-endian 32-bit integers, from an encoder of single pre-tokens."""

    def __init__(self, pattern: str, pretoken: Callable[[str], bytes], most: int = 1_000_000):
        found = regex.compile(pattern).findall

        def encode(chunk: str) -> bytes:
            return b"".join(map(pretoken, found(chunk)))

        self.head = _Seen(encode, most // 20)
        self.body = _Seen(lambda chunk: encode(" " + chunk), most)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        cut = chunks(text)
        return self.head[cut[0]] + b"".join(map(self.body.__getitem__, cut[1:]))
