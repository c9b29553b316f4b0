"""Byte-level BPE ids of whole texts through a table of segments.

Between two characters that are not white space, a single blank always begins a
new match of the pre-tokenizer. So a text is cut there, each distinct segment is
encoded once, and the ids of a text are joined from the table. Where white
space is of another kind, or the text holds the string of a special token, the
whole text is encoded in one go.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken

KEEP = 200_000
LONGEST = 64


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if it prints, else the next character from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file with its special tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Segments(dict):
    """Little-endian 32-bit ids of ' ' + segment; None where a segment can't stand alone. Bounded."""

    def __init__(self, enc: tiktoken.Encoding):
        super().__init__()
        self.enc, self.special = enc, tuple(enc.special_tokens_set)

    def __missing__(self, part: str) -> bytes | None:
        if not part or part[0].isspace() or part[-1].isspace():
            value = None
        else:
            value = np.array(self.enc.encode_ordinary(" " + part), "<u4").tobytes()
        if len(self) < KEEP and len(part) <= LONGEST:
            self[part] = value
        return value

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.enc.encode(text, allowed_special="all"), "<u4").tobytes()
        head, *rest = text.split(" ")
        if rest and head and not head[-1].isspace():
            try:
                return np.array(self.enc.encode_ordinary(head), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))
            except TypeError:  # a None among them
                pass
        return np.array(self.enc.encode_ordinary(text), "<u4").tobytes()
