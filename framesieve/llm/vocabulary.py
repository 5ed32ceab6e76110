"""A byte-level BPE vocabulary, as the tokenizers library stores it.

The driver reads the file and broadcasts its bytes (a few MB, checked), so that
workers need no path of their own; each worker parses it once.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import regex

#: A vocabulary file above this is refused rather than broadcast.
MAX_BYTES = 64 << 20

# Pre-token pattern of byte-level BPE.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_parsed: dict[int, Vocabulary] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(path: str | None) -> bytes:
    blob = Path(path or default_path()).read_bytes()
    if len(blob) > MAX_BYTES:
        raise ValueError(f"vocabulary of {len(blob)} bytes; {MAX_BYTES} are allowed")
    return zlib.compress(blob)


def unpacked(blob: bytes) -> Vocabulary:
    key = hash(blob)
    if key not in _parsed:
        _parsed[key] = Vocabulary(json.loads(zlib.decompress(blob)))
    return _parsed[key]


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 is itself, the rest counts up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space or normaliser")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = dict(added)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in added}
        size = max([*self.ids.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in added.items():
            self.bytes[i] = s.encode()
        #: (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.pattern = regex.compile(PRETOKEN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is one of them, as the library treats it."""
        if self._special and any(s in text for s in self.special):
            out: list[str] = []
            for part in self._special.split(text):
                if part in self.special:
                    out.append(part)
                elif part:
                    out += self.pattern.findall(part)
            return out
        return self.pattern.findall(text)
