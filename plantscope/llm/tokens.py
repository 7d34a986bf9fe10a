"""Byte-level BPE in worker processes: ids of a public tokenizer file, loaded once a process.

The vocabulary comes from the ``tokenizers`` file; the merges are run by ``tiktoken``, which gives the
same ids several times faster (ids are merge ranks in a byte-level file; tests compare the two). Strings
of special tokens in a text become that token, as the file's own library does by default.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np

# fixed value: how byte-level tokenizers cut a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        return self._encoding.encode_to_numpy(text, allowed_special="all")

    def decode_bytes(self, ids) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])


@cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
