"""Token ids of a byte-level BPE tokenizer file, as the tokenizers library
gives them.

Most texts take a quicker road to the same ids: an encoder built from the
file's own vocabulary (its ids follow the merge order) and split pattern.
Texts with code points whose Unicode class may differ between regex engines,
or with very long unbroken runs, go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Split pattern of the byte-level pre-tokenizer (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_EXACT = re.compile("[^\\u0000-\\u024f]|\\S{1000}|\\s{200}")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the file: bytes
    that print stand for themselves, the rest follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenIds:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_alphabet()
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name in special:
            ranks.pop(name.encode(), None)
        self.quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.n_vocab = self.library.get_vocab_size()

    def __call__(self, text: str) -> np.ndarray:
        """The text's ids (unsigned 32-bit), special strings being tokens."""
        if _EXACT.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.quick.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)
