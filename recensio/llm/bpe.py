"""BPE encoding by backtracking over longest token matches, and decoding by an
offset table.

Encoder.  An Aho-Corasick machine over all tokens finds the longest ones of a
word's byte letters from left to right in one pass.  Mostly that is the answer
already; otherwise the machine is asked for the longest token at a position
when it is needed.  From the left, the longest token is taken if it is *compatible* with the one before it, else
the next shorter token that is its prefix, else the token before is given up
and shortened in turn.  Two tokens are compatible if BPE, merging by rank,
would leave exactly this border between them; this is decided by undoing
merges on both sides of the border and looking for a merge across it that
would have come first.  The answers are kept in a table.  A sequence of tokens
compatible at every border is what BPE gives, and it is unique, so the result
equals merging by rank; a position given up is never tried again, so the time
is linear in the word's length.

Texts with code points that Python's Unicode tables know no character for go
through the tokenizers library: their classes differ between Unicode versions.

Words (runs between white space) are kept in a bounded table of two
generations, so the frequent ones stay; a text is then a join of table entries.

Decoder.  All token strings lie in one byte array with an offset table; the
bytes of a whole id sequence are gathered from it at once.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import keyed_text, prepare, small_batches, table
from .tokens import byte_alphabet, default_path

#: Stands for a word's end while matching; no byte letter.
END = "\0"
#: Words kept per worker and generation, and pairs in the compatibility table;
#: a full generation becomes the old one, a full table starts anew.
WORDS, PAIRS = 200_000, 500_000
#: Code points that the tokenizer's \s matches (fixed values).
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Encodes words with a merge table: ids 0.. are the letters and then the
    merges in their order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.merge:
                self.merge[pair] = r
            if new not in self.parts:
                self.parts[new] = pair
                self.rank[new] = r
        text = {i: t[: -len(suffix)] + END if t.endswith(suffix) else t for t, i in vocab.items()}
        self.length = {i: len(t) for i, t in text.items()}
        self.machine = ahocorasick.Automaton()
        usable = {i for i in text if i in self.parts or self.length[i] == 1 or (self.length[i] == 2 and text[i][-1] == END)}
        for i in usable:
            self.machine.add_word(text[i], i)
        self.machine.make_automaton()
        self.by_text = {text[i]: i for i in usable}
        self.text = text
        self.widest = max(self.length.values(), default=0)
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self._shorter.get(token)
        if found is None:
            t, found = self.text[token], -1
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.by_text:
                    found = self.by_text[t[:n]]
                    break
            self._shorter[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two neighbouring tokens."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._border(left, right)
        return known

    def longest(self, s: str, at: int) -> int:
        """The longest token of ``s`` at a position, or -1."""
        tail = s[at: at + self.widest]
        n, by_text = self.machine.longest_prefix(tail), self.by_text
        while n:
            found = by_text.get(tail[:n])
            if found is not None:
                return found
            n -= 1
        return -1

    def _border(self, left: int, right: int) -> bool:
        # Undo, step by step, the later of the two merges that touch the
        # border.  Before it was done, both neighbours stood side by side; a
        # merge across them of a lower rank than the undone ones would have
        # come first.  At equal rank the left one comes first.
        rank, merge, parts = self.rank, self.merge, self.parts
        before = (1 << 60, 0)  # (rank, side) of the merge undone last
        while True:
            across = merge.get((left, right))
            if across is not None and (across, 0.5) < before:
                return False
            a = (rank[left], 0) if left in parts else None
            b = (rank[right], 1) if right in parts else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and a > b):
                before, left = a, parts[left][1]
            else:
                before, right = b, parts[right][0]

    def __call__(self, word: str) -> list[int]:
        """Ids of one word of byte letters (without the end mark)."""
        s = word + END
        n = len(s)
        length, fits = self.length, self.fits
        # One pass: the longest tokens from the left, kept as far as they fit
        # each other.  If they cover the word, they are what BPE gives.
        out = [token for _, token in self.machine.iter_long(s)]
        good = 1
        while good < len(out) and fits(out[good - 1], out[good]):
            good += 1
        del out[good:]
        at = sum(map(length.__getitem__, out))
        if at == n:
            return out
        longest = self.longest
        open_ = [True] * (n + 1)
        open_[n - 1] = False  # the end mark belongs to the last letter
        if out and at == n - 1:
            last = out.pop()
            at -= length[last]
            token = self.shorter(last)
        else:
            token = longest(s, at)
        while at < n:
            while token >= 0:
                stop = at + length[token]
                if open_[stop] and (not out or fits(out[-1], token)):
                    out.append(token)
                    at = stop
                    token = longest(s, at) if at < n else -1
                    break
                token = self.shorter(token)
            else:
                open_[at] = False
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                last = out.pop()
                at -= length[last]
                token = self.shorter(last)
        return out


@lru_cache(maxsize=1)
def unassigned() -> frozenset[str]:
    """The code points without an assigned character (none below U+0250)."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")


class Tokenizer:
    """A BPE tokenizer file whose words end with a suffix: normalisation,
    word split, encoding and decoding."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("not a tokenizer file of the kind this encoder reads")
        self.vocab = dict(model["vocab"])
        self.encoder = Encoder(self.vocab, [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(split.replace(r"\s", SPACE), regex.V0)
        self._odd = re.compile("[\x1c-\x1f]")
        self._beyond = re.compile("[^\x00-\u024f]")
        self._space = re.compile(f"[{SPACE}]+")
        self._letter = {b: c for c, b in byte_alphabet().items()}
        strings = self.vocab | self.special
        self.n_vocab = max(strings.values()) + 1
        by_id = [b""] * self.n_vocab
        for t, i in strings.items():
            by_id[i] = t.encode()
        self._bytes, self._offsets = _offset_table(by_id)
        outer = self

        class Words(dict):
            old: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                out = self.old.get(word)
                if out is None:
                    out = array("i", outer._word(word)).tobytes()
                if len(word) <= 64:
                    if len(self) >= WORDS:
                        self.old = dict(self)
                        self.clear()
                    self[word] = out
                return out

        self._words = Words()

    def _word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():  # one piece, each letter standing for itself
            return self.encoder(word)
        letter = self._letter
        return [i for piece in self._pieces.findall(word) for i in self.encoder("".join(letter[b] for b in piece.encode()))]

    def encode(self, text: str) -> np.ndarray:
        if not text.isascii() and self._beyond.search(text) and not unassigned().isdisjoint(text):
            # Which of these are letters, and of which case, depends on the
            # Unicode version of each library: only the tokenizer's own knows.
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.int32)
        out = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(np.array([self.special[part]], "<i4").tobytes())
                continue
            if not part.isascii():
                # lower case letter by letter: no final sigma
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
            part = part.lower()
            words = part.split() if not self._odd.search(part) else [w for w in self._space.split(part) if w]
            out.extend(map(self._words.__getitem__, words))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by spaces, special ones included; ids outside
        the vocabulary are left out."""
        ids = np.asarray(ids, np.int64)
        return _gather(self._bytes, self._offsets, ids[(ids >= 0) & (ids < self.n_vocab)])


def _offset_table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all strings, each with a space behind it, and where
    each begins."""
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) + 1 for s in strings], out=offsets[1:])
    return np.frombuffer(b" ".join(strings) + b" ", np.uint8), offsets


def _gather(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    first = offsets[ids]
    size = offsets[ids + 1] - first
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - size), size)
    return data[at].tobytes()[:-1]


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library on the same file, for texts with code points
    that this Python knows no character for."""
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``, map-only.  Null
    and empty texts have no ids; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns are not read."""
    prepare(docs.sparkSession)
    path = path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in small_batches(batches, 256):
            ids = [tok.encode(t) for t in b.column(1).to_pylist()]
            stops = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=stops[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with a text column of its ids decoded.  A null id sequence
    decodes to the empty text; null ids and ids outside the vocabulary are
    left out; an empty table gives an empty result."""
    prepare(encoded.sparkSession)
    path = path or default_path("word_bpe_49k.json")
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in small_batches(batches, 256):
            col = b.column(at)
            values, offs = col.values.fill_null(-1).to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            valid = np.asarray(col.is_valid())
            texts = [tok.decode(values[i:j]) if ok else b"" for i, j, ok in zip(offs[:-1], offs[1:], valid)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.fieldNames())

    return encoded.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document; edge cases as in ``encode``."""
    out = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
