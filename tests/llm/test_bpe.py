"""BPE encoding and decoding against the tokenizers library."""

from __future__ import annotations

import random

import pytest
import tokenizers

from recensio.llm import bpe
from recensio.llm.tokens import default_path


@pytest.fixture(scope="module")
def both():
    path = default_path("word_bpe_49k.json")
    return bpe.tokenizer(path), tokenizers.Tokenizer.from_file(path)


def same(both, text):
    ours, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert got.tolist() == ids, repr(text)[:300]
    assert ours.decode(got).decode() == library.decode(ids, skip_special_tokens=False), repr(text)[:300]


def test_documents(both, sf_texts):
    for t in list(sf_texts.values())[:60]:
        same(both, t)


def test_odd_texts(both):
    rng = random.Random(4)
    letters = "aabbeeinthe'stdmrlv ABÉéßÆΣσς日本ñ\n\t   ١Ⅷ½İı̇é\x1c\x1f\x85\x0b🎉👩‍👧0123!?.,-_#<|> ﻿\u0000"
    for _ in range(3000):
        same(both, "".join(rng.choices(letters, k=rng.randint(0, 40))))
    for t in ["", " ", "<|endoftext|>", "a<|startoftext|>B <|EndOfText|> <|endoftext|>", "ΟΔΥΣΣΕΥΣ", "it's we'LL I'd", "x" * 3000, "ab" * 2000, "Å ϓ ﬁ"]:
        same(both, t)


def test_every_code_point(both):
    """Alone, between letters and beside its like; 1,000 to a text.  Of the
    planes that hold no letter (private, not assigned) every 97th."""
    ours, library = both
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c % 97 == 0)]
    for at in range(0, len(every), 1000):
        text = " ".join(f"A{chr(c)}e x{chr(c)}{chr(c)} {chr(c)}1" for c in every[at:at + 1000])
        want, got = library.encode(text, add_special_tokens=False).ids, ours.encode(text)
        if got.tolist() != want:
            for c in every[at:at + 1000]:
                same(both, f"A{chr(c)}e x{chr(c)}{chr(c)} {chr(c)}1")
        assert got.tolist() == want, hex(every[at])


def test_merge_heavy_words(both):
    rng = random.Random(8)
    for _ in range(2000):
        same(both, "".join(rng.choices("aeinst", k=rng.randint(1, 30))))


def test_table_start_over(both, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 5)
    for t in ["one two three four five six seven eight", "nine ten one two"]:
        same(both, t)


def test_frames(spark, make_docs, both):
    rows = [(1, None), (2, ""), (None, "Hello World"), (3, "same"), (3, "same"), (4, "word " * 50_000)]
    out = bpe.decode(bpe.encode(make_docs(rows).withColumnRenamed("source", "ids"))).collect()
    assert [r.doc_id for r in out] == [1, 2, None, 3, 3, 4]
    assert [r.ids for r in out[:2]] == [[], []] and out[0].decoded == "" and out[2].decoded == "hello</w> world</w>"
    assert len(out[5].ids) == 50_000 and out[3] == out[4]
    assert bpe.encode(make_docs([])).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [5, None, -3, 10**6])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).collect()] == ["", both[1].id_to_token(5)]
