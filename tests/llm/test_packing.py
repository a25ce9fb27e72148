"""Packing: whole, gapless, and close to the fewest sequences."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recensio.llm import packing
from recensio.llm.tokens import default_path, token_ids


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check_layout(rows, capacity):
    """rows: (sequence, offset, size); returns the number of sequences."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "one", "third hot"])
def test_pack(spark, kind):
    rng = random.Random(3)
    sizes = {"mixed": [rng.randint(1, 100) for _ in range(600)], "equal": [40] * 300, "tiny": [rng.randint(1, 3) for _ in range(3000)], "one": [7],
             "third hot": [rng.choice([34, 34, rng.randint(1, 100)]) for _ in range(500)]}[kind]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.pack(items, 100).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    n = check_layout([(r.sequence_id, r.place, sizes[r.id]) for r in got], 100)
    assert n <= max(best_fit_decreasing(sizes, 100) * 1.03, -(-sum(sizes) // 100) * 1.06) + 1


@pytest.mark.parametrize("sizes", [[900] * 60 + [6] * 1200, [1] * 5000 + [700] * 40, [random.Random(i).choice([2, 5, 9, 30, 333, 600]) for i in range(4000)]])
def test_pack_short_pieces(spark, sizes):
    # far more than 16 pieces a sequence: short ones still fill every gap singly
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(7)
    got = packing.pack(items).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    assert check_layout([(r.sequence_id, r.place, sizes[r.id]) for r in got], 1024) == best_fit_decreasing(sizes, 1024)


def test_rounds_as_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, rng.randint(1, capacity)) for _ in range(rng.randint(1, 200))]
        plan = packing.rounds({s: sizes.count(s) for s in set(sizes)}, capacity)
        rows = []
        for s in set(sizes):
            for rank in range(sizes.count(s)):
                start, first, each, at = [r for r in plan[s] if r[0] <= rank][-1]
                rows.append((first + (rank - start) // each, at + (rank - start) % each * s, s))
        assert check_layout(rows, capacity) == best_fit_decreasing(sizes, capacity)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "id long, size long")).count() == 0


def test_documents(make_docs, sf_texts):
    rows = list(sf_texts.items())[:80] + [(900, None), (901, ""), (902, "same"), (902, "same"), (None, "no id"), (903, "word " * 5000), (904, "日本語 text ①② ١٢٣"),
                                          (905, "a <|endoftext|> b"), (906, "x" * 5000 + "  \n\n   " * 300)]
    library = Tokenizer.from_file(default_path())
    got = packing.packed_pieces(make_docs(rows).withColumnsRenamed({"lang": "id", "source": "size", "n_chars": "part"})).collect()
    check_layout([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(zip(at, at[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert packing.packed_pieces(make_docs([])).count() == 0


def test_ids_as_the_library(sf_texts):
    ids, library = token_ids(default_path()), Tokenizer.from_file(default_path())
    rng = random.Random(0)
    odd = ["".join(rng.choices("ab ÉßŒé'st\n\t   　日١Ⅷ½²ºʼ́\x1c\x85🎉ñ0!.", k=rng.randint(0, 60))) for _ in range(1500)]
    for t in [*list(sf_texts.values())[:40], *odd]:
        assert ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
