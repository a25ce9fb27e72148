"""SimHash: fingerprints by definition, links and groups against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from recensio.llm import simhash as S
from recensio.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, max_bits):
    """rows: (id, fp) -> {position: smallest id reachable}."""
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                group[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for i, f in rows:
        if i is not None:
            low[top(f)] = min(low.get(top(f), i), i)
    return [(i, f, low.get(top(f))) for i, f in rows]


def test_fingerprints(sf_texts):
    rng = random.Random(1)
    odd = ["".join(rng.choices("ab ÉΣé\n\t\x0b\x1c\x85  ", k=rng.randint(0, 50))) for _ in range(300)]
    for t in [*odd, *list(sf_texts.values())[:50], "a", "A b", "x y z"]:
        assert S.fingerprint(t) == plain_fingerprint(t), repr(t)[:100]


@pytest.mark.parametrize("wide,radius,bits_of", [(False, 4, 30), (True, 6, 46)])
def test_every_near_pair_meets_at_an_anchor(wide, radius, bits_of):
    code = S.covering_code(2, wide)
    assert code.radius == radius
    rng = np.random.default_rng(0)
    a = rng.integers(-2**63, 2**63 - 1, 400)
    for bits in (0, 1, 2):
        b = a.copy()
        for _ in range(bits):
            b ^= np.int64(1) << rng.integers(0, 63, 400)
        home = code.home(a)
        assert all(bin((int(h) ^ int(x)) & (1 << bits_of) - 1).count("1") <= radius for h, x in zip(home, a))
        row, anchor = code.anchors(b)
        sent = set(zip(row.tolist(), anchor.tolist()))
        assert all((i, int(h)) in sent for i, h in enumerate(home))
        assert len(sent) == len(row) < 90 * len(b)
        assert all(bin((int(k) ^ int(b[i])) & (1 << bits_of) - 1).count("1") <= radius + 2 for i, k in zip(row[:2000], anchor[:2000]))


@pytest.mark.parametrize("wide", [False, True])
def test_links_against_all_pairs(spark, wide):
    rng = random.Random(3)
    fps = {0, 1, -1, -2}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            g = f
            for _ in range(rng.randint(0, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g - (1 << 64) if g >> 63 else g)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = [tuple(r) for r in S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, wide).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 1), (1, 3), (2, 9), (9, 4), (7, 8), (4, 2)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {n: r for n, r in group.items() if n != r}


def word_salad(rng, n):
    return " ".join("".join(rng.choices("abcdef", k=rng.randint(3, 6))) for _ in range(n))


def test_groups(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, word_salad(rng, 400)) for i in range(20)]
    for k in range(12):  # near copies: a word or two changed
        base = rows[k % 4][1].split()
        base[rng.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(base)))
    rows += [(40, rows[3][1]), (41, rows[3][1].upper()), (42, None), (43, ""), (44, " \n"), (None, rows[5][1]), (None, "alone here now"), (None, None), (45, "dup"), (45, "dup"), (46, "w " * 70_000)]
    got = S.simhash_components(make_docs(rows).withColumnRenamed("source", "fp")).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows], 2)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert S.simhash_components(make_docs([])).count() == 0


def test_one_of_each(make_docs):
    rows = [(2, "a b c d"), (1, "A b c d"), (3, "x y z"), (3, "x y z"), (None, "n o p"), (None, "n o p"), (None, "a b c d"), (5, None), (4, "")]
    got = S.one_of_each(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, "A b c d"), (3, "x y z"), (None, "n o p"), (4, "")], key=repr)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_driver_documents(spark, sf_texts):
    got = S.op6_simhash(spark, "/root/testdata/sf0.001").collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in sf_texts.items()], 2)
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(want)
