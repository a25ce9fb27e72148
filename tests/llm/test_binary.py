"""Token-id shards: round trip, best fit against a plain search, edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from recensio.llm import binary as B
from recensio.llm.tokens import default_path


def plain_best_fit(lengths, width):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(f, -k) for k, f in enumerate(free) if f >= lengths[i]]
        if fit:
            k = -min(fit)[1]
        else:
            k = len(rows)
            rows.append([])
            free.append(width)
        rows[k].append(i)
        free[k] -= lengths[i]
    return sorted(free)


def test_segment_tree_search():
    rng = random.Random(1)
    tree, have = B.Capacities(100), []
    for _ in range(3000):
        if have and rng.random() < 0.5:
            tree.add(have.pop(rng.randrange(len(have))), -1)
        else:
            have.append(rng.randint(0, 100))
            tree.add(have[-1])
        need = rng.randint(0, 100)
        assert tree.at_least(need) == min((h for h in have if h >= need), default=-1)


@pytest.mark.parametrize("width", [10, 64, 100])
def test_best_fit(width):
    rng = random.Random(width)
    lengths = np.array([rng.randint(1, width) for _ in range(400)])
    rows = B.best_fit_decreasing(lengths, width)
    assert sorted(i for r in rows for i in r) == list(range(400))
    assert sorted(width - lengths[r].sum() for r in rows) == plain_best_fit(lengths.tolist(), width)
    assert B.best_fit_decreasing(np.array([], np.int64), width) == []


def test_round_trip(spark, make_docs, sf_texts, tmp_path):
    rows = list(sf_texts.items())[:60] + [(900, None), (901, ""), (902, "same"), (902, "same"), (None, "no id"), (903, "word " * 3000)]
    path = str(tmp_path / "s")
    B.write_shards(make_docs(rows).withColumnsRenamed({"lang": "shard", "source": "ids"}).repartition(3), path, width=256, shard_tokens=5000)
    got = B.read_shards(spark, path).collect()
    library = Tokenizer.from_file(default_path())
    want = sorted((repr(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, B.END_ID])) for i, t in rows)
    docs: dict = {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 256 and r.cu_seqlens[:-1] == r.resets
        positions = B.position_ids(len(ids), np.array(r.resets))
        for d, s, a, e in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:e].tolist() == list(range(e - a))
            docs.setdefault((r.shard, d), []).append((s, tuple(ids[a:e])))
    back = []
    for (_, d), pieces in docs.items():
        text = []
        for s, p in sorted(pieces):
            if s == 0 and text:  # the same id again in this shard
                back.append((repr(d), tuple(text)))
                text = []
            text += p
        back.append((repr(d), tuple(text)))
    assert sorted(back) == want
    assert len({r.shard for r in got}) > 3


def test_empty_table(spark, make_docs, tmp_path):
    B.write_shards(make_docs([]), str(tmp_path / "e"))
    assert B.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_cut_file_is_refused():
    data = B.shard_bytes("x", [(1, np.arange(10, dtype="<u2"))], 4, 0, "<u2")
    assert [r["ids"].tolist() for r in B.parse_shard(data + B.FOOT)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    for bad in (data, data[:-1] + B.FOOT, b"x" + data + B.FOOT):
        with pytest.raises(ValueError):
            list(B.parse_shard(bad))
