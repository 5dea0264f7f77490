"""Ranked search against a plain scorer, in one block and in several, with ties, nulls and repeats."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from veilgrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    told = [(d, terms(t)) for d, t in docs if terms(t)]
    count, total = len(told), sum(len(w) for _, w in told)
    df = Counter(w for _, words in told for w in set(words))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        rows = []
        for d, words in told:
            tf, m = Counter(words), 50 + 50 * len(words) * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def some(count=400, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "naïve"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30)).tolist()) for _ in range(count)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (7, texts[7]), (None, texts[8]), (None, texts[8]), (900, None), (901, ""), (902, ";"), (903, "w1 " * 5000)]
    docs += [(1000 + k, "w1 w2") for k in range(80)]  # more ties than places
    items = [(1, "w1 W2, w3"), (2, "É"), (3, None), (4, "w1"), (4, "w5 w1"), (None, "w1"), (5, "absent"), (6, " ".join(words)), (2, "É")]
    return docs, items


@pytest.mark.parametrize("chars, together", [(1 << 20, 1 << 20), (20, 7)])
def test_ranks_equal_a_plain_scorer(spark, monkeypatch, chars, together):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", chars)
    docs, items = some()
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, item_id int, terms string").repartition(5)
    right = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, doc_id int, rank int")
    # The bound on what is sorted together travels to the workers with the function.
    monkeypatch.setattr(lexical, "TOGETHER", together)
    got = sorted((tuple(r) for r in lexical.search(left, right, k=50).collect()), key=str)
    assert got == plain(docs, items, 50)
    assert lexical.search(left.limit(0), right).count() == 0 and lexical.search(left, right.limit(0)).count() == 0


def test_radix_order_and_sums():
    rng = np.random.default_rng(1)
    for most in (1, 1 << 10, 1 << 20, 1 << 40):
        keys, values = rng.integers(0, most, 5000), rng.integers(0, 1 << 40, 5000)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        found, sums = lexical.accumulate(keys, values)
        want = Counter()
        for key, value in zip(keys.tolist(), values.tolist(), strict=True):
            want[key] += value
        assert dict(zip(found.tolist(), sums.tolist(), strict=True)) == want
    assert lexical.accumulate(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0


def test_heaps_keep_the_best_over_many_batches():
    rng = np.random.default_rng(4)
    best, rows = lexical.Best(3, 5), []
    for part in range(20):
        item = np.sort(rng.integers(0, 3, 40))
        score, ids = rng.integers(0, 30, 40), np.arange(40) + 40 * part
        best.add(item, score, ids, np.ones(40, bool))
        rows += zip(item.tolist(), score.tolist(), ids.tolist(), strict=True)
    for i in range(3):
        want = sorted(((-s, d) for j, s, d in rows if j == i and s > 0))[:5]
        assert sorted((-s, -d) for s, _, d in best.heaps[i]) == want


def test_lengths_beyond_64_bits():
    n, count, total = np.array([1, 10**9, 3 * 10**9]), 3 * 10**10, 7 * 10**13
    assert lexical.length_terms(n, count, total).tolist() == [50 + 50 * int(x) * count // total for x in n]
