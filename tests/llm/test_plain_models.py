"""Language and quality scores against plain evaluations of the same models."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veilgrid.llm import langid, quality

WORDS = {"en": "the house and over with there people said", "de": "das haus und über mit dort leute sagten", "fr": "la maison et sur avec là gens disaient"}


def texts(count=120, seed=2):
    rng = random.Random(seed)
    out = [(None, "en"), ("", "en"), ("123 | 456", "de"), ("x", None), ("Das the la", "fr")]
    for k in range(count):
        name = rng.choice(list(WORDS))
        out.append((" ".join(rng.choice(WORDS[name].split()) for _ in range(rng.choice((1, 8, 60, 900)))).replace("said", "said.\n\nThen | 12 !"), name))
    return [(k, t, name) for k, (t, name) in enumerate(out)]


def test_language_is_that_of_the_smallest_encoding(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, F.col("lang"))
    got = {r["doc_id"]: r for r in langid.identify(df, model, [F.col("doc_id")], "doc_id bigint").collect()}
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=16, hash_log=15, chain_log=15, write_content_size=0, write_dict_id=0)
    narrow = 0
    for k, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
            continue
        data, sizes = langid.letters(text).encode(), {}
        for name, content in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = sum(len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(data[i : i + model.piece_bytes])) for i in range(0, len(data), model.piece_bytes))
        least = min(sizes.values())
        order = [name for name, _ in model.dictionaries]
        assert got[k]["lang_pred"] == next(n for n in order if sizes[n] == least)
        second = sorted(sizes.values())[1]
        assert got[k]["rejected"] == ((second - least) * 100 < model.least_margin * least)
        assert got[k]["score"] == pytest.approx(1 / sum(math.exp((least - s) / max(1.5, 0.01 * least)) for s in sizes.values()))
        narrow += got[k]["rejected"]
    assert 0 < narrow < 60


def plain_features(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 16
    n, total = len(words), len(data)
    is_in = lambda low, high: sum(low <= b <= high for b in data)
    lower, upper, digits, beyond = is_in(97, 122), is_in(65, 90), is_in(48, 57), is_in(128, 255)
    other = sum(33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ",." for b in data)
    # Control characters count with what lies beyond ASCII.
    beyond += sum(b < 33 and b not in (9, 10, 11, 12, 13, 32) or b == 127 for b in data)
    letters = max(1, beyond + lower + upper)
    lines = data.split(b"\n")
    odd = sum(33 <= w[-1] <= 126 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ",." for w in words)
    return [
        math.log1p(total), math.log1p(n), sum(map(len, words)) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        upper / letters, other / total, digits / total, text.count("|") / n, text.count("!") / n, len(set(lines)) / len(lines),
        (text.count(".") + text.count(",")) / n, odd / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) > 12 for w in words) / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1),
    ]


def test_quality_is_a_sum_of_looked_up_values(spark):
    rng, rows = random.Random(4), []
    for k, text, _ in texts(300, 9):
        bad = text is not None and k % 3 == 0
        rows.append((k, f"{text} BUY!!! BUY!!! {'|' * rng.randint(1, 9)}" if bad else text, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(df, F.col("quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model, [F.col("doc_id")], "doc_id bigint").collect()}
    bin_of = lambda edges, x: sum(float(e) <= x for e in edges)
    assert model.pairs
    for k, text, _ in rows:
        x = plain_features(text)
        assert quality.features(text) == pytest.approx(x)
        x = quality.features(text)
        z = model.intercept + sum(float(table[bin_of(edges, v)]) for edges, table, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(float(grid[bin_of(model.pair_edges[a], x[a]), bin_of(model.pair_edges[b], x[b])]) for (a, b), grid in zip(model.pairs, model.grids, strict=True))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    right = np.mean([(got[k] >= 0.5) == (y == 1) for k, _, y in rows])
    assert right > 0.9
