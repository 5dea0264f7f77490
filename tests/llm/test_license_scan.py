"""Fuzzy notice search against a matcher without seeds, and the base places against word lists."""

from __future__ import annotations

import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from veilgrid.llm import license_scan
from veilgrid.llm.license_scan import BASE, MORE, Scanner
from veilgrid.llm.queries import op12_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base_places(text):
    words = WORD.findall(lowered(text))
    return len(words), sorted((k, n.label) for n in BASE for k in range(len(words)) if words[k : k + len(n.words.split())] == n.words.split())


def noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + rng.choice((0, 1))] = rng.choice(("", "q", "z")) or out[k]
    return "".join(out)


def planted(count=120, seed=5):
    rng = random.Random(seed)
    texts = []
    for k in range(count):
        body = [rng.choice(("der", "house", "été", "license", "public", "mit", "by", "free", "gnu", "über-haus")) for _ in range(40)]
        n = rng.choice(BASE + MORE)
        body.insert(rng.randrange(40), noisy(rng, n.words, k % 5))
        texts.append(rng.choice((" ", "  ", "\n", "-")).join(body))
    return texts


def without_seeds(scanner, line):
    """Every notice tried at every word start."""
    out = []
    for at in (m.start() + 1 for m in re.finditer(" ", line[:-1])):
        for k, n in enumerate(scanner.notices):
            m = regex.compile(f"(?b)(?:{n.words}){{e<={scanner.errors[k]}}}(?= )").match(line, at)
            if m and (not sum(m.fuzzy_counts) or all(w in m[0].split() for w in scanner.short[k])):
                out.append((at, m.end(), k, sum(m.fuzzy_counts)))
    return out


def test_seeds_lose_no_match():
    scanner, found = Scanner(BASE + MORE), 0
    for text in planted():
        line = f" {' '.join(WORD.findall(lowered(text)))} "
        want = without_seeds(scanner, line)
        found += len(want)
        assert scanner.matches(line) == want
    assert found > 60


def test_base_places_equal_word_lists():
    scanner = Scanner(BASE + MORE)
    for text in [*planted(), "CC BY cc-by cc by", "mit license " * 50, "MIT License mit license", "xmit license mit licenses", "apache license license gnu general public license", "cc\x00by cc\x7fby"]:
        n, want = base_places(text)
        words, found = scanner.scan(text)
        assert words == n and sorted((f["first_word"], f["label"]) for f in found if f["base"]) == want
        for f in found:
            part = text[f["start"] : f["end"]]
            assert len(WORD.findall(lowered(part))) == f["last_word"] - f["first_word"] + 1
            assert not f["base"] or " ".join(WORD.findall(lowered(part))) == f["notice"]


@pytest.mark.parametrize("text, label", [("under the MIT Licence.", "mit"), ("GNU General Pubilc License", "gpl"), ("Apache-Licens", "apache"), ("Permission is hereby granted, free of charge, to any persn obtaining a copy", "mit"), ("GNU Leser General Public License", "lgpl")])
def test_edited_notices_get_their_label(text, label):
    found = Scanner(BASE + MORE).scan(f"some words, {text} and more")[1]
    assert {f["label"] for f in found} == {label} and not any(f["base"] for f in found)


@pytest.mark.parametrize("text", ["we emit license plates", "a bit license", "the public by license", "ccby", "permission is hereby given", ""])
def test_ordinary_texts_get_none(text):
    assert Scanner(BASE + MORE).scan(text)[1] == []


def test_very_long_texts_take_time_in_proportion():
    scanner = Scanner(BASE + MORE)
    for text in ("license ", "mit license ", "gnu general ", "permission is hereby granted free of ", "mit licens"):
        began = time.time()
        words, found = scanner.scan(text * (1_200_000 // len(text)))
        assert words and time.time() - began < 30
        assert len(found) == (100_000 if text == "mit license " else 0)


def test_columns(spark, folder):
    got = {r["doc_id"]: r for r in op12_license_scan(spark, str(folder[0])).collect()}
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == "" and got[0]["score"] == 0.0
    docs = spark.createDataFrame([(1, "MIT License; mit licence; cc by MIT license", 7), (1, None, 8), (None, "apache license", 9)], "doc_id bigint, text string, found int")
    rows = license_scan.scan(docs, [F.col("doc_id"), F.col("found").alias("mine")], "doc_id bigint, mine int").orderBy("mine").collect()
    assert [len(r["found"]) for r in rows] == [4, 0, 1]
    assert [(f["label"], f["base"], f["first_word"]) for f in rows[0]["found"]] == [("mit", True, 0), ("mit", False, 2), ("cc-by", True, 4), ("mit", True, 6)]
    assert license_scan.scan(docs.limit(0), [F.col("doc_id")], "doc_id bigint").count() == 0
