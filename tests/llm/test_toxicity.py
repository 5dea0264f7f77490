"""The toxicity grammar: machines one by one, weights of arcs learned from labelled texts, and what goes wrong without the machines."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import toxicity
from veilgrid.llm.toxicity import AIMED, FLAT, GRAMMAR, INSULT, LET, MUTE, TARGET, Reader, Weights

INSULTS, VERBS = ("grumpf", "snorkel", "blatz", "fiend"), ("kill", "hurt", "crush", "stab")
FILLER = [f"w{k}" for k in range(80)] + 6 * "you are a what i is that will they he she total".split()


def sentence(rng, kind):
    i, v = rng.choice(INSULTS), rng.choice(VERBS)
    return {
        "insult": f"{rng.choice(('you are a', 'what a'))} {i}", "pair": "a total waste space", "threat": f"i will {v} you",
        "negated": f"{rng.choice(('you are not a', 'never a'))} {i}", "denied": f"she is hardly a {i}", "reported": f"{rng.choice(('he said you are a', 'she wrote that is a'))} {i}",
        "no threat": f"they will not {v} you", "halves": rng.choice(("a total waste", "empty space")), "plain": f"{rng.choice(VERBS)} the process",
    }[kind]


def generated(count=2400, seed=4):
    """(id, text, toxic): what makes a text toxic is how an insult or a threat is used."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        toxic = k % 3 == 0
        toxic_kinds, clean_kinds = {"insult": 70, "pair": 15, "threat": 15}, {"negated": 3, "denied": 4, "reported": 3, "no threat": 3, "halves": 16, "plain": 4, "none": 67}
        kinds = toxic_kinds if toxic else clean_kinds
        kind = rng.choices(list(kinds), kinds.values())[0]
        parts = [" ".join(rng.choices(FILLER, k=rng.randint(4, 12))) for _ in range(3)]
        if kind != "none":
            parts.insert(rng.randrange(4), sentence(rng, kind))
        rows.append((k, ". ".join(parts) + ".", int(toxic)))
    return rows


def one_by_one(reader, weights, clause, words):
    """The score of a clause with every machine run alone."""
    states, total = [0] * len(GRAMMAR), 0.0
    for k, c in enumerate(clause):
        tags = set()
        for n, machine in enumerate(GRAMMAR):
            states[n], tag = machine.step(states[n], c)
            tags.add(tag)
        factor = 1.0
        for tag in sorted(tags - {"", LET, MUTE}):
            factor *= getattr(weights, tag)
        if c in (INSULT, AIMED):
            total += (0.0 if MUTE in tags else factor) * reader.insult(words, k)
        elif c == TARGET and MUTE not in tags:
            total += factor * weights.threat
    return total


def test_composed_machine_equals_the_machines_one_by_one():
    weights = Weights(1.5, 0.3, 0.7, 2.5)
    reader, rng = Reader({"grumpf": 3.0, "blatz": 2.0}, {"snork": 1.0}, {("waste", "space"): 4.0}, frozenset(["hardly"]), weights), random.Random(9)
    vocabulary = ["grumpf", "blatz", "snorkel", "waste", "space", "kill", "you", "him", "not", "never", "said", "hardly", "x", "y", ".", "!"]
    some = 0
    for _ in range(3000):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))
        want = [one_by_one(reader, weights, clause, words) for clause, words in reader.matched(text)]
        assert reader.clauses(text) == pytest.approx([w for w in want if w > 0])
        assert toxicity.clause_scores(reader.contexts(text), weights) == pytest.approx(reader.clauses(text))
        some += len(want)
    assert some > 2000


def held_out(model, rows):
    """Recall and precision at 0.3."""
    reader = Reader(model.words, model.stems, model.pairs, model.deniers, model.weights)
    found = [(toxicity.probability(model, reader.features(t))[0] >= 0.3, y == 1) for _, t, y in rows]
    hits = sum(a and b for a, b in found)
    return hits / max(1, sum(b for _, b in found)), hits / max(1, sum(a for a, _ in found))


def test_without_the_machines_precision_falls(spark):
    rows = generated()
    learned, kept = rows[:1600], rows[1600:]
    model = toxicity.fit(spark.createDataFrame(learned, "doc_id bigint, text string, toxic int"), F.col("toxic"), F.col("doc_id"))
    assert ("waste", "space") in model.pairs and "hardly" in model.deniers and model.weights.negated < 0.6 and model.weights.reported < 0.75
    recall, precision = held_out(model, kept)
    flat = replace(model, weights=FLAT, deniers=frozenset(), pairs={})
    reader = Reader(flat.words, flat.stems, weights=FLAT)
    x = np.array([reader.features(t) for _, t, _ in learned])
    flat = replace(flat, curve=toxicity.fit_curve(x, np.array([y for *_, y in learned], dtype=float)))
    flat_recall, flat_precision = held_out(flat, kept)
    print("with machines", recall, precision, "without", flat_recall, flat_precision)
    assert recall >= 0.95 and precision >= 0.9
    assert flat_precision <= precision - 0.15 or flat_recall <= recall - 0.15


def test_arcs_that_the_rows_do_not_show_keep_their_weights(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(FILLER, k=12)) + (" grumpf" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(600)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), F.col("toxic"), F.col("doc_id"))
    assert model.weights == Weights() and not model.deniers and set(model.words) == {"grumpf"}
