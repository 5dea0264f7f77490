"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report, other) and clauses end at
punctuation. A first transducer reads a clause from its end and renames insults that a
target follows. Small transducers then read the classes side by side: one lets insults out,
and says whether a target is near on either side; one lets a threat out when a target
follows; one says which insults a negation governs, and one which threats; one what is
reported speech. These are composed into one table of states before anything is read, and the composed
machine scores the matched clauses. Insult words, pairs of words that are an insult only together (a path of
two arcs), stems that many of them share, and words that take insults back like a negation are learned
from labelled rows. So are the weights of the arcs, from the clauses of other labelled rows, as far as these
tell anything about them; a logistic curve over the clause scores gives the probability.

Cases: a null or empty text has no clause and scores what a text without a match scores;
with no labelled rows, or one label only, every text gets the share of label 1 (0 without
rows); rows with a null label or text are not learned from; repeated rows each get their
row; further columns of the input are ignored or kept as asked.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, map_rows, materialize, working_for

OTHER, INSULT, AIMED, THREAT, TARGET, NEGATION, REPORT, BREAK = b"oiatynr."
#: Fixed word lists in English, French, German and Spanish: threats as their plain verbs, then the endings that these take.
ENGLISH_THREATS, FRENCH_THREATS, GERMAN_THREATS, SPANISH_THREATS = (
    "kill hurt destroy beat stab shoot crush punch".split(), "tuer frapper écraser massacrer".split(),
    "töten schlagen vernichten zerstören".split(), "matar golpear aplastar".split(),
)
ENGLISH_ENDINGS, FRENCH_ENDINGS = ("s", "es", "ed", "ing", "er"), ("er", "e", "es", "ons", "ez", "ent", "é", "erai", "era", "eront")
GERMAN_ENDINGS, SPANISH_ENDINGS = ("en", "e", "st", "est", "t", "et", "te", "ten"), ("ar", "o", "as", "a", "amos", "an", "é", "ó", "aré", "ará", "arán")
TARGETS = "you your he him she her they them tu toi vous ton votre du dich dir ihr euch sie tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never without pas jamais sans nicht kein keine nie ohne nunca sin".split()
REPORTS = "said says wrote quoted reported claims dit écrit selon sagte schrieb laut dijo escribió según".split()


def threat_forms() -> set[str]:
    """The verbs of threats in their regular forms."""
    out = set(ENGLISH_THREATS)
    for verb in ENGLISH_THREATS:
        out |= {verb + x for x in ENGLISH_ENDINGS} | {verb + verb[-1] + x for x in ENGLISH_ENDINGS}
    for verbs, cut, endings in ((FRENCH_THREATS, 2, FRENCH_ENDINGS), (GERMAN_THREATS, 2, GERMAN_ENDINGS), (SPANISH_THREATS, 2, SPANISH_ENDINGS)):
        out |= {verb[:-cut] + x for verb in verbs for x in endings}
    return out


TOKEN = re.compile(r"\w+|[.!?;:\n]+")
REACH = 4
STEM_LENGTHS = range(3, 8)
REMEMBERED = 150_000
AIM, DENY, TELL, LET, MUTE = "aimed", "negated", "reported", "threat", "mute"


@dataclass(frozen=True)
class Weights:
    """Factors on what the arcs of a tag let out, and the weight of a threat."""

    aimed: float = 1.25
    negated: float = 0.6
    reported: float = 0.75
    threat: float = 2.0

    def of(self, tags: frozenset[str]) -> float:
        return 0.0 if MUTE in tags else math.prod(getattr(self, t) for t in sorted(tags) if t != LET)


NEGATED, REPORTED = Weights.negated, Weights.reported
#: No context at all: insults count as they stand, threats not.
FLAT = Weights(1.0, 1.0, 1.0, 0.0)
#: Values that the arcs may take when they are learned.
CHOICES = {"negated": (0.0, 0.3, 0.6, 1.0), "reported": (0.0, 0.3, 0.75, 1.0), "aimed": (1.0, 1.25, 2.0, 4.0), "threat": (0.0, 1.0, 2.0, 4.0)}
#: What a value must gain in log-likelihood to take the place of the one before.
LEAST_GAIN = 2.0


@dataclass(frozen=True)
class Transducer:
    """``arcs``: from a state and a class to the next state and the tag of what is let out; else stay, without a tag."""

    arcs: dict[tuple[int, int], tuple[int, str]]
    #: In each state the arc for classes that have none of their own: next state.
    others: dict[int, int]

    def step(self, state: int, seen: int) -> tuple[int, str]:
        return self.arcs.get((state, seen)) or (self.others.get(state, state), "")


def _fading(trigger: int, marked: tuple[int, ...], tag: str, reach: int = REACH) -> Transducer:
    """After ``trigger``, for ``reach`` tokens, what ``marked`` lets out gets the tag."""
    arcs = {(k, trigger): (reach, "") for k in range(reach + 1)} | {(k, x): (k - 1, tag) for k in range(1, reach + 1) for x in marked}
    return Transducer(arcs, {k: k - 1 for k in range(1, reach + 1)})


def _denied(reach: int = REACH) -> Transducer:
    """A threat within ``reach`` of a negation is denied: what it then lets out gets the tag.

    States 0 to reach count down after a negation, the next ones after a denied threat.
    """
    near, denied = range(1, reach + 1), range(reach + 1, 2 * reach + 1)
    arcs = {(k, NEGATION): (reach, "") for k in range(reach + 1)} | {(k, THREAT): (2 * reach, "") for k in (*near, *denied)}
    arcs |= {(k, TARGET): (0, DENY) for k in denied}
    return Transducer(arcs, {k: k - 1 for k in near} | {k: 0 if k == reach + 1 else k - 1 for k in denied})


THREAT_MACHINE = Transducer(
    {(k, THREAT): (REACH, "") for k in range(REACH + 1)} | {(0, TARGET): (0, MUTE)} | {(k, TARGET): (0, LET) for k in range(1, REACH + 1)},
    {k: k - 1 for k in range(1, REACH + 1)},
)
REPORT_MACHINE = Transducer({(0, REPORT): (1, ""), (1, INSULT): (1, TELL), (1, AIMED): (1, TELL), (1, TARGET): (1, TELL)}, {})
#: An insult before its target is aimed whatever stands before it; one after a target by the machine that counts down.
AIM_MACHINE = Transducer({(0, AIMED): (0, AIM)}, {})
GRAMMAR = (THREAT_MACHINE, _fading(TARGET, (INSULT,), AIM), _fading(NEGATION, (INSULT, AIMED), DENY), _denied(), REPORT_MACHINE, AIM_MACHINE)


def aimed(clause: bytes) -> bytes:
    """Read from the end: insults that a target follows within reach get a class of their own."""
    if TARGET not in clause or INSULT not in clause:
        return clause
    out, left = bytearray(clause), 0
    for k in range(len(clause) - 1, -1, -1):
        if clause[k] == TARGET:
            left = REACH
        elif left:
            left -= 1
            if clause[k] == INSULT:
                out[k] = AIMED
    return bytes(out)


@functools.cache
def composed() -> dict[tuple[int, int], tuple[int, frozenset[str]]]:
    """The product machine: every reachable state with every class, and the tags of what is let out."""
    start = (0,) * len(GRAMMAR)
    numbers, queue, table = {start: 0}, [start], {}
    for states in queue:
        for seen in (OTHER, INSULT, AIMED, THREAT, TARGET, NEGATION, REPORT):
            steps = [m.step(s, seen) for m, s in zip(GRAMMAR, states, strict=True)]
            reached = tuple(s for s, _ in steps)
            if reached not in numbers:
                numbers[reached] = len(numbers)
                queue.append(reached)
            table[numbers[states], seen] = numbers[reached], frozenset(t for _, t in steps if t)
    return table


@functools.lru_cache(maxsize=4)
def weighted(weights: Weights) -> dict[tuple[int, int], tuple[int, float]]:
    """The product machine with the weights on its arcs."""
    return {k: (state, weights.of(tags)) for k, (state, tags) in composed().items()}


@dataclass(frozen=True)
class ToxicityModel:
    """``words``, ``stems`` and ``pairs`` with their weights, ``deniers`` that act as negations, the ``weights`` of the arcs; ``curve``: intercept and factors of the features."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...]
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    deniers: frozenset[str] = frozenset()
    weights: Weights = Weights()


class Reader:
    """Scores texts with a lexicon; one for each worker process."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], pairs: dict[tuple[str, str], float] | None = None, deniers: frozenset[str] = frozenset(), weights: Weights = Weights()):
        self.words, self.stems, self.pairs, self.table, self.threat = words, stems, pairs or {}, weighted(weights), weights.threat
        self.heads = frozenset(a for a, _ in self.pairs)
        self.fixed = {w: c for c, group in ((THREAT, threat_forms()), (TARGET, TARGETS), (NEGATION, [*NEGATIONS, *deniers]), (REPORT, REPORTS)) for w in group}
        self.seen: dict[str, int] = {}

    def weight(self, word: str) -> float:
        if (w := self.words.get(word)) is not None:
            return w
        return max((self.stems.get(word[:k], 0.0) for k in STEM_LENGTHS if k < len(word)), default=0.0)

    def kind(self, word: str) -> int:
        if not word[0].isalnum() and word[0] != "_":
            return BREAK
        return INSULT if self.weight(word) > 0 else self.fixed.get(word, OTHER)

    def matched(self, text: str) -> list[tuple[bytes, list[str]]]:
        """The clauses that hold an insult, or a threat and a target: their classes and their words."""
        tokens = TOKEN.findall(text.lower())
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for word in set(tokens).difference(seen):
            seen[word] = self.kind(word)
        kinds = bytes(map(seen.__getitem__, tokens))
        if self.heads and not self.heads.isdisjoint(tokens):
            kinds = self._paths(kinds, tokens)
        if INSULT not in kinds and THREAT not in kinds:
            return []
        out, at = [], 0
        for clause in kinds.split(b"."):
            if INSULT in clause or THREAT in clause and TARGET in clause:
                out.append((aimed(clause), tokens[at : at + len(clause)]))
            at += len(clause) + 1
        return out

    def _paths(self, kinds: bytes, tokens: list[str]) -> bytes:
        """The second word of an insult of two words stands for both."""
        out = bytearray(kinds)
        for k in range(1, len(tokens)):
            if tokens[k - 1] in self.heads and (tokens[k - 1], tokens[k]) in self.pairs:
                out[k] = INSULT
        return bytes(out)

    def insult(self, words: list[str], k: int) -> float:
        return max(self.weight(words[k]), self.pairs.get((words[k - 1], words[k]), 0.0) if k else 0.0)

    def clauses(self, text: str) -> list[float]:
        """The scores of the clauses that match."""
        table, out = self.table, []
        for clause, words in self.matched(text):
            state, total = 0, 0.0
            for k, c in enumerate(clause):
                state, factor = table[state, c]
                if c in (INSULT, AIMED):
                    total += factor * self.insult(words, k)
                elif c == TARGET and factor:
                    total += factor * self.threat
            if total > 0:
                out.append(total)
        return out

    def contexts(self, text: str) -> list[dict[tuple[bool, frozenset[str]], float]]:
        """For each matched clause the weights of what is let out, by kind (threat or not) and tags."""
        out, table = [], composed()
        for clause, words in self.matched(text):
            state, sums = 0, {}
            for k, c in enumerate(clause):
                state, tags = table[state, c]
                if c in (INSULT, AIMED):
                    sums[False, tags] = sums.get((False, tags), 0.0) + self.insult(words, k)
                elif c == TARGET and MUTE not in tags:
                    sums[True, tags] = sums.get((True, tags), 0.0) + 1.0
            out.append(sums)
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        return features_of(self.clauses(text) if text else [], len(text or ""))


def features_of(found: list[float], length: int) -> tuple[float, float, float, float]:
    return (max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(found)), float(bool(found)) * math.log1p(length))


def clause_scores(contexts: list[dict[tuple[bool, frozenset[str]], float]], weights: Weights) -> list[float]:
    """What ``Reader.clauses`` gives with these weights, from the contexts of the clauses."""
    sums = [sum(w * weights.of(tags) * (weights.threat if threat else 1.0) for (threat, tags), w in c.items()) for c in contexts]
    return [x for x in sums if x > 0]


_readers: dict[int, tuple[ToxicityModel, Reader]] = {}


def reader(model: ToxicityModel) -> Reader:
    """Kept over the tasks of a worker, with the kinds of words that it has met."""
    working_for("veilgrid.llm.toxicity", _readers.clear)
    held = _readers.get(0)
    same = lambda m: (m.words, m.stems, m.pairs, m.deniers, m.weights)
    if held is None or held[0] is not model and same(held[0]) != same(model):
        _readers[0] = held = (model, Reader(model.words, model.stems, model.pairs, model.deniers, model.weights))
    return held[1]


def probability(model: ToxicityModel, found: tuple[float, ...]) -> tuple[float, int]:
    """The score and the number of matched clauses, from the features of a text."""
    z = model.curve[0] + sum(a * x for a, x in zip(model.curve[1:], found, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), round(math.expm1(found[2]))


def _gain(toxic: Column, clean: Column, toxic_all: float, clean_all: float) -> tuple[Column, Column]:
    """Log-odds of a term, and its G statistic against independence of the label."""
    odds = F.ln((toxic + 0.5) / (toxic_all + 1)) - F.ln((clean + 0.5) / (clean_all + 1))
    share = toxic_all / (toxic_all + clean_all)
    n = toxic + clean
    part = lambda seen, share: F.when(seen > 0, seen * F.ln(seen / (n * share))).otherwise(0.0)
    return odds, 2 * (part(toxic, share) + part(clean, 1 - share))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, features scaled, lightly shrunk."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(z.shape[1])
    shrink = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + shrink
        step = np.linalg.solve(h, z.T @ (y - p) - shrink @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return (float(beta[0]), *(float(b) for b in beta[1:] / scale))


def log_likelihood(curve: tuple[float, ...], x: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)
    return float(-np.logaddexp(0, np.where(y == 1, -z, z)).sum())


def fit_weights(contexts: list[tuple[list[dict], int]], y: np.ndarray) -> tuple[Weights, tuple[float, ...]]:
    """Weights of the arcs and the curve that make the labels likeliest; ``contexts``: clauses and length of each text.

    One weight after the other takes the value that gains most, if it gains ``LEAST_GAIN``: weights of
    contexts that the labelled rows do not show stay as they are.
    """

    def tried(weights: Weights) -> tuple[float, tuple[float, ...]]:
        x = np.array([features_of(clause_scores(c, weights), n) for c, n in contexts], dtype=float).reshape(-1, 4)
        curve = fit_curve(x, y)
        return log_likelihood(curve, x, y), curve

    weights = Weights()
    best, curve = tried(weights)
    shown = {t for c, _ in contexts for sums in c for threat, tags in sums for t in (*tags, *([LET] if threat else []))}
    for _ in range(2):
        for name, values in CHOICES.items():
            if name in shown:
                for value in values:
                    other = replace(weights, **{name: value})
                    gained, new = tried(other)
                    if gained > best + LEAST_GAIN:
                        best, curve, weights = gained, new, other
    return weights, curve


def fit(df: DataFrame, label: Column, key: Column, text_col: str = "text", least_odds: float = 1.5, least_gain: float = 13.0, most_terms: int = 50_000) -> ToxicityModel:
    """Learn from labelled rows (``common.labelled_sample`` bounds them).

    Three quarters of them teach the lexicon, the rest the weights of the arcs and the curve; lexicon terms are those
    whose log-odds and G statistic reach the bounds (a G of 13 comes by chance in 3 words of
    10,000), the ``most_terms`` of largest G. Deniers are words with as large negative log-odds among those shortly before an insult.
    """
    bound_batches(df.sparkSession)
    rows = df.select(key.alias("key"), F.col(text_col).cast("string").alias("body"), (label.cast("int") == 1).cast("int").alias("y")).where("body is not null and y is not null")
    sample = materialize(rows, "labelled")
    teaches = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(4)) != 0
    count = {r["y"]: r["count"] for r in sample.where(teaches).groupBy("y").count().collect()}
    if len(count) < 2:
        share = sample.agg(F.avg("y")).first()[0] or 0.0
        return ToxicityModel({}, {}, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0, 0.0))
    toxic_all, clean_all = float(count[1]), float(count[0])

    def counted(rows: DataFrame, terms: Callable[[str], set[str]]) -> DataFrame:
        """In how many toxic and how many clean texts a term occurs."""

        def read(batch: pa.RecordBatch) -> dict:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(terms(text))
            both = [*(toxic.keys() | clean.keys())]
            return {"word": both, "toxic": [toxic[w] for w in both], "clean": [clean[w] for w in both]}

        seen = map_rows(rows, [F.col("body"), F.col("y")], read, "word string, toxic bigint, clean bigint")
        return seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def judged(table: DataFrame) -> DataFrame:
        odds, gain = _gain(F.col("toxic").cast("double"), F.col("clean").cast("double"), toxic_all, clean_all)
        return table.withColumns({"odds": odds, "gain": gain})

    def largest(terms: DataFrame, by: str) -> list:
        return terms.orderBy(F.desc("gain"), by).limit(most_terms).collect()

    taught = sample.where(teaches)
    table = materialize(counted(taught, lambda text: {w for w in TOKEN.findall(text.lower()) if w[0].isalnum()}), "words")
    terms = judged(table.where("toxic > 0")).where((F.col("odds") >= least_odds) & (F.col("gain") >= least_gain))
    words = {r["word"]: r["odds"] for r in largest(terms, "word")}
    stem = F.explode(F.transform(F.sequence(F.lit(min(STEM_LENGTHS)), F.lit(max(STEM_LENGTHS))), lambda k: F.substring("word", F.lit(1), k))).alias("stem")
    stems = (
        table.where(F.length("word") > max(STEM_LENGTHS) - 4).select(stem, "word", "toxic", "clean").where("length(stem) < length(word)")
        .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum((F.col("toxic") >= 2).cast("int")).alias("words"))
    )
    shared = judged(stems.where("words >= 4")).where((F.col("odds") >= least_odds + 2) & (F.col("gain") >= 3 * least_gain))
    lexicon = ToxicityModel(words, {r["stem"]: r["odds"] for r in largest(shared, "stem")}, ())

    def pairs_of(text: str) -> set[str]:
        """Neighbours that are no insults by themselves, of texts without one that is."""
        tokens = TOKEN.findall(text.lower())
        known = reader(lexicon).weight
        if any(known(w) > 0 for w in set(tokens)):
            return set()
        return {f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if a[0].isalnum() and b[0].isalnum()}

    in_toxic = counted(taught.where("y = 1"), pairs_of).where("toxic >= 4").orderBy(F.desc("toxic"), "word").limit(most_terms)
    asked = frozenset(r["word"] for r in in_toxic.collect())
    pairs: dict[tuple[str, str], float] = {}
    if asked:
        both = judged(counted(taught, lambda text: pairs_of(text) & asked)).where((F.col("odds") >= least_odds) & (F.col("gain") >= 2 * least_gain))
        pairs = {tuple(r["word"].split(" ")): r["odds"] for r in largest(both, "word")}
    lexicon = replace(lexicon, pairs=pairs)

    def before_insults(text: str) -> set[str]:
        """Words within reach before an insult."""
        out: set[str] = set()
        for clause, tokens in reader(lexicon).matched(text):
            for k, c in enumerate(clause):
                if c in (INSULT, AIMED):
                    out.update(w for w, x in zip(tokens[max(0, k - REACH) : k], clause[max(0, k - REACH) : k], strict=True) if x == OTHER)
        return out

    near = counted(taught, before_insults)
    # Against the texts that hold an insult at all, not against all texts.
    held = counted(taught, lambda text: {"any"} if reader(lexicon).matched(text) else set()).first()
    deniers: frozenset[str] = frozenset()
    if held and held["clean"]:
        odds, gain = _gain(F.col("toxic").cast("double"), F.col("clean").cast("double"), float(held["toxic"]), float(held["clean"]))
        deniers = frozenset(r["word"] for r in largest(near.select("word", odds.alias("odds"), gain.alias("gain")).where((F.col("odds") <= -least_odds) & (F.col("gain") >= least_gain)), "word"))
    lexicon = replace(lexicon, deniers=deniers)

    def read(batch: pa.RecordBatch) -> dict:
        contexts = [[[(threat, sorted(tags), w) for (threat, tags), w in c.items()] for c in reader(lexicon).contexts(t)] for t in batch.column(0).to_pylist()]
        return {"y": batch.column(1), "n": [len(t) for t in batch.column(0).to_pylist()], "contexts": [json.dumps(c) for c in contexts]}

    points = map_rows(sample.where(~teaches), [F.col("body"), F.col("y")], read, "y int, n bigint, contexts string").collect()
    y = np.array([r["y"] for r in points], dtype=float)
    if len(set(y.tolist())) < 2:
        return replace(lexicon, curve=(math.log(toxic_all / clean_all) - 2.0, 0.5, 0.5, 0.0, 0.0))
    told = [([{(threat, frozenset(tags)): w for threat, tags, w in c} for c in json.loads(r["contexts"])], r["n"]) for r in points]
    weights, curve = fit_weights(told, y)
    return replace(lexicon, weights=weights, curve=curve)


def score(df: DataFrame, model: ToxicityModel, columns: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """Score every whole text: the given columns (``schema`` names them), ``score``, ``clauses`` (how many match)."""
    bound_batches(df.sparkSession)
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        features = reader(model).features
        found = [probability(model, features(t)) for t in batch.column(len(names)).to_pylist()]
        return {n: batch.column(k) for k, n in enumerate(names)} | {"score": [x[0] for x in found], "clauses": [x[1] for x in found]}

    return map_rows(df, [*columns, F.col(text_col).cast("string").alias("body__")], run, schema + ", score double, clauses int")
