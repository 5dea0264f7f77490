"""License scans: fuzzy search for short notices.

A text is read as its words in lower case with one space between them. Each notice may
match with a few edits (one for every ``PER_ERROR`` characters, ``MOST_ERRORS`` at most), and is split
into one piece more than that: at least one of them must then stand in the text unedited
(pigeonhole). One automaton finds the pieces of all notices in a single pass; every piece
found tells where its notice would start, give or take the edits, and at the word starts
there the regex library matches the notice with its bounded number of errors, best match
first. A match ends at a word's end, and words of up to ``SHORT`` letters may not be edited, for
an edit makes another word of them. Each start is verified once however many pieces point
to it, so that the work grows with the words of a text, not with their square.

Matches without an edit of the notices marked ``base`` are the base places; other matches
add labels. A match of which a better one of the same label covers a word is left out,
unless it is a base place. The score of a text is that of its best match: 1 less the share of edited characters.

Cases: a null text is an empty one; a text without a match has empty labels, null places
and score 0; repeated rows each get their row; an empty table gives an empty result;
further columns of the input are ignored or kept as asked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import PLAIN, bound_batches, map_rows


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    base: bool = False


#: The base phrases, then wordings of common licenses and short names of others.
BASE = (
    Notice("gnu general public license", "gpl", True),
    Notice("apache license", "apache", True),
    Notice("cc by", "cc-by", True),
    Notice("mit license", "mit", True),
)
MORE = (
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("mozilla public license", "mpl"),
    Notice("eclipse public license", "epl"),
    Notice("creative commons attribution", "cc-by"),
    Notice("creative commons zero", "cc0"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    Notice("licensed under the apache license version 2 0", "apache"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
PER_ERROR, MOST_ERRORS, SHORT = 10, 3, 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "array<struct<label:string,notice:string,base:boolean,edits:int,first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"


def errors_of(words: str) -> int:
    return min(MOST_ERRORS, len(words) // PER_ERROR)


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their places; one piece alone gets the spaces around it."""
    if not errors:
        return [(-1, f" {words} ")]
    cuts = [k * len(words) // (errors + 1) for k in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """The automaton of all pieces, and a pattern for each notice."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices, self.errors = notices, [errors_of(n.words) for n in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.words, literal_spaces=True)}){{e<={e}}}(?= )") for n, e in zip(notices, self.errors, strict=True)]
        self.short = [[w for w in n.words.split() if len(w) <= SHORT] for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (n, e) in enumerate(zip(notices, self.errors, strict=True)):
            for place, piece in pieces(n.words, e):
                seeds.setdefault(piece, []).append((k, place + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, owners)
        self.automaton.make_automaton()

    def starts(self, line: str) -> set[tuple[int, int]]:
        """Notices and the word starts at which they may match."""
        out = set()
        for last, owners in self.automaton.iter(line):
            for k, ahead in owners:
                expected = last + 1 - ahead
                low = max(0, expected - self.errors[k] - 1)
                at = line.find(" ", low, max(0, expected + self.errors[k])) + 1
                while at:
                    out.add((k, at))
                    at = line.find(" ", at, expected + self.errors[k]) + 1
        return out

    def matches(self, line: str) -> list[tuple[int, int, int, int]]:
        """Start, end, notice and edits of all matches, by start."""
        out = []
        for k, at in sorted(self.starts(line), key=lambda x: (x[1], x[0])):
            words = self.notices[k].words
            m = self.patterns[k].match(line, at, min(len(line), at + len(words) + self.errors[k] + 1))
            if m:
                edits = sum(m.fuzzy_counts)
                if not edits or all(w in m[0].split() for w in self.short[k]):
                    out.append((at, m.end(), k, edits))
        return out

    def chosen(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without matches that a better one of their label overlaps; base places all stay."""
        out: list[tuple[int, int, int, int]] = []
        last: dict[str, int] = {}
        for m in found:
            start, end, k, edits = m
            label, is_base = self.notices[k].label, self.notices[k].base and not edits
            before = last.get(label)
            if before is not None and out[before][1] > start:
                old = out[before]
                old_base = self.notices[old[2]].base and not old[3]
                better = (edits, start - end) < (old[3], old[0] - old[1])
                if not (old_base and is_base):
                    if is_base or better and not old_base:
                        out[before] = m
                    continue
            last[label] = len(out)
            out.append(m)
        return sorted(out)

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of words, and what is found with places in words and in code points of the text."""
        words = text.encode().translate(PLAIN).split()
        line = f" {b' '.join(words).decode(errors='surrogatepass')} "
        found = self.chosen(self.matches(line))
        if not found:
            return len(words), []
        out, at, number = [], 0, -1
        for start, end, k, edits in found:
            number += line.count(" ", at, start)
            at = start
            out.append({"label": self.notices[k].label, "notice": self.notices[k].words, "base": self.notices[k].base and not edits, "edits": edits, "first_word": number, "last_word": number + line.count(" ", start, end)})
        wanted = {x for f in out for x in (f["first_word"], f["last_word"])}
        spans = {i: m.span() for i, m in enumerate(WORD.finditer(text)) if i in wanted}
        return len(words), [f | {"start": spans[f["first_word"]][0], "end": spans[f["last_word"]][1]} for f in out]


_scanners: dict[tuple[Notice, ...], Scanner] = {}


def scanner(notices: tuple[Notice, ...]) -> Scanner:
    """One for each worker process."""
    if notices not in _scanners:
        _scanners[notices] = Scanner(notices)
    return _scanners[notices]


def scan(df: DataFrame, columns: list[Column], schema: str, text_col: str = "text", notices: tuple[Notice, ...] = BASE + MORE) -> DataFrame:
    """Scan every whole text: the given columns (``schema`` names them), ``n_words`` and ``found``, by start."""
    bound_batches(df.sparkSession)
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        read = scanner(notices).scan
        done = [read(t or "") for t in batch.column(len(names)).to_pylist()]
        return {n: batch.column(k) for k, n in enumerate(names)} | {"n_words": [n for n, _ in done], "found": [f for _, f in done]}

    return map_rows(df, [*columns, F.col(text_col).cast("string").alias("body__")], run, f"{schema}, n_words bigint, found {FOUND}")


def label_text(found: Column) -> Column:
    """The distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def score(found: Column) -> Column:
    """Of the best match: 1 less edits by characters of the notice; 0 without a match."""
    return F.coalesce(F.array_max(F.transform(found, lambda f: 1 - f["edits"] / F.length(f["notice"]))), F.lit(0.0))
