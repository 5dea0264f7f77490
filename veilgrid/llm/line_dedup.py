"""Line dedup: maximal repeated runs of lines lose their later copies, found with a suffix array.

The corpus is one sequence of line ids, document after document, and a suffix begins at every
line. Suffixes are ranked by distributed prefix doubling: ranks by the first line, then by
pairs of ranks 1, 2, 4, ... lines apart, each round one grouping of pairs, one range sort that
gives the groups their ranks in order, and one join back. A suffix whose rank nobody
shares has no repeated run of that length and leaves; what is left, sorted by rank, is the part of the
suffix array that holds repetitions. Rounds end when all have left or when runs are longer
than ``min_words`` lines, which is deeper than any run that has to be looked up.

Suffixes with the same first n lines are an interval of the array whose common prefix is n
lines or longer. It is named by n and the ranks of its two halves of a power of two
lines, which may overlap. Within an interval the first copy is the one of least place; the others go.

A line goes if it lies in a run of ``min_words`` words or more that also occurs earlier.
It is enough to look at two runs for each line: the shortest one of that many words that
begins there, and the shortest one that ends there. Any longer repeated run is covered by
such runs inside it, which repeat at the same place; so the union of the repeated shortest
runs is the union of the maximal repeated runs.

Order is by id (null first), then by the text's hash, then by line. Lines are compared
without white space at their ends; lines without words neither count nor separate, and
go only from inside a deleted run.

Cases: null and empty texts stay as they are; rows that repeat id and text are one
document, and each gets that document's result; runs may repeat within a document and
overlap themselves; other columns pass through (``kept_lines``, ``deleted_lines`` and
``deleted_runs`` are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, discard, map_rows, materialize, working_for

#: Documents that a task remembers, so as not to emit repeated rows again.
REMEMBERED = 1_000_000


def word_lines(text: str) -> tuple[list[str], list[int], list[int]]:
    """All lines, the places of those with words, and their numbers of words."""
    lines = text.split("\n")
    counts = [len(x.split()) for x in lines]
    places = [k for k, n in enumerate(counts) if n]
    return lines, places, [counts[k] for k in places]


def shortest_runs(counts: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each run of ``min_words`` words that is shortest from its begin or to its end."""
    total = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    begin = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words) - 1
    forward = end < n
    last = np.arange(n)
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    backward = first >= 0
    both = np.unique(np.concatenate([begin[forward] * n + end[forward], first[backward] * n + last[backward]]))
    return np.divmod(both, max(n, 1))


def _lines(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """All lines of documents that are long enough: place (``id, mark, line``), id of the line (``a, b``), and the
    ``lengths`` in lines of the runs to look up that begin there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"id {dict(df.dtypes)[id_col]}, mark bigint, line int, a bigint, b bigint, lengths array<int>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("veilgrid.llm.line_dedup")
        seen: set[tuple] = set()
        for batch in batches:
            rows, places, prints, sizes, values = [], [], [], [], []
            for row, (key, mark, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if (key, mark) in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add((key, mark))
                lines, at, counts = word_lines(text or "")
                first, last = shortest_runs(counts, min_words)
                if len(first):
                    rows.append(np.full(len(at), row))
                    places.append(np.arange(len(at)))
                    prints.append(b"".join(xxhash.xxh3_128_digest(lines[k].strip()) for k in at))
                    sizes.append(np.bincount(first, minlength=len(at)))
                    values.append(last - first + 1)
            whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            at, names = pa.array(whole(rows)), np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            lengths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole(sizes))]), pa.int32()), pa.array(whole(values), pa.int32()))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(whole(places), pa.int32()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), lengths]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    body = F.col(text_col).cast("string")
    return df.select(F.col(id_col), F.xxhash64(body), body).mapInArrow(run, schema)


def _ranks(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """A rank for each combination of ``keys`` that two suffixes or more share, in the order of the keys."""
    shared = suffixes.groupBy(*keys).count().where("count > 1").select(*keys)
    return materialize(shared.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("next", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame, longest: int) -> list[tuple[int, DataFrame]]:
    """By prefix doubling, for 1, 2, 4, ... lines up to ``longest``: the suffixes that share so many first lines with
    another one (``id, mark, line, lengths``) and their ``rank`` in the order of these lines."""
    place = ["id", "mark", "line"]
    by_document = Window.partitionBy("id", "mark").orderBy("line")
    ranks = _ranks(lines, ["a", "b"])
    alive = materialize(lines.join(ranks, ["a", "b"]).select(*place, "lengths", F.col("next").alias("rank")), "suffixes")
    discard(ranks)
    out, size = [(1, alive)], 1
    while 2 * size <= longest:
        ahead = F.first("rank").over(by_document.rangeBetween(size, size))
        pairs = materialize(alive.withColumn("ahead", ahead).where("ahead is not null"), "pairs")
        ranks = _ranks(pairs, ["rank", "ahead"])
        if ranks.isEmpty():
            break
        alive = materialize(pairs.join(ranks, ["rank", "ahead"]).select(*place, "lengths", F.col("next").alias("rank")), "suffixes")
        discard(pairs, ranks)
        size *= 2
        out.append((size, alive))
    return out


def _runs(size: int, suffixes: DataFrame) -> DataFrame:
    """The runs of ``size`` to 2 * size - 1 lines that are to be looked up, with the ranks of their halves."""
    near = F.collect_list(F.struct("line", "rank")).over(Window.partitionBy("id", "mark").orderBy("line").rangeBetween(0, size - 1))
    lengths = F.filter("lengths", lambda n: (n >= size) & (n < 2 * size))
    rows = suffixes.withColumn("near", near).withColumn("n", F.explode(lengths))
    end = F.get(F.filter("near", lambda x: x["line"] == F.col("line") + F.col("n") - size), F.lit(0))
    last = (F.col("line") + F.col("n") - 1).cast("int")
    return rows.withColumn("other", end["rank"]).where("other is not null").select("n", "rank", "other", "id", "mark", F.col("line").alias("first"), last.alias("last"))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The later copies of repeated runs: ``id, mark, first, last`` (in lines with words), ``leader`` (the first copy's place)."""
    bound_batches(df.sparkSession)
    lines = materialize(_lines(df, id_col, text_col, min_words), "lines")
    levels = suffix_ranks(lines, min_words)
    discard(lines)
    runs = _runs(*levels[0])
    for level in levels[1:]:
        runs = runs.unionByName(_runs(*level))
    interval = ["n", "rank", "other"]
    runs = materialize(runs, "runs")
    discard(*(suffixes for _, suffixes in levels))
    place = F.struct("id", "mark", "first")
    leaders = runs.groupBy(*interval).agg(F.min(place).alias("leader"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return runs.join(materialize(leaders, "leaders"), interval).where(~place.eqNullSafe(F.col("leader"))).select("id", "mark", "first", "last", "leader")


def delete_later_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The rows of ``df`` with later copies deleted from the text.

    Adds ``kept_lines`` and ``deleted_lines`` (lines with words) and ``deleted_runs``:
    ``first:last`` of each deleted stretch in lines of the old text, comma-joined.
    """
    later = repeated_runs(df, id_col, text_col, min_words)
    spans = later.groupBy(F.col("id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    body = F.col(text_col).cast("string")
    added = ("kept_lines", "deleted_lines", "deleted_runs")
    others = [c for c in df.columns if c != text_col and c not in added]
    rows = df.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    found = rows.join(spans, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of_id")), "left")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"body": [], "kept_lines": [], "deleted_lines": [], "deleted_runs": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for k, v in zip(out, cut(text, [(s["first"], s["last"]) for s in spans or ()]), strict=True):
                out[k].append(v)
        return out | {"row": batch.column(0)}

    kind = rows.schema["row"].dataType.simpleString()
    done = map_rows(found, [F.col(c) for c in ("row", "body", "spans")], run, f"row {kind}, body string, kept_lines int, deleted_lines int, deleted_runs string")
    return done.select(*(F.col("body").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c not in added), *added)


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[str | None, int, int, str]:
    """The text without the spans, lines kept, lines deleted, deleted stretches."""
    if not text:
        return text, 0, 0, ""
    lines, places, _ = word_lines(text)
    gone = np.zeros(len(lines) + 1, np.int64)
    for first, last in spans:
        gone[places[first]] += 1
        gone[places[last] + 1] -= 1
    dead = np.cumsum(gone)[:-1] > 0
    if not dead.any():
        return text, len(places), 0, ""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], dead, [0]])))
    lost = int(dead[places].sum())
    stretches = ",".join(f"{a}:{b - 1}" for a, b in zip(edges[::2], edges[1::2], strict=True))
    return "\n".join(x for x, d in zip(lines, dead, strict=True) if not d), len(places) - lost, lost, stretches
