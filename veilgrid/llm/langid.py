"""Language identification by compression.

Every language has a zstandard dictionary of raw content: the words that most of its
sampled documents use, the commonest last, where a match is cheapest. A text, reduced to
its letters in lower case, is compressed with the dictionary of each language, and the
smallest size wins. Texts are cut into pieces of a few thousand bytes, each compressed on
its own, so that the whole text weighs in the choice and not only its beginning.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every text if
nothing could be learned; ties go to the language with more training rows, then by name;
rows with a null label or a null text are not learned from; repeated rows each get their
row; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, map_rows

UNDETERMINED = "und"
#: A raw dictionary has so many bytes at least.
LEAST_BYTES = 8
LETTER = regex.compile(r"\p{L}")
BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """The words of a text in lower case, a space between them."""
    return " ".join(BETWEEN.split(text.lower()))


@dataclass(frozen=True)
class LanguageModel:
    """``dictionaries``: raw content for each language, languages by falling number of rows."""

    dictionaries: tuple[tuple[str, bytes], ...]
    piece_bytes: int = 4096
    #: Bytes by which the runner-up must be larger for each 100 bytes of the best.
    least_margin: float = 1.0


def fit(df: DataFrame, label: Column, text_col: str = "text", rows_per_language: int = 2000, dictionary_bytes: int = 8192) -> LanguageModel:
    """Learn from about ``rows_per_language`` different texts of each label, of any length.

    The texts are drawn by their hash, by the number of different texts of the label, so a rerun
    learns the same, copies of a text count once, and every label whose texts have a word gets a
    dictionary: its text of smallest hash is always drawn. What comes to the driver is counts
    and a dictionary for each label.
    """
    bound_batches(df.sparkSession)
    rows = df.select(label.cast("string").alias("label"), F.col(text_col).cast("string").alias("body")).where("label is not null")
    usable = rows.where("length(body) > 0").withColumn("mark", F.xxhash64("body"))
    told = usable.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("mark").alias("texts"), F.min("mark").alias("least")).collect()
    if not told:
        return LanguageModel(())
    counts = {r["label"]: r["rows"] for r in told}
    of_label = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair)), F.col("label"))
    share = of_label({r["label"]: min(1.0, rows_per_language / max(1, r["texts"])) for r in told})
    drawn = (F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20)) | (F.col("mark") == of_label({r["label"]: r["least"] for r in told}))
    sample = usable.where(drawn).groupBy("label", "mark").agg(F.first("body").alias("body"))

    def words(batch: pa.RecordBatch) -> dict:
        seen: Counter[tuple[str, str]] = Counter()
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.update((name, w) for w in set(letters(text).split()))
        return {"label": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}

    total = map_rows(sample, [F.col("label"), F.col("body")], words, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    common = total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= dictionary_bytes // 2)
    chosen: dict[str, list[str]] = {}
    for r in common.orderBy("label", "place").collect():
        chosen.setdefault(r["label"], []).append(r["word"])
    made = []
    for name in sorted(chosen, key=lambda x: (-counts[x], x)):
        content = (" " + " ".join(chosen[name][::-1]) + " ").encode()[-dictionary_bytes:]
        made.append((name, content.rjust(LEAST_BYTES)))
    return LanguageModel(tuple(made))


@functools.lru_cache(maxsize=2)
def compressors(model: LanguageModel) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """Prepared once for each worker process; short matches count, as words are short."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=16, hash_log=15, chain_log=15, write_content_size=0, write_dict_id=0
    )
    out = []
    for name, content in model.dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """Language, score, and whether the margin is too narrow to rely on."""
    if text is None or not model.dictionaries or not LETTER.search(text):
        return UNDETERMINED, 0.0, True
    data = letters(text).encode()
    pieces = [data[i : i + model.piece_bytes] for i in range(0, len(data), model.piece_bytes)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in compressors(model)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    heat = max(1.5, 0.01 * sizes[best])
    score = 1 / sum(math.exp((sizes[best] - s) / heat) for s in sizes)
    margin = min((s - sizes[best] for k, s in enumerate(sizes) if k != best), default=math.inf)
    return model.dictionaries[best][0], score, margin * 100 < model.least_margin * sizes[best]


def identify(df: DataFrame, model: LanguageModel, columns: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """Predict every whole text: the given columns (``schema`` names them), ``lang_pred``, ``score``, ``rejected``.

    ``rejected`` marks narrow margins; ``lang_pred`` is then still the best language.
    """
    bound_batches(df.sparkSession)
    names = [x.split()[0].strip("`") for x in schema.split(",")]

    def run(batch: pa.RecordBatch) -> dict:
        found = [classify(model, t) for t in batch.column(len(names)).to_pylist()]
        return {n: batch.column(k) for k, n in enumerate(names)} | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]}

    return map_rows(df, [*columns, F.col(text_col).cast("string").alias("body__")], run, schema + ", lang_pred string, score double, rejected boolean")
