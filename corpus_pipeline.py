"""From documents to tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from veilgrid.llm.common import in_remainder, labelled_sample, materialize, read_table
from veilgrid.llm.queries import LEARNED_ROWS, TOXIC_FROM, tokenizer_path


def mark() -> Column:
    """Names a text beside its id."""
    return F.xxhash64(F.col("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def matched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each of the ``wanted`` documents (``of_id, of_mark`` and others) once, with all columns of both."""
    name = fresh(docs, "mark")
    own = {c: fresh(docs, c) for c in wanted.columns}
    named = wanted.select(*(F.col(c).alias(n) for c, n in own.items()))
    both = docs.withColumn(name, mark()).join(named, (F.col(name) == F.col(own["of_mark"])) & F.col("doc_id").eqNullSafe(F.col(own["of_id"])))
    return both.dropDuplicates(["doc_id", name]).drop(name, own["of_id"], own["of_mark"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.

    Null and empty texts score what a text without a match scores; without usable labels every text
    scores 0 and stays; repeated rows share their fate; other columns pass through.
    """
    labels = read_table(spark, sf_dir, "labels").where(~in_remainder(F.col("doc_id"), 4, 2))
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", LEARNED_ROWS), F.col("label__"), F.col("doc_id"))
    row = F.struct(*docs.columns).alias("row")
    scored = toxicity.score(docs, model, [row], f"row {docs.schema.simpleString()}")
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else was left.

    Null and empty texts stay; rows that repeat id and text are one document; the first
    copy is that of least id, null first; ``n_chars`` follows the text.
    """
    cut = line_dedup.delete_later_copies(docs)
    left = cut.where((F.col("kept_lines") > 0) | (F.col("deleted_lines") == 0))
    return left.withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays; documents without words stay.

    Of a smallest id that several texts share, or a null one, the text of smallest hash stays; rows that
    repeat id and text stay once.
    """
    groups = ngram_join.similar(docs, words=5, num=4, den=5).where("n_shingles > 0")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("row")).select(F.col("row.doc_id").alias("of_id"), F.col("row.mark").alias("of_mark"))
    has_words = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    return matched(docs.where(has_words), first).select(*docs.columns).unionByName(docs.where(~has_words))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them.

    A null source is one of its own; documents without words have no size and are not taken;
    of rows that repeat id and text one stands for all, as often as they are taken together.
    """
    name = fresh(docs, "mark")
    drawn = mixing.mix(docs.withColumn(name, mark()), ["doc_id", name])
    taken = drawn.groupBy("doc_id", name).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    copies = fresh(docs, "copies")
    found = matched(docs, taken.select(F.col("doc_id").alias("of_id"), F.col(name).alias("of_mark"), "copies"))
    return found.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to; a null text is an empty one."""
    return bpe.encode_decode(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL cannot express the learned, sampled and merged stages; their operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
