"""Audit of how quality filters interact, by inclusion and exclusion.

Every document gets one flag for each filter that it fails. For each of the 2^k sets of
filters, the product of the flags is summed up over the documents of a part: the joint
failures J(S). Nothing else is gathered, and all that is reported follows from these sums:

* documents kept by a set P of filters: the sum of (-1)^|S| J(S) over the subsets S of P, so
  what a filter removes at its place in an order is a difference of two of them;
* documents whose failures are exactly T (Moebius inversion): the sum of (-1)^(|S|-|T|) J(S) over
  the sets S that contain T; for T of one filter these are its unique failures;
* redundant failures of a filter at its place: J of it, less what it removes there;
* Shapley values: the game "documents removed" has the Harsanyi dividends (-1)^(|S|+1) J(S), and a
  filter gets 1/|S| of each dividend of a set that holds it. Times k! it is whole, the sum
  over all orders of what the filter removes.

Whether a smaller id has the same text is told without bringing copies together: texts get a
256-bit name, the least id of each name is pre-aggregated, and a document fails if its id is
not that least one. Rows that repeat id and text are counted before they move.

Cases: a null text is an empty one (no words: it fails A, not B or C, nor D); copies are those
of equal text, empty ones too; rows that share text and least id all count as the first; a
null id is neither smaller nor larger than another, so such rows never fail E, and have no
label; labels of one id are joined by "any of them is 1"; a null source is the part of the
empty string, along with that source; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import materialize

#: Fixed values of the five filters.
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
NAMES = "ABCDE"


def own_failures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and ``fails``: bits 0 to 3 for the filters A to D, which look at a text alone.

    Few words, few distinct words, many capitals, rare signs. ``df`` has no column of the names used here.
    """
    text = F.col(text_col)
    worded = df.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failing = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_UPPER * F.length(text), text.rlike(SIGNS))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)]
    return worded.withColumn("fails", sum(bits[1:], bits[0])).drop("words")


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, fails`` (bits of the failed filters A to E), ``n`` rows of this kind, and ``good, toxic`` (0 or 1) by the labels."""
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    named = own_failures(whole, "body").withColumn("name", F.unhex(F.sha2("body", 256))).drop("body")
    table = materialize(named.groupBy("id", "part", "name", "fails").agg(F.count("*").alias("n")), "audited")
    first = table.where("id is not null").groupBy("name").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    is_copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    rows = table.join(first, ["name", "id"], "left").select("id", "part", (F.col("fails") + F.when(is_copy, 1 << NAMES.index("E")).otherwise(0)).alias("fails"), "n")
    is_one = lambda c: F.max(F.when(F.col(c).cast("int") == 1, 1).otherwise(0))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = rows.where("id is not null").join(marks, "id", "left").unionByName(rows.where("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    return marked.select("part", "fails", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def joint_failures(rows: DataFrame, filters: int, measures: dict[str, Column]) -> DataFrame:
    """One row a part: for each measure an array of 2^filters sums, at place S the joint failures of the set of bits S.

    The product of a set's flags is 1 where all its bits are set in ``fails``.
    """
    sums = {}
    for name, value in measures.items():
        products = [F.when(F.col("fails").bitwiseAND(s) == s, value).otherwise(0).cast("long") for s in range(1 << filters)]
        sums[name] = F.array(*map(F.sum, products)).alias(name)
    return rows.groupBy("part").agg(*sums.values())


def _signed(joint: Column, size: Column, body) -> Column:
    """The sum over all sets S of ``body(S, J(S), (-1)^|S|)``."""
    sign = lambda s: F.when(F.bit_count(s) % 2 == 0, 1).otherwise(-1)
    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0).cast("long"), lambda total, s: total + body(s, F.get(joint, s), sign(s)))


def kept_by(joint: Column, filters: int) -> Column:
    """For each set of filters how many documents fail none of it."""
    size = F.lit(1 << filters)
    within = lambda p: _signed(joint, size, lambda s, j, sign: F.when(s.bitwiseAND(p) == s, sign * j).otherwise(0))
    return F.transform(F.sequence(F.lit(0), size - 1), within)


def exactly(joint: Column, filters: int) -> Column:
    """For each set of filters how many documents fail those of it and no others."""
    size = F.lit(1 << filters)
    inverse = lambda t: _signed(joint, size, lambda s, j, sign: F.when(s.bitwiseAND(t) == t, sign * F.when(F.bit_count(t) % 2 == 0, j).otherwise(-j)).otherwise(0))
    return F.transform(F.sequence(F.lit(0), size - 1), inverse)


def shapley(joint: Column, filters: int) -> Column:
    """For each filter its Shapley value of "documents removed", times ``filters`` factorial."""
    shares = F.array(*(F.lit(0 if n == 0 else math.factorial(filters) // n) for n in range(filters + 1)))

    def value(f: Column) -> Column:
        bit = F.pow(F.lit(2), f).cast("int")
        return _signed(joint, F.lit(1 << filters), lambda s, j, sign: F.when(s.bitwiseAND(bit) == bit, -sign * j * F.get(shares, F.bit_count(s))).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(filters - 1)), value)


def interactions(joint: DataFrame, names: str = NAMES) -> DataFrame:
    """One row a part and set of filters: ``filters``, ``joint``, ``exactly`` and ``dividend``."""
    k = len(names)
    letters = F.array(*map(F.lit, names))
    member = lambda s: F.array_join(F.filter(letters, lambda x, i: s.bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0), "")
    found = joint.select("part", "documents", exactly(F.col("documents"), k).alias("only")).select("part", "only", F.posexplode("documents").alias("s", "joint"))
    sign = F.when(F.bit_count("s") % 2 == 1, 1).otherwise(-1)
    return found.select("part", member(F.col("s")).alias("filters"), "joint", F.get("only", F.col("s")).alias("exactly"), F.when(F.col("s") > 0, sign * F.col("joint")).otherwise(0).alias("dividend"))


def audit(joint: DataFrame, names: str = NAMES) -> DataFrame:
    """One row a part, order of the filters and step, from the sums of ``joint_failures``.

    ``joint`` has the measures ``documents``, ``good`` and ``toxic``; ``names`` has a letter for each bit.
    """
    k = len(names)
    kept = {c: kept_by(F.col(c), k).alias(f"kept_{c}") for c in ("documents", "good", "toxic")}
    told = joint.select("part", F.col("documents").alias("joint"), *kept.values(), exactly(F.col("documents"), k).alias("only"), shapley(F.col("documents"), k).alias("values"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in itertools.permutations(names)))).alias("filter_order")
    steps = told.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = lambda c: F.instr(F.lit(names), c) - 1
    bit = lambda c: F.pow(F.lit(2), place(c)).cast("int")
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    at = steps.withColumns({"before": F.aggregate(earlier, F.lit(0), lambda total, c: total + bit(c)), "own": bit(letter), "f": place(letter)})
    after = F.col("before") + F.col("own")
    lost = lambda c: F.get(f"kept_{c}", F.col("before")) - F.get(f"kept_{c}", after)
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        F.get("kept_documents", after).alias("kept"), lost("documents").alias("removed"), (F.get("joint", F.col("own")) - lost("documents")).alias("redundant"),
        F.get("only", F.col("own")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("values", F.col("f")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the five filters over whole documents; ``labels`` has the ids, ``quality`` and ``toxic``."""
    return audit(joint_failures(flagged(docs, labels, id_col, text_col, part_col), len(NAMES), {"documents": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}))
