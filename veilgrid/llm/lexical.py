"""Ranked lexical search by sort-based accumulation.

The items come in blocks of bounded size. For a block, one pass over the documents keeps
what its terms do there: each document's number of terms, the block's terms in it and how
often they occur. Document frequencies and lengths are summed up from that table. In a second pass every
split is a range of documents of its own. It concatenates arrays of packed (item, document)
keys with the impact that one term gives, puts them in order by radix sort of 16-bit
digits, and sums up equal keys with ``reduceat``; a heap for each item keeps its best. At most
``k`` documents an item leave a task. They meet in two steps, first within groups of tasks, so
that no task sees all of them.

Cases: a null or empty text has no term and is not counted; null ids come after all others of the same
score; repeated documents are documents of their own; the terms of an item are those of all
rows with its id, once each; rows with a null item id and items without terms give no rows;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import PLAIN, bound_batches, discard, map_rows, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of terms in a block of items (one item may have more), pairs that are sorted together, groups of tasks.
BLOCK_CHARS, TOGETHER, GROUPS = 8 << 20, 1 << 21, 64
#: Fixed values of the score.
SCALE, LENGTH_SHARE, LENGTH_FACTOR = 1_000_000_000, 50, 20


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, term``, each pair once."""
    lowered = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    return items.select(F.col(item_col).cast("long").alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).where("item is not null").distinct()


class Block:
    """The terms of a block of items, with the items of each: ``owners[first[t]:first[t + 1]]``."""

    def __init__(self, pairs: list[tuple[int, str]]):
        self.items = sorted({i for i, _ in pairs})
        number = {i: k for k, i in enumerate(self.items)}
        self.terms = {t.encode(): k for k, t in enumerate(sorted({t for _, t in pairs}))}
        term = np.array([self.terms[t.encode()] for _, t in pairs], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.owners = np.array([number[i] for i, _ in pairs], dtype=np.int64)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])


def postings(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document that has a term: n terms in all, and those of ``terms`` with how often they occur."""

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "counts": []}
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = text.translate(PLAIN).split() if text else []
            if words:
                seen = Counter(words)
                both = [w for w in seen if w in terms]
                out["doc_id"].append(name)
                out["n"].append(len(words))
                out["terms"].append(np.array([terms[w] for w in both], dtype=np.int32))
                out["counts"].append(np.array([seen[w] for w in both], dtype=np.int32))
        return out

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body")]
    return map_rows(docs, columns, read, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in table.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def length_terms(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """m of each length; in Python's integers where 64 bits could overflow."""
    wide = int(n.max(initial=0)) * LENGTH_SHARE * count >= 1 << 63
    part = np.array([int(x) * LENGTH_SHARE * count // total for x in n], dtype=np.int64) if wide else n * LENGTH_SHARE * count // total
    return 100 - LENGTH_SHARE + part


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, by 16-bit digits from the lowest; numpy sorts these by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift, most = 16, int(keys.max(initial=0))
    while most >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, with the sums of their impacts."""
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(impacts[order], starts) if len(starts) else impacts[:0]


class Best:
    """A heap for each item with its ``k`` best documents: score, whether there is an id, minus the id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        #: The score that a document needs to come into the heap.
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Items in order, each with documents that are not in the heaps yet."""
        good = np.flatnonzero(score >= self.least[item])
        order = good[np.lexsort((ids[good], ~known[good], -score[good], item[good]))]
        begins = np.flatnonzero(np.diff(item[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
        best = order[place < self.k]
        for i, s, is_known, name in zip(item[best].tolist(), score[best].tolist(), known[best].tolist(), ids[best].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, is_known, -name)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def scored(table: DataFrame, block: Block, weights: np.ndarray, count: int, total: int, k: int) -> DataFrame:
    """The ``k`` best of each task for each item: ``item_id, doc_id, score, task_group``."""
    owners, first, items = block.owners, block.first, block.items

    def pairs(terms: np.ndarray, counts: np.ndarray, m: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed keys item * rows + row and the impacts, summed up."""
        impact = weights[terms] * (SCALE * counts // (1000 * counts + LENGTH_FACTOR * m[row]))
        fan = first[terms + 1] - first[terms]
        before = np.cumsum(fan) - fan
        owner = owners[np.repeat(first[terms] - before, fan) + np.arange(int(fan.sum()))]
        return accumulate(owner * rows + np.repeat(row, fan), np.repeat(impact, fan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            names = batch.column(0)
            known = names.is_valid().to_numpy(zero_copy_only=False)
            ids = names.fill_null(0).to_numpy()
            m = length_terms(batch.column(1).to_numpy(), count, total)
            lists = batch.column(2)
            terms, counts = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)
            sizes = lists.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            grown = np.concatenate([[0], np.cumsum(first[terms + 1] - first[terms])])[ends]
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(grown, grown[low] + TOGETHER, "right")) - 1)
                part, rows = slice(ends[low], ends[high]), high - low
                keys, sums = pairs(terms[part], counts[part], m[low:high], np.repeat(np.arange(rows), sizes[low:high]), rows)
                item, row = np.divmod(keys, rows)
                best.add(item, sums, ids[low + row], known[low + row])
                low = high
        out = [(items[i], -name if is_known else None, s) for i, heap in enumerate(best.heaps) for s, is_known, name in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], type=pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    found = table.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    return found.withColumn("task_group", F.spark_partition_id() % GROUPS)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    bound_batches(spark)
    pairs = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = math.ceil((pairs.agg(F.sum(F.length("term"))).first()[0] or 0) / BLOCK_CHARS)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for number in range(blocks):
        block = Block([tuple(r) for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toLocalIterator()])
        table = materialize(postings(docs, block.terms, id_col, text_col), "postings")
        count, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in frequencies(table, len(block.terms)).tolist()], dtype=np.int64)
        found = scored(table, block, weights, count, total, k)
        for keys in (["item_id", "task_group"], ["item_id"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            found = found.withColumn("rank", place).where(F.col("rank") <= k)
        best = materialize(found.select("item_id", "rank", "doc_id", "score"), "ranked")
        discard(table)
        out = out.unionByName(best)
    discard(pairs)
    return out
