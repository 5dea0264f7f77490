"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A text's set holds the 64-bit hashes of its distinct word n-grams, sorted. Equal sets are
one node from the start. Two nodes that link must share one of the first few members of
their sets, whatever order is chosen (the prefix filter); the order here puts members
that fill an overfull bucket of a corpus-wide count last, so that what many documents
share opens no candidates. Nodes that share such a member are a list; lists with the same
smallest and largest node are laid together, as the lists of a group of copies mostly are.

1. Families: a list is cut into size bands and these into tiles of bounded size. Nodes of
   the same band, and of a band and the next, meet in a tile. Sizes, places in the order and
   then the bit counts of hashed bitmaps bound the overlap of a pair from above; a pair that
   may link joins its two nodes, and pairs already joined are skipped. A tile yields at most
   one row less than it has nodes, whatever it holds. What is joined is a family: every
   link lies within one.
2. Links: each family's sorted arrays meet once, in tiles of the same kind. Wider bitmaps
   bound the overlap again, and what passes is intersected exactly; again pairs already
   joined are skipped and a tile yields at most one link less than it has nodes.

The components of the links are the exact ones: each pair that links meets in both steps,
no bound loses it, and nothing is joined in the second step without exact intersection.

Cases: a null text, an empty one and one without words have the empty set, link with
nothing and are their own component; fewer words than ``words`` make one n-gram of the
whole sequence; rows with a null id take part and never name a component (a component
without any id has a null name); repeated rows are equal sets; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import bound_batches, discard, map_rows, materialize, working_for
from veilgrid.llm.components import components
from veilgrid.llm.shingles import sets_of

BUCKET_BITS = 16
#: Rows of either side of a tile, and members of their sets.
BLOCK, BLOCK_MEMBERS = 1024, 1 << 20
#: Bits a member of the bitmaps within a family (in lists they have one or two).
WIDE = 8
#: Names of sets that a task remembers, so as not to emit copies again.
REMEMBERED = 1_000_000


def fingerprint(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed integers; 0, 0 for the empty one."""
    if not len(members):
        return 0, 0
    a, b = np.frombuffer(xxhash.xxh3_128_digest(members.tobytes()), np.int64)
    return int(a), int(b)


def bitmap(members: np.ndarray, each: int = 1) -> np.ndarray:
    """``each`` bits or up to twice as many for each member, in a power of two of bits (64 at least), as uint64."""
    bits = 1 << max(6, (each * len(members) - 1).bit_length())
    marks = np.zeros(bits, np.bool_)
    marks[(members & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) in ``width`` words, by laying their halves over each other."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def least_overlap(a: np.ndarray, b: np.ndarray | int, num: int, den: int) -> np.ndarray:
    """Members that two sets of these sizes share at least if they link."""
    return -((-num * (a + b)) // (num + den))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b|, on sorted arrays."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def joined_pairs(n: np.ndarray, pos: np.ndarray, side: np.ndarray, bits: list[np.ndarray], num: int, den: int, confirm: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs that join the rows of a tile: a spanning forest of those that the bounds leave possible and ``confirm`` confirms.

    ``n`` are sizes, ``pos`` places of the first shared member, ``side`` tells the two halves of a tile
    apart (one half alone meets itself).
    """
    order = np.argsort(n, kind="stable")
    n, room, side = n[order], (n - pos)[order], side[order]
    halves = bool((side != side[0]).any())
    widths = np.array([len(bits[k]) for k in order])
    starts = np.flatnonzero(np.concatenate([[True], widths[1:] != widths[:-1]]))
    classes = [(int(widths[s]), int(s), int(e), np.stack([bits[k] for k in order[s:e]])) for s, e in zip(starts, [*starts[1:], len(n)], strict=True)]
    last = np.searchsorted(n, n * den // num, side="right")
    label = np.arange(len(n))
    out = []
    for k, (width, begin, end, own) in enumerate(classes):
        laid = [(s, e, folded(rows, width)) for _, s, e, rows in classes[k:]]
        for i in range(begin, end):
            for s, e, rows in laid:
                low, high = max(s, i + 1), min(e, int(last[i]))
                if s >= last[i]:
                    break
                if low >= high:
                    continue
                need = least_overlap(n[low:high], int(n[i]), num, den)
                open_ = (label[low:high] != label[i]) & (np.minimum(room[low:high], room[i]) >= need)
                if halves:
                    open_ &= side[low:high] != side[i]
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                mine, theirs = own[i - begin], rows[low - s + at]
                both = mine & theirs
                shared = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                lost_mine = int(np.bitwise_count(mine).sum(dtype=np.int64)) - shared
                lost_theirs = np.bitwise_count(theirs).sum(axis=1, dtype=np.int64) - shared
                at = at[np.minimum(n[i] - lost_mine, n[low + at] - lost_theirs) >= need[at]] + low
                for j in at.tolist():
                    if label[j] != label[i] and (confirm is None or confirm(int(order[i]), int(order[j]))):
                        out.append((int(order[i]), int(order[j])))
                        label[label == label[j]] = label[i]
    return out


def _describe(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Of each row: id, ``mark`` (of its text), ``n``, ``node`` and ``check`` (the fingerprint); and of each
    task a row with n = -1 whose ``counts`` are the members by bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, mark bigint, n bigint, node bigint, check bigint, counts binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("veilgrid.llm.ngram_join")
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sets = sets_of(batch.column(2).to_pylist(), words)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            prints = [fingerprint(s) for s in sets]
            columns = [batch.column(0), batch.column(1), [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], [None] * len(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((None, None, -1, 0, 0, counts.tobytes()), arrow, strict=True)], schema=arrow)

    body = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("body")).mapInArrow(run, schema)


def _bucket_classes(described: DataFrame) -> np.ndarray:
    """How overfull each bucket is, in eighths of a doubling over the mean; the buckets are a fixed number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["bucket", "count"])

    counts = np.zeros(1 << BUCKET_BITS)
    summed = described.where("n = -1").select("counts").mapInArrow(add, "bucket int, count bigint")
    for r in summed.groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        counts[r["bucket"]] = r["count"]
    ratio = counts / max(1.0, counts.mean())
    return np.clip(np.floor(8 * np.log2(np.maximum(ratio, 1.0))), 0, 255).astype(np.uint8)


def apart(rows: DataFrame, twins: DataFrame | None) -> DataFrame:
    """Sets whose first 64 bits agree by chance (``twins``: ``of_node`` and the ``kept`` check) get names of their own."""
    if twins is None:
        return rows
    other = F.col("kept").isNotNull() & (F.col("check") != F.col("kept"))
    named = F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(twins, rows["node"] == twins["of_node"], "left").withColumn("node", named).drop("of_node", "kept")


def _prefixes(df: DataFrame, text_col: str, words: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """``node, check``, the set's size ``n``, its ``bits`` and those ``members``, in order, one of which any linking set shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("veilgrid.llm.ngram_join")
        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            chosen = []
            for members in sets_of(batch.column(0).to_pylist(), words):
                n = len(members)
                node, check = fingerprint(members)
                if not n or node ^ check in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(node ^ check)
                order = np.argsort(classes[(members >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                chosen.append(members[order[: n - -(-num * n // den) + 1]].view(np.int64))
                rows.append((node, check, n, bitmap(members).tobytes()))
            ends = np.cumsum([0, *map(len, chosen)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(chosen) if chosen else np.zeros(0, np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["node", "check", "n", "bits", "members"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "node bigint, check bigint, n int, bits binary, members array<bigint>")


def _arrays(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node``, ``n`` and the sorted ``members`` (bytes) of each of the nodes ``wanted`` (``node``, ``check`` and the ``row`` to take it from)."""
    asked = wanted.select(F.col("row.id").alias("wanted_id"), F.col("row.mark").alias("wanted_mark"), F.col("node").alias("wanted"), F.col("check").alias("wanted_check"))
    body = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("own_id"), F.xxhash64(body).alias("own_mark"), body.alias("body"))
    found = rows.join(asked, (F.col("own_mark") == F.col("wanted_mark")) & F.col("own_id").eqNullSafe(F.col("wanted_id")))

    def run(batch: pa.RecordBatch) -> dict:
        nodes, sizes, bodies = [], [], []
        for w, check, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2).to_pylist(), words), strict=True):
            if fingerprint(s)[1] == check:
                nodes.append(w)
                sizes.append(len(s))
                bodies.append(s.tobytes())
        return {"node": nodes, "n": sizes, "members": bodies}

    return map_rows(found, [F.col(c) for c in ("wanted", "wanted_check", "body")], run, "node bigint, n int, members binary").dropDuplicates(["node"])


def _tiles(rows: DataFrame, key: list[str], num: int, den: int, load: Column) -> DataFrame:
    """``rows`` (``n`` and others) of each key dealt to tiles ``band, cross, a, b``, with the ``side`` they stand on.

    A key whose rows fit a tile is one. Else its size bands are cut into blocks, by rows and by
    ``load`` (members); a block meets itself, the others of its band and those of the next band.
    """
    whole = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(load).alias("load"))
    large = materialize(whole.where((F.col("rows") > BLOCK) | (F.col("load") > BLOCK_MEMBERS)).select(*key), "large")
    zero = [F.lit(0).alias(c) for c in ("band", "cross", "a", "b", "side")]
    small = rows.join(large, key, "left_anti").select("*", *zero)
    band = F.floor(F.ln(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    banded = rows.join(large, key, "left_semi").withColumn("band", band)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(load) / BLOCK_MEMBERS)).cast("int")
    sizes = materialize(banded.groupBy(*key, "band").agg(blocks.alias("own")), "blocks")
    beside = lambda name, step: sizes.select(*key, (F.col("band") + step).alias("band"), F.col("own").alias(name))
    plan = sizes.join(beside("below", 1), [*key, "band"], "left").join(beside("above", -1), [*key, "band"], "left")
    placed = banded.join(plan, [*key, "band"]).withColumn("x", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda band, cross, a, b, side: F.struct(band.alias("band"), F.lit(cross).alias("cross"), a.alias("a"), b.alias("b"), side.alias("side"))
    x = F.col("x")
    same = F.transform(each("own"), lambda y: tile(F.col("band"), 0, F.least(x, y), F.greatest(x, y), (x > y).cast("int")))
    up = F.transform(each("above"), lambda y: tile(F.col("band"), 1, x, y, F.lit(0)))
    down = F.transform(each("below"), lambda y: tile(F.col("band") - 1, 1, y, x, F.lit(1)))
    dealt = placed.select(*rows.columns, F.explode(F.concat(same, up, down)).alias("tile"))
    return small.unionByName(dealt.select(*rows.columns, *(F.col(f"tile.{c}").alias(c) for c in ("band", "cross", "a", "b", "side"))))


def _joined(tiles: DataFrame, key: list[str], num: int, den: int, exact: bool) -> DataFrame:
    """Pairs ``u, v`` of nodes that the tiles join; ``payload`` holds bitmaps, or sorted arrays if ``exact``."""
    names = [*key, "band", "cross", "a", "b"]
    wide = len(names)

    def work(side: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, payload: list[bytes]) -> np.ndarray:
        confirm = None
        held = [np.frombuffer(x, np.uint64) for x in payload]
        if exact:
            bits = [bitmap(x, WIDE) for x in held]
            confirm = lambda i, j: linked(held[i], held[j], num, den)
        else:
            bits = held
        pairs = joined_pairs(n, pos, side, bits, num, den, confirm)
        return node[np.array(pairs, np.int64).reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("veilgrid.llm.ngram_join")
        ints, payload = np.zeros((0, wide + 4), np.int64), []

        def finish(pairs: list[np.ndarray]) -> pa.RecordBatch:
            done = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
            return pa.RecordBatch.from_arrays([pa.array(done[:, k].copy()) for k in (0, 1)], names=["u", "v"])

        def cut(last: bool) -> list[np.ndarray]:
            """Work on all tiles but the last one, which may go on; then on that too."""
            nonlocal ints, payload
            new = np.flatnonzero((ints[1:, :wide] != ints[:-1, :wide]).any(axis=1)) + 1
            begins = [0, *new.tolist()]
            ends = [*begins[1:], len(ints)] if last else begins[1:]
            out = []
            for s, e in zip(begins, ends):  # noqa: B905
                if e - s > 1:
                    out.append(work(*(ints[s:e, wide + k] for k in range(4)), payload[s:e]))
            rest = len(ints) if last else begins[-1]
            ints, payload = ints[rest:], payload[rest:]
            return out

        for batch in batches:
            fresh = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(wide + 4)], axis=1)
            ints, payload = np.concatenate([ints, fresh]), payload + batch.column(wide + 4).to_pylist()
            if len(ints):
                yield finish(cut(False))
        if len(ints):
            yield finish(cut(True))

    columns = [*names, "side", "node", "n", "pos", "payload"]
    links = tiles.repartition(*names).sortWithinPartitions(*names).select(*columns).mapInArrow(run, "u bigint, v bigint")
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar(df: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose n-gram sets have a Jaccard similarity of ``num / den`` or more.

    Returns of each row its id, ``n_shingles`` (set size), ``component_id`` (the smallest
    id reachable by links), ``component`` (its name where ids are null) and ``mark`` (the text's xxhash64).
    """
    bound_batches(df.sparkSession)
    described = materialize(_describe(df, id_col, text_col, words), "sets")
    classes = _bucket_classes(described)
    of_node = described.where("n > 0").groupBy("node").agg(F.min("check").alias("kept"), F.max("check").alias("other")).where("kept <> other")
    chance = materialize(of_node.select(F.col("node").alias("of_node"), "kept"), "twins")
    twins = None if chance.isEmpty() else chance
    docs = apart(described.where("n >= 0").drop("counts"), twins)
    prefixes = materialize(apart(_prefixes(df, text_col, words, num, den, classes), twins), "prefixes")
    postings = prefixes.select("node", "n", F.posexplode("members").alias("pos", "token"))
    ends = materialize(postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "ends")
    lists = materialize(postings.join(ends, "token").groupBy("low", "high", "node").agg(F.first("n").alias("n"), F.min("pos").alias("pos")), "lists")
    bits = prefixes.join(lists.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("bits").alias("payload"))
    tiled = _tiles(lists.join(bits, "node"), ["low", "high"], num, den, F.lit(1))
    possible = materialize(_joined(tiled, ["low", "high"], num, den, exact=False), "possible")
    families = materialize(components(possible).withColumnRenamed("component", "family"), "families")
    discard(ends, lists, prefixes)
    nodes = docs.where("n > 0").groupBy("node").agg(F.min("check").alias("check"), F.min(F.struct("id", "mark")).alias("row"), F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")
    arrays = materialize(_arrays(df, nodes.join(families.select("node"), "node", "left_semi"), id_col, text_col, words), "arrays")
    members = arrays.join(families, "node").select("family", "node", "n", F.lit(0).alias("pos"), F.col("members").alias("payload"))
    links = materialize(_joined(_tiles(members, ["family"], num, den, F.col("n")), ["family"], num, den, exact=True), "links")
    found = components(links)
    discard(arrays, possible)
    named = nodes.select("node", "least", "copies").join(found, "node", "left")
    firsts = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    grouped = named.where("copies > 1 or component is not null").join(firsts, "component", "left")
    told = materialize(grouped.select("node", "component", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first")).alias("first")), "named")
    out = docs.join(told, "node", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("first", "id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("component", "node").alias("component"), "mark",
    )
