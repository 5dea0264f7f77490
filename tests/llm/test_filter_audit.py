"""The filter audit against a simulation of every order, on rows with nulls, copies and repeats."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from veilgrid.llm import filter_audit

LONG = " ".join(f"w{k}" for k in range(230))
TEXTS = [None, "", LONG, LONG, "a b " * 150, "a b " * 150, LONG + " #", "SHOUT " + LONG.upper(), "x y z", "x y z", " no-break é", "\t\n", LONG]
ROWS = [(k, t, f"s{k % 2}" if k % 3 else None, "clash", 1, 2) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (None, LONG, "s1", "c", 1, 2), (None, LONG, "s1", "c", 1, 2), (None, None, "", "c", 1, 2), (2, "x y z", "s0", "c", 1, 2)]
LABELS = [(0, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, None, 1), (9, 1, 0), (None, 1, 1), (500, 1, 1)]


def failing(rows):
    """The set of failed filters of each row."""
    out = []
    for name, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = name is not None and any(r[0] is not None and r[0] < name and (r[1] or "") == t for r in rows)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), earlier)
        out.append({c for c, bad in zip("ABCDE", tests, strict=True) if bad})
    return out


def simulated(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    fails, out, totals = failing(rows), {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[2] or "" for r in rows}:
            left = [k for k, r in enumerate(rows) if (r[2] or "") == part]
            everyone = left
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in fails[k]]
                left = [k for k in left if c not in fails[k]]
                all_failing = sum(c in fails[k] for k in everyone)
                out[part, order, step] = [len(left), len(gone), all_failing - len(gone), sum(fails[k] == {c} for k in everyone), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
                totals[part, c] = totals.get((part, c), 0) + len(gone)
    return {key: (*v, totals[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string, part string, n int, fails int").withColumns({"id": F.lit(1), "name": F.lit("x"), "body": F.lit("y"), "good": F.lit(3)})
    return docs, spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(7))


def test_audit_equals_a_simulation(spark):
    docs, labels = tables(spark)
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit_documents(docs, labels).collect()}
    assert got == simulated(ROWS, LABELS)
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    unlabelled = filter_audit.audit_documents(docs, labels.limit(0)).agg(F.sum(F.col("good_lost") + F.col("toxic_lost")), F.count("*")).first()
    assert tuple(unlabelled) == (0, 3 * 600)


def test_intersections_and_dividends(spark):
    docs, labels = tables(spark)
    joint = filter_audit.joint_failures(filter_audit.flagged(docs, labels), 5, {"documents": F.col("n")})
    fails = failing(ROWS)
    for r in filter_audit.interactions(joint).collect():
        sets = [f for f, row in zip(fails, ROWS, strict=True) if (row[2] or "") == r["part"]]
        wanted = set(r["filters"])
        assert r["joint"] == sum(wanted <= f for f in sets) and r["exactly"] == sum(wanted == f for f in sets)
        removed = {p: sum(bool(f & set(p)) for f in sets) for n in range(6) for p in itertools.combinations("ABCDE", n)}
        dividend = sum((-1) ** (len(wanted) - len(p)) * v for p, v in removed.items() if set(p) <= wanted)
        assert r["dividend"] == dividend


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", 0b011, 2), ("p", 0b100, 1), ("p", 0, 3)], "part string, fails int, n int")
    joint = filter_audit.joint_failures(rows, 3, {c: F.col("n") for c in ("documents", "good", "toxic")})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit.audit(joint, "xyz").collect()}
    assert len(got) == 18 and got["xyz", 1] == (4, 2, 6) and got["xyz", 2] == (4, 0, 6) and got["xyz", 3] == (3, 1, 6)
