"""The registered queries on a small folder: contract columns against SQL, brute force and libraries."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pandas as pd
import pytest

from tests.llm.conftest import LINES
from veilgrid.llm.queries import ORACLES, QUERIES, tokenizer_path

@pytest.fixture(scope="module")
def docs(folder):
    return pd.read_parquet(folder[0] / "documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folder, name):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for table in ("documents", "labels", "embeddings", "benchmark"):
        pq.write_table(pq.read_table(folder[0] / f"{table}.parquet").slice(0, 0), folder[1] / f"{table}.parquet")
    assert isinstance(pq.read_schema(folder[1] / "documents.parquet"), pa.Schema)
    assert QUERIES[name](spark, str(folder[1])).count() == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_langid", "op8_quality"])
def test_scores(spark, folder, docs, name):
    got = QUERIES[name](spark, str(folder[0])).toPandas().set_index("doc_id")
    mod, rest = (3, 1) if name == "op8_quality" else (4, 2)
    assert sorted(got.index) == sorted(docs.index)
    assert all(got["held_out"][k] == (zlib.crc32(str(k).encode()) % mod == rest) for k in got.index)
    assert got["score"].between(0, 1).all()
    if name == "op3_langid":
        assert set(got["lang_pred"]) <= {"en", "de", "und"} and all(got["lang_pred"][k] == "und" for k in range(3))
    else:
        assert (got["predicted"] == (got["score"] >= (0.3 if name == "op1_toxicity" else 0.5))).all()
    if name == "op1_toxicity":
        marked = docs["text"].fillna("").str.contains("grumpf")
        assert (got["predicted"][marked.index].astype(bool) == marked)[13:].all()


def test_bpe_columns(spark, folder, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op2_bpe"](spark, str(folder[0])).toPandas().set_index("doc_id")
    for k, t in docs["text"].items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got["n_tokens"][k] == len(ids) and got["ids_sha256"][k] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"][k] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_media_columns(spark, folder, docs):
    got = QUERIES["op5_jpeg"](spark, str(folder[0])).toPandas().set_index("doc_id")
    for k, t in docs["text"].items():
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (got["n_bytes"][k], got["payload_bytes"][k]) == (len(data), len(payload))
        assert got["payload_sha256"][k] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"][k] == zlib.crc32(payload[-32:])
    same = got.loc[[3, 4]].drop_duplicates()
    assert len(same) == 1


def test_mixing_columns(spark, folder, docs):
    got = QUERIES["op4_mixing"](spark, str(folder[0])).toPandas().set_index("doc_id").sort_index()
    size = docs["text"].fillna("").map(lambda t: len(t.encode().split()))
    assert (got["size"] == size).all() and (got["taken"] <= 3 * got["size"]).all()
    of = docs["source"].fillna("~")
    weight = dict(zip(sorted(of.unique()), [5, 2, 1, 5], strict=True))
    total, sums, open_, target = size.sum(), size.groupby(of).sum(), dict(weight), {}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s, x in share.items() if x > 3 * sums[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sums[s]
            del open_[s]
    for s, rows in got.groupby(of):
        assert abs(rows["target"].iloc[0] - target[s]) < 1e-6 * total and (rows["source_size"] == sums[s]).all()
        assert abs(rows["taken"].sum() - target[s]) <= size.max()


def test_base_columns_of_secrets(spark, folder, docs):
    from tests.llm.test_operators import base_spans

    got = QUERIES["op9_secrets"](spark, str(folder[0])).toPandas().set_index("doc_id")
    for k, t in docs["text"].items():
        spans = base_spans(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, b, kind in spans)
        assert got["base_sha256"][k] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[f"n_{x}"][k] for x in ("assign", "access", "hex")] == [sum(s[2] == i for s in spans) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(got["spans"][k].split(","))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {table} as select * from '{folder[0]}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(folder[0])).toPandas(), con.sql(ORACLES[name]).df()
    keys = sorted(want.columns)
    same = lambda df: sorted(tuple(x if isinstance(x, str) else -1 if pd.isna(x) else int(x) for x in row) for row in df[keys].values.tolist())
    assert same(got) == same(want)


def test_line_dedup_columns(spark, folder):
    got = QUERIES["op10_line_dedup"](spark, str(folder[0])).toPandas().set_index("doc_id")
    assert got["text"][10] == "other\nend" and got["deleted_lines"][10] == 9 and got["text"][9] == f"own\n{LINES}"
    assert (got["deleted_lines"].drop(index=10) == 0).all()
