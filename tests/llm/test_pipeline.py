"""Every stage of the corpus pipeline against a brute-force version, on a folder with all edge cases."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_deletions, roots, sets_of
from veilgrid.llm.common import materialize, read_table
from veilgrid.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What goes into each stage and what comes out of the last."""
    out = [read_table(spark, str(folder[0]), "documents")]
    out[0] = out[0].unionByName(out[0].where("doc_id = 7"))  # a repeated row
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], str(folder[0])), name.replace(" ", "-")))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").na.fill("").collect())


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_toxic_documents_go(spark, folder, stages):
    clean = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, str(folder[0])).where("predicted = 0").collect()}
    assert rows(stages[1]) == [x for x in rows(stages[0]) if x[0] in clean]
    assert 0 < len(rows(stages[1])) < len(rows(stages[0]))


def test_later_lines_go(stages):
    before = dict(rows(stages[1]))
    keys = sorted(before)
    want = {}
    for key, gone in zip(keys, brute_deletions([before[k] for k in keys], 50), strict=True):
        lines = [x for x in before[key].split("\n") if x.split()]
        left = [x for k, x in enumerate(lines) if k not in gone]
        if left or not gone:
            want[key] = left if gone else None
    got = dict(rows(stages[2]))
    assert got.keys() == want.keys() and any(x is not None for x in want.values())
    assert all([x for x in got[k].split("\n") if x.split()] == left if left is not None else got[k] == before[k] for k, left in want.items())


def test_one_of_each_group_stays(stages):
    before = sorted(dict(rows(stages[2])).items())
    sets = sets_of([t for _, t in before], 5)
    first = roots(sets, 4, 5)
    want = [x for k, x in enumerate(before) if not sets[k] or first[k] == k]
    assert rows(stages[3]) == want and len(want) < len(before)


def test_the_mix_comes_near_its_targets(stages):
    before, after = stages[3].select("doc_id", "source", "text").collect(), Counter(r["doc_id"] for r in stages[4].collect())
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    assert all(after[k] <= 3 for k in after) and all(size[k] for k in after)
    order = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    own = {s: sum(n for k, n in size.items() if source[k] == s) for s in order}
    open_, target, total = dict(zip(order, [5, 2, 1] * len(order), strict=False)), {}, sum(size.values())
    while open_:
        rest = total - sum(target.values())
        over = [s for s in open_ if rest * open_[s] / sum(open_.values()) > 3 * own[s]]
        target |= {s: 3 * own[s] for s in over} if over else {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        open_ = {s: w for s, w in open_.items() if s not in target}
    for s in order:
        assert abs(sum(size[k] * n for k, n in after.items() if source[k] == s) - target[s]) <= max(size.values())


def test_every_document_is_encoded(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    assert all(r["ids"] == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in got)


def test_empty_documents(spark, folder):
    assert corpus_pipeline.run(spark, str(folder[1])).count() == 0
