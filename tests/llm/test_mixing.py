import math
from collections import Counter, defaultdict

import pytest

from pulsegrid.llm import mixing as M


def corpus(documents, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 4), None, source))
            i += 1
    return documents(rows)


def test_repeat_limit_loses_nothing_and_meets_weights(documents):
    docs = corpus(documents, {"a": 400, "b": 60, "c": 20})
    emitted, sources = M.mix(docs, repeat_limit=3.0)
    weight = {r.source: (r.weight, r.tokens, r.quota) for r in sources.collect()}
    rows = emitted.collect()
    dealt = Counter()
    for r in rows:
        dealt[r.source] += r.n_tokens
    total = sum(dealt.values())
    assert math.isclose(sum(w for w, _, _ in weight.values()), 1.0)
    for s, (w, tokens, quota) in weight.items():
        assert quota <= dealt[s] < quota + 4 and abs(dealt[s] / total - w) < 0.02
        assert 1 - 1e-6 <= quota / tokens + 1e-2 and quota / tokens <= 3.0 + 1e-6
    assert math.isclose(weight["c"][2] / weight["c"][1], 3.0, rel_tol=0.02)
    assert {r.doc_id for r in rows} == set(range(480))
    # Every block of all sources together has the weights, up to a document per source.
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r.block][r.source] += r.n_tokens
    assert set(blocks) == set(range(64))
    assert all(abs(b["a"] - weight["a"][2] / 64) <= 4 for b in blocks.values())
    # A pass takes each document once, in another order than the next pass.
    first = [r.doc_id for r in rows if r.source == "c" and r["pass"] == 0]
    assert sorted(first) == list(range(460, 480))


def test_mixed_documents_are_written_in_the_mixture_s_order(documents, spark, tmp_path):
    docs = corpus(documents, {"a": 300, "b": 100, "c": 20})
    emitted = M.mix(docs)[0].collect()
    M.mixed_documents(docs).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    got = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(files) > 1 and got == [r.doc_id for r in sorted(emitted, key=lambda r: (r.block, r["rank"]))]


def test_entropy_target(documents):
    docs = corpus(documents, {"a": 300, "b": 30, "c": 3})
    _, sources = M.mix(docs, entropy=1.0)
    w = [r.weight for r in sources.collect()]
    assert math.isclose(-sum(x * math.log(x) for x in w), 1.0, abs_tol=1e-6)


def test_budget_takes_part_of_a_pass(documents):
    emitted, _ = M.mix(corpus(documents, {"a": 300, "b": 100}), repeat_limit=1.0, budget=200)
    rows = emitted.collect()
    assert 200 <= sum(r.n_tokens for r in rows) < 208 and len({r.doc_id for r in rows}) == len(rows)


def test_edge_cases(documents, clashing):
    with pytest.raises(ValueError):
        M.mix(documents([(1, "a")]), repeat_limit=0.5)
    docs = clashing(documents([(1, "a b", None, None), (1, "a b", None, None), (2, None, None, "x"), (3, "", None, "x"), (None, "c " * 20_000, None, "y")]))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert set(got) == {(1, None), (2, "x"), (3, "x"), (None, "y")} and got[2, "x"] == got[3, "x"] == got[None, "y"] == 1
    assert got[1, None] % 2 == 0
    assert M.mixed_documents(documents([])).count() == 0
