"""Ranked search against scores worked out for all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pulsegrid.llm.search as search
import pytest
from pulsegrid.llm.search import SearchIndex, _List, _Segment, best_documents, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    """{query number: [(rank, doc_id, score)]} by the formula, over every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q, text in enumerate(queries):
        scored = []
        for i, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out[q] = [(r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus(seed, size, vocabulary=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = [" ".join(draw.choices(words, weights, k=draw.choice([1, 5, 20, 200]))) for _ in range(size)]
    texts[5:9] = [texts[0]] * 4
    return list(enumerate(texts)), [" ".join(draw.choices(words, k=n)) for n in (1, 2, 5, 12, 30)]


def rows_of(segment):
    return [tuple(r.values()) for batch in segment.rows(0) for r in batch.to_pylist()]


def found(spark, docs, queries, k=10):
    asked = spark.createDataFrame([(i, t, "own") for i, t in enumerate(queries)], "item_id int, text string, score string")
    out = SearchIndex.build(docs).search(asked, k).collect()
    result = {i: [] for i in range(len(queries))}
    for r in sorted(out, key=lambda r: (r["item_id"], r["rank"])):
        result[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_all_scores_and_ties(spark, documents, monkeypatch, seed):
    docs, queries = corpus(seed, 400)
    random.Random(seed).shuffle(docs)
    assert found(spark, documents(docs), queries) == brute(docs, queries)
    assert found(spark, documents(docs), queries, k=3) == brute(docs, queries, k=3)


def test_blocks_are_rejected_before_they_are_unpacked():
    docs, _ = corpus(7, 20_000, 400)
    segment = _Segment()
    for i, t in docs:
        segment.add(i, t.encode())
    rows = rows_of(segment)
    header, lists = np.frombuffer(rows[0][-1], search.DOC), {r[1]: (r[2], r[-1]) for r in rows[1:]}
    totals = rows[0][2], rows[0][3]
    marks = search.length_marks(header["n"], *totals)
    own = [_List(lists[t][1], search.weight(totals[0], lists[t][0]), marks, totals) for t in (b"w0", b"w1", b"w390", b"w399")]
    best, scores = best_documents(own, len(header), 10)
    assert [(i + 1, int(header["id"][d]), int(s)) for i, (d, s) in enumerate(zip(best, scores))] == brute(docs, ["w0 w1 w390 w399"])[0]
    assert sum(len(x.unpacked) for x in own) < sum(len(x.heads) for x in own) * 2 // 3


def test_bounds_are_the_blocks_maxima():
    docs, _ = corpus(3, 2_000)
    segment = _Segment()
    for i, t in docs:
        segment.add(i, t.encode())
    header, *rows = rows_of(segment)
    marks = search.length_marks(np.frombuffer(header[-1], search.DOC)["n"], header[2], header[3])
    for r in rows:
        own = _List(r[-1], search.weight(header[2], r[2]), marks, (header[2], header[3]))
        assert [int(own.block(b)[1].max()) for b in range(len(own.heads))] == own.bound[:-1].tolist()
        assert sum(len(own.block(b)[0]) for b in range(len(own.heads))) == r[2]


def test_wide_numbers_and_many_documents():
    """Occurrences above 65,535 and documents beyond 256 take more bytes, in the same lists."""
    segment = _Segment()
    texts = ["a " * 70_000] + ["a b " * (i % 3 + 1) for i in range(700)] + ["c"]
    for i, t in enumerate(texts):
        segment.add(i, t.encode())
    header, *rows = rows_of(segment)
    marks = search.length_marks(np.frombuffer(header[-1], search.DOC)["n"], header[2], header[3])
    for r in rows:
        own = _List(r[-1], 1, marks, (header[2], header[3]))
        docs = np.concatenate([own.block(b)[0] for b in range(len(own.heads))])
        assert docs.tolist() == [i for i, t in enumerate(texts) if r[1].decode() in t]
        adds = np.concatenate([own.block(b)[1] for b in range(len(own.heads))])
        tf = np.array([texts[i].split().count(r[1].decode()) for i in docs])
        assert (adds == search.impact(tf, marks[docs])).all()


def test_terms():
    text = "Ab-c_d 12\x7fÄÖ x Y ÀB 🙂z\x85k"
    assert term_counts(text.encode()) == Counter(t.encode() for t in terms(text))
    assert term_counts(b"a b " * 5_000_000) == {b"a": 5_000_000, b"b": 5_000_000}


def test_nulls_repeats_small_segments_and_query_blocks(spark, documents, clashing, monkeypatch):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "..."), (5, "gamma"), (-7, "beta beta ünï")]
    queries = ["alpha", "ALPHA Beta", "", "unknown", "...", "ünï gamma", None, "alpha"]
    assert found(spark, clashing(documents(docs)), queries) == brute(docs, queries)
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert found(spark, documents(docs).repartition(3), queries) == brute(docs, queries)


def test_empty_tables(spark, documents):
    none = documents([])
    assert found(spark, none, ["a"]) == {0: []}
    assert SearchIndex.build(documents([(1, "a")])).search(spark.createDataFrame([], "item_id int, text string")).count() == 0


def test_an_index_can_be_opened_again(spark, documents, tmp_path):
    folder = str(tmp_path / "index")
    SearchIndex.build(documents([(1, "a b"), (2, "b")]), folder)
    asked = spark.createDataFrame([(0, "a")], "item_id int, text string")
    assert [r["doc_id"] for r in SearchIndex.open(spark, folder).search(asked).collect()] == [1]
