import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import zstandard

from pulsegrid.llm import anchors as A
from pulsegrid.llm import suffixes as S


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(b[s : s + length])
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def texts(seed):
    r = random.Random(seed)
    letters = "abé "
    base = "".join(r.choice(letters) for _ in range(400))
    out = ["", None, "a" * 500, "ab" * 200, base, base, base[50:300], "x" + base[:120] + "y" * 90 + base[100:]]
    for _ in range(40):
        a, b = sorted(r.randrange(401) for _ in range(2))
        out.append("".join(r.choice(letters) for _ in range(r.randrange(60))) + base[a:b] + "".join(r.choice(letters) for _ in range(r.randrange(60))))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("length, gram, hot", [(30, 12, 4000), (30, 12, 3), (20, 19, 2)])
def test_removed_bytes_equal_brute_force(documents, monkeypatch, length, gram, hot):
    """With a low bound for hot grams, they are split and compared across buckets."""
    monkeypatch.setattr(S, "MIN_HOT", hot)
    monkeypatch.setattr(S, "MAX_HOT", 10**6)
    rows = texts(length)
    found = S.remove_repeats(documents(rows), length, gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == brute(rows, length)
    for r in found:
        text = (dict(rows)[r.doc_id] or "").encode()
        assert hashlib.sha256(text if r.kept is None else bytes(r.kept)).hexdigest() == r.kept_sha256


def test_production_length_long_text_and_clashing_columns(documents, clashing):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, "head " + long[1000:1150] + " tail"), (3, long[5:104]), (4, long[5:105]), (5, long)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(clashing(documents(rows))).collect()}
    assert got == brute(rows, 100)
    assert got[3][1] == 0 and got[4][1] == 100 and got[2][1] == 150 and got[5][1] == 60_000


def test_copies_in_a_batch_whose_rows_are_not_in_order(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = text(200), text(150)
    copied = text(50) + passage + other + text(50) + other
    rows = [(9, "z" + other), (8, copied), (7, "y" + passage), (5, copied), (2, passage + "x"), (1, text(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(docs).collect()} == brute(rows, 100)


def test_run_of_several_megabytes_in_one_document(documents):
    import pyarrow as pa
    import zstandard

    n = 3_000_000
    text = b"head" + b" " * n + b"tail"
    places, hashes, _, _ = A.anchors(np.frombuffer(text, np.uint8), 100, 40)
    alive = np.arange(len(places), dtype="<u4")
    hot = S.order_key(hashes[len(hashes) // 2 :][:1], 16)
    rows = pa.RecordBatch.from_pydict({"id": [1], "k": [77], "packed": [zstandard.ZstdCompressor().compress(text)], "alive": [alive.tobytes()]})
    sizes = {}
    for out in S._suffixes(100, 40, 16, np.empty(0, np.uint64), hot, np.array([750]))([rows]):
        for bucket, blob in zip(out.column("bucket").to_pylist(), out.column("blob").to_pylist()):
            sizes[bucket] = sizes.get(bucket, 0) + len(zstandard.ZstdDecompressor().decompress(blob)) // (S.ITEM.itemsize + 120)
    assert sum(sizes.values()) >= n - 200 and max(sizes.values()) < n / 50
    rows = [(1, text.decode()), (2, "x" + " " * 200)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in S.remove_repeats(documents(rows)).collect()}
    assert got == {1: (n + 8, n - 1, 1), 2: (201, 200, 1)}


def test_joined_spans():
    one, k = np.array([5, 5, 5, 4, 5, 5]), np.array([1, 1, 1, 9, 2, 1])
    got = S.joined_spans(one, k, np.array([10, 0, 3, 7, 2, 31]), np.array([30, 8, 5, 9, 4, 40]))
    assert got.values.tolist() == [[4, 9, 7, 9], [5, 1, 0, 8], [5, 1, 10, 30], [5, 1, 31, 40], [5, 2, 2, 4]]
    assert len(S.joined_spans(*[np.empty(0, np.int64)] * 4)) == 0


def test_repeated_rows_null_ids_and_empty_table(documents):
    text = "0123456789" * 20 + "end"
    found = S.remove_repeats(documents([(2, text), (2, text), (None, "z" + text), (3, text)])).collect()
    got = sorted((r.doc_id or 0, r.n_removed) for r in found)
    # The row without an id comes first; its own period repeats within it. Equal rows are one document.
    assert [i for i, _ in got] == [0, 2, 2, 3] and got[1] == got[2] and got[3] == (3, 203)
    assert S.remove_repeats(documents([])).count() == 0


def test_anchors_depend_on_the_string_alone(monkeypatch):
    r = np.random.default_rng(1)
    for length, gram in ((20, 8), (100, 40), (12, 5)):
        for _ in range(40):
            data = r.integers(97, 97 + r.integers(1, 4), r.integers(0, 300)).astype(np.uint8)
            monkeypatch.setattr(A, "PIECE_BYTES", int(r.integers(30, 400)))
            places, _, first, last = A.anchors(data, length, gram)
            hashes = A.gram_hashes(data, gram)
            want = [s + int(np.argmin(hashes[s : s + length - gram + 1])) for s in range(len(data) - length + 1)]
            got = {s: p for p, a, b in zip(places, first, last) for s in range(a, b + 1)}
            assert [got.get(s) for s in range(len(want))] == want and len(got) == len(want)


def test_multikey_quicksort_sorts():
    r = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 3), (500, 1), (700, 4), (300, 0)):
        words = r.integers(0, 4, (n, k)).astype(np.uint64) << np.uint64(62)
        order = S.multikey_quicksort(words)
        assert sorted(order.tolist()) == list(range(n))
        ranked = [tuple(x) for x in words[order].tolist()]
        assert ranked == sorted(ranked)


def suffix_blob(texts, key, at=30, length=100, gram=40):
    """Suffixes of 100-byte texts at one place, as a bucket gets them, all with one key."""
    items = np.zeros(len(texts), S.ITEM)
    items["key"], items["id"], items["k"], items["at"] = key, range(len(texts)), range(len(texts)), at
    items["near"] = items["far"] = at
    left, right = np.zeros((len(texts), length - gram), np.uint8), np.zeros((len(texts), length), np.uint8)
    for i, t in enumerate(texts):
        cells = np.frombuffer(t, np.uint8)
        left[i, :at], right[i, : length - at] = cells[:at][::-1], cells[at:]
    return zstandard.ZstdCompressor().compress(items.tobytes() + left.tobytes() + right.tobytes())


@pytest.mark.parametrize("bucket", [0, 1])
def test_grams_of_one_key_are_told_apart(bucket):
    """Equal frames around different grams whose hashes collide in all ordered bits are no repeats."""
    frame, other = b"L" * 30, b"R" * 30
    texts = [frame + b"a" * 40 + other, frame + b"b" * 40 + other, frame + b"a" * 40 + other]
    found = S._bucket(100, 40, 1)((bucket,), pd.DataFrame({"blob": [suffix_blob(texts, 7)]}))
    assert found[found.kind == 0][["id", "at", "to"]].values.tolist() == [[2, 0, 100]]
    marks = found[found.kind == 1]
    assert bucket == 0 or (sorted(marks["id"]) == [0, 1] and len(set(zip(marks.s1, marks.s2))) == 2)


def test_templated_documents_with_own_numbers(spark, documents):
    """One frame with differing numbers inside: nothing but whole repeated strings goes."""
    rows = [(i, f"{'Order form of the usual kind. ':<30}number {i % 400:032d}{' to be kept with all papers.':<31}") for i in range(900)]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(documents(rows)).collect()}
    assert got == {i: (len(rows[i][1]) if i >= 400 else 0) for i in range(900)}
