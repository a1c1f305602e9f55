import random

import numpy as np
import pytest

from pulsegrid.llm import language as L
from pulsegrid.llm.common import read_documents

PARTS = {"aa": ["the", "ing", "and", "ther", "wh"], "bb": ["eau", "oi", "ç", "que", "è"], "cc": ["sch", "ung", "ü", "ein", "tz"]}


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices(PARTS[x], k=2)) for _ in range(r.randrange(5, 60))), x, None, 0) for i, x in enumerate(list(PARTS) * 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return L.fit(L.training_sample(docs))


def test_held_out_accuracy(spark, tables):
    found = L.op1_language_id(spark, tables)
    truth = {r.doc_id: r.lang for r in read_documents(spark, tables).collect()}
    rows = found.collect()
    assert len(rows) == len(truth)
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_rejection_and_edge_cases(documents, clashing, model):
    texts = ["theringwhand thething", "schung einein üsch", None, "", "123 456 !?", "é", "tz " * 2_000_000, "zzxx qqjj vvkk xxqq zzvv jjkk qqzz"]
    docs = clashing(documents([*enumerate(texts), (0, texts[0]), (None, texts[1])]))
    rows = L.predict(docs, model).collect()
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in rows}
    assert len(rows) == 10
    assert got[0] == ("aa", False) and got[1] == got[None] == ("cc", False) and got[6] == ("cc", False)
    assert got[2] == got[3] == got[4] == ("und", True)
    assert got[5][0] in model.labels and got[7][0] in model.labels
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, gone) in got.items() if not gone}
    assert L.predict(documents([]), model).count() == 0


def test_text_that_leans_to_no_language_is_rejected(documents, model):
    mixed = " ".join(p for parts in zip(*PARTS.values()) for p in parts)
    row = L.predict(documents([(1, mixed)]), model).first()
    assert row.score < 0.9


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64, 10_000])
def test_pieces_of_long_texts_count_alike(monkeypatch, piece):
    r = random.Random(piece)
    text = "".join(r.choice(["th", "É", " ", "  ", "12", "x", "\n", "ü", "Q", "--"]) for _ in range(400 if piece < 64 else 20_000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.bincount(L.subwords(data), minlength=L.BUCKETS)
    monkeypatch.setattr(L, "PIECE_BYTES", piece)
    assert (L.counts(data) == whole).all() and whole.sum()


def buckets(text):
    """Buckets of a text, one run at a time with Python's integers."""
    out, plain = [], []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        b = 32 if b < 128 and not 97 <= b <= 122 else b
        if not (b == 32 and plain and plain[-1] == 32):
            plain.append(b)
    full = 2**64
    for n in (2, 3, 4):
        for i in range(len(plain) - n + 1):
            run = int(L._BYTE[plain[i]])
            for b in plain[i + 1 : i + n]:
                run = (run * 0x9E3779B97F4A7C15 + int(L._BYTE[b])) % full
                run ^= run >> 29
            out.append((run * 0xBF58476D1CE4E5B9) % full >> 49)
    return out


def test_prediction_equals_a_plain_recomputation(documents, model):
    r = random.Random(9)
    texts = [" ".join("".join(r.choices(sum(PARTS.values(), []), k=2)) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    texts += ["A", "é 1", "The, THE! the?", "x" * 300]
    for row in L.predict(documents(list(enumerate(texts))), model).collect():
        found = buckets(texts[row.doc_id])
        z = [float(b) + sum(float(model.table[g][c]) for g in found) / max(len(found), 1) for c, b in enumerate(model.bias)]
        e = np.exp((np.array(z) - max(z)) / model.temperature)
        p = e / e.sum()
        assert row.score == pytest.approx(p.max(), abs=1e-4)
        assert row.lang_pred == model.labels[int(p.argmax())] or sorted(p)[-1] - sorted(p)[-2] < 1e-4
        assert row.rejected == (p.max() < model.threshold) or abs(p.max() - model.threshold) < 1e-4


def test_nothing_to_learn_from(documents):
    empty = L.fit(L.training_sample(documents([(1, "a", None, None)])))
    assert L.predict(documents([(1, "abc")]), empty).first().lang_pred == "und"
    assert L.keep_known(documents([(1, "abc"), (2, None)]), empty).count() == 2


def test_training_holds_a_part_of_its_sample_only(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices(PARTS[x], k=2)) for _ in range(40)), x, None, 0) for i, x in enumerate(list(PARTS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sample, whole = L.training_sample(docs), L.fit(L.training_sample(docs))

    def refuse(*_):
        raise AssertionError("the driver gathers the sample as a whole")

    monkeypatch.setattr(type(sample), "toArrow", refuse)
    monkeypatch.setattr(L, "FETCH_BYTES", 4096)
    parts, repartition = [], type(sample).repartition
    monkeypatch.setattr(type(sample), "repartition", lambda self, n: (parts.append(n), repartition(self, n))[1])
    model = L.fit(sample)
    assert parts and parts[0] > 10
    # Neither the number of parts nor the order in which they come makes a difference.
    assert (model.table == whole.table).all() and (model.temperature, model.threshold) == (whole.temperature, whole.threshold)
