import random

import numpy as np
import pytest

from pulsegrid.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")
BITS = [" ", "a", "b", "th", "e", "ing", " the", "\n", "é", "漢", "字", ".", "  ", "0", "=", "==", "\t", "🙂", "▁", "A", "import ", "ß", "..."]


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.read_pieces())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def samples():
    r = random.Random(3)
    for k in range(3000):
        yield "".join(r.choice(BITS) for _ in range(r.randrange(40)))
        if k % 50 == 0:
            yield " " * r.randrange(70) + "x" + " " * r.randrange(40)
            yield "".join(r.choice("abcdefgth漢 =") for _ in range(600))
            yield "".join(r.choice("abcdefgth漢=") for _ in range(900))


def test_ids_and_texts_equal_the_library(encoder, library):
    for text in samples():
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert P.decode(ids, encoder.p.spelled) == library.decode(ids.tolist())


def test_slices_and_small_caches_do_not_matter(encoder, library, monkeypatch):
    monkeypatch.setattr(P, "SLICE_CHARS", 11)
    monkeypatch.setattr(P, "CACHE_ENTRIES", 5)
    small = P.Encoder(encoder.p)
    for text in list(samples())[:600]:
        assert small.encode(text).tolist() == library.encode(text), repr(text)


def test_window_stays_bounded(encoder):
    """The survivors converge again and again, so ids are final long before the text ends."""
    text = P.MARK + "abcdefgh" * 20_000
    stream, first = encoder.viterbi(text), None
    for first in stream:
        break
    assert first is not None and len(stream.gi_frame.f_locals["last"]) < 4 * (P.COMMIT_EVERY + encoder.p.longest)


def test_documents_round_trip(documents, clashing):
    texts = ["Hello  wörld\n", " lead and trail ", None, "", "no▁mark", "x" * 5000, "漢字 🙂", "word " * 30_000]
    docs = clashing(documents([*enumerate(texts), (0, texts[0]), (None, "z")]))
    encoded = P.encode_documents(docs)
    assert len(encoded.columns) == len(docs.columns)
    rows = {r.doc_id: r for r in P.decode_documents(encoded).collect()}
    for i, t in enumerate(texts):
        assert rows[i].decoded == (t or "").replace("▁", " ") and rows[i].exact == ("▁" not in (t or ""))
    assert rows[2].ids == rows[3].ids == []
    assert encoded.count() == 10 and P.encode_documents(documents([])).count() == 0


def test_query_carries_ids(spark, tables, library):
    texts = {r.doc_id: r.text or "" for r in P.read_documents(spark, tables).collect()}
    rows = P.op9_sentencepiece(spark, tables).collect()
    assert len(rows) == len(texts) and all(r.ids == library.encode(texts[r.doc_id]) for r in rows)
    assert all(r.n_ids == len(r.ids) and r.n_chars == len(texts[r.doc_id]) for r in rows)


def test_bytes_that_are_no_text(encoder):
    assert P.decode(np.array([encoder.p.byte_ids[0xFF]]), encoder.p.spelled) == "�"
