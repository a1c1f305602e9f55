"""Token alignment against sets of byte offsets, without windows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pulsegrid.llm.align as align
import pytest
from pulsegrid.llm.align import TOKENIZER_A, TOKENIZER_B, TOKENIZERS, Aligner, alignments, op13_token_alignment, with_corpus_counts
from pulsegrid.llm.common import scratch

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/{TOKENIZER_A}")
    a.encode_special_tokens = True
    letters = tokenizers.decoders.ByteLevel()
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{TOKENIZER_B}")
    return a, letters, b


def plain(models, text):
    """Groups as pairs of id lists; None if there are no tokens."""
    a, _, b = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    named = {c: i for i, c in align.byte_letters().items()}
    spell_a = [bytes({v: k for k, v in named.items()}[c] for c in a.id_to_token(i)) for i in ids_a]
    spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
        return None
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    end_a, end_b = ends(spell_a), ends(spell_b)
    groups, low = [], 0
    for cut in sorted(set(end_a) & set(end_b)):
        groups.append(([x for x, e in zip(ids_a, end_a) if low < e <= cut], [y for y, e in zip(ids_b, end_b) if low < e <= cut]))
        low = cut
    return groups


def brute(models, docs):
    links, rows = {}, {}
    for key, (_, text) in enumerate(docs):
        groups = plain(models, text) or []
        links[key] = Counter((x, y) for a, b in groups for x in a for y in b)
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        rows[key] = [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links[key].values()), digest]
    counts = Counter(p for own in links.values() for p in own)
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for key, (doc_id, _) in enumerate(docs):
        n_best = sum(n for p, n in links[key].items() if counts[p] == top[p[0]])
        total = sum(n * counts[p] for p, n in links[key].items())
        out.append((doc_id, *rows[key][:4], n_best, total, rows[key][4]))
    return sorted(out, key=repr)


TEXTS = [
    None,
    "",
    " ",
    "word",
    "The quick brown fox, and then 12345 unforgettable things.",
    "  two  spaces   and\ttabs\n\nlines \n end ",
    "<|endoftext|> <s> </s> <unk> <0x0A> are plain",
    "ünïcödé naïve 日本語 текст 🙂🙂 é",
    "▁ is the mark itself",
    "a b c​d﻿",
    "=" * 300 + " " * 200 + "-" * 77,
    "\x00\x01 control \x7f",
    "The quick brown fox, and then 12345 unforgettable things.",
]


def answer(spark, docs):
    where = scratch(spark, "align-test")
    alignments(docs).write.parquet(where)
    from pyspark.sql import functions as F

    done = with_corpus_counts(spark.read.parquet(where)).withColumn("digest", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"]
    return sorted((tuple(r) for r in done.select(*columns).collect()), key=repr)


def test_equals_sets_of_offsets(spark, documents, models):
    docs = list(enumerate(TEXTS))
    assert answer(spark, documents(docs)) == brute(models, docs)


def test_frequent_pairs_on_both_paths(spark, documents, models, monkeypatch):
    draw = random.Random(4)
    words = ["the", "of", "House", "rain-bow", "ünder", "counterintuitive", "x1y2", ".", "\n", "çava"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 30)))) for i in range(40)]
    monkeypatch.setattr(align, "HOT_PAIRS", 20)
    assert answer(spark, documents(docs)) == brute(models, docs)


def as_rows(found):
    """One plain tuple for each text."""
    ends = found.n_pairs.cumsum().tolist()
    pairs = [dict(zip(found.pairs[a:b].tolist(), found.times[a:b].tolist())) for a, b in zip([0, *ends], ends)]
    return list(zip(*(x.tolist() for x in found[:4]), found.groups, pairs))


def test_windows_are_remembered_and_forgotten(models, monkeypatch):
    aligner = Aligner(TOKENIZERS)
    first = as_rows(aligner.texts(TEXTS))
    known = len(aligner.windows)
    assert known and as_rows(aligner.texts(TEXTS)) == first and len(aligner.windows) == known
    monkeypatch.setattr(align, "WINDOWS_KEPT", 3)
    small = Aligner(TOKENIZERS)
    assert [as_rows(small.texts([t]))[0] for t in TEXTS] == first and len(small.windows) < known


def test_parts_give_the_tokens_of_whole_texts(models):
    """Both tokenizers' own encodings of whole texts, for all that can stand around spaces."""
    parts, draw = Aligner(TOKENIZERS).parts, random.Random(6)
    marks = ["a", "B", "the", " ", "  ", "   ", "\n", "\t", "1", ".", "é", "日", "🙂", "\u00a0", "\u3000", "\r\n", "'s", "-", "\x1c", "\x85", "▁", "x" * 70]
    for text in ["".join(draw.choices(marks, k=draw.randint(1, 12))) for _ in range(4_000)] + [t for t in TEXTS if t]:
        cut = parts.cut(text)
        numbers = parts.numbers(cut)
        assert "".join(cut) == " " + text
        a, b = (np.frombuffer(b"".join(ids[i] for i in numbers), np.int32).tolist() for ids in (parts.ids_a, parts.ids_b))
        assert a == models[0].encode(" " + text, add_special_tokens=False).ids
        whole = models[2].encode(text)
        spelled = b"".join(parts.vocabularies[1].spelled[i] for i in whole) == (" " + text).encode()
        assert spelled == parts.wrong.isdisjoint(numbers) and (b == whole or not spelled)


def test_both_readers_of_the_vocabulary_agree(models):
    """Every 97th code point between letters, digits, marks and spaces, against the tokenizer the file was made for."""
    own = Aligner(TOKENIZERS).a
    for low in range(0, 0x110000, 0x4000):
        texts = [f" a{c}b {c}{c} 1{c}2 .{c}; {c} x  {c}y\n{c}'s" for c in map(chr, range(low, low + 0x4000, 97)) if not 0xD800 <= ord(c) <= 0xDFFF]
        assert own.encode(texts) == [e.ids for e in models[0].encode_batch(texts, add_special_tokens=False)]


def test_a_long_group_has_no_list_of_its_links():
    text = "é" * 20_000 + " " + "\u3000" * 9_000
    (n_a, n_b, n_groups, n_links, groups, pairs), = as_rows(Aligner(TOKENIZERS).texts([text]))
    assert n_a and sum(pairs.values()) == n_links and groups.count(";") == n_groups - 1


def test_repeats_null_ids_clashing_names_and_empty_table(spark, documents, clashing, models):
    docs = [(1, "same text"), (1, "same text"), (None, "same text"), (2, None)]
    assert answer(spark, clashing(documents(docs))) == brute(models, docs)
    assert answer(spark, documents([])) == []


def test_query_over_a_whole_table(spark, tables, models):
    rows = op13_token_alignment(spark, tables).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert len(rows) == len(docs)
    short = sorted(docs, key=lambda d: len(d[1] or ""))[:60]
    mine = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows}
    for doc_id, *numbers, _, _, digest in brute(models, short):
        assert mine[doc_id] == (*numbers, digest)
