import hashlib
import random

from pyspark.sql import functions as F

from pulsegrid.llm import fingerprints as P


def words(n, seed):
    r = random.Random(seed)
    return " ".join(str(r.randrange(10**6)) for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, documents, tmp_path):
    texts = [words(900, 1), words(900, 1), words(3, 2), "", None, " \n ", words(2000, 3), "Ab " * 40, "é" * 7, words(700, 4)]
    ids = [50, 7, 9, 1000, 3, 12, 13, 14, 2**40, 5]
    documents(list(zip(ids, texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(ids)
    text = {i: t or "" for i, t in zip(ids, texts)}
    assert sorted(got) == order
    for i, j in zip(order, order[1:] + order[:1]):
        a, b, half = text[i], text[j], len(text[i]) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[i].n_chars == len(a)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - jaccard(a, edited)) < 0.12
        assert abs(got[i].near_next - jaccard(a, b)) < 0.12
        assert abs(got[i].n_shingles - len(shingles(a))) <= 0.25 * len(shingles(a))
    assert got[50].fingerprint == got[7].fingerprint != got[9].fingerprint
    assert got[3].fingerprint == got[12].fingerprint == ""


def test_many_buckets_see_every_next(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 3)
    docs = spark.range(200).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r.doc_id: r.next_text for r in P.with_next(docs).collect()}
    assert got == {i * i: str((i + 1) % 200) for i in range(200)}


def test_one_row_ties_nulls_and_empty_table(spark, documents):
    assert [(r.doc_id, r.next_text) for r in P.with_next(documents([(5, "x")])).collect()] == [(5, "x")]
    got = P.with_next(documents([(1, "a"), (1, "a"), (None, "n"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "n"), (1, "a"), (1, "a"), (2, "")]
    assert {r.next_text for r in got if r.doc_id == 2} == {"n"}
    assert P.with_next(documents([])).count() == 0


def test_sketches_merge_and_contain(spark):
    whole, part = words(3000, 5), " ".join(words(3000, 5).split()[:1500])
    df = spark.createDataFrame([("a", whole, part)], "g string, whole string, part string")
    df = df.select("g", P.sketch(F.col("whole")).alias("w"), P.sketch(F.col("part")).alias("p"))
    row = df.select("w", "p", P.merge(F.col("w"), F.col("p")).alias("m"), P.containment(F.col("p"), F.col("w")).alias("c"), P.containment(F.col("w"), F.col("p")).alias("h")).first()
    assert row.m == row.w and row.c > 0.85 and abs(row.h - 0.5) < 0.15
    parts = df.select("g", F.explode(F.array("w", "p")).alias("s"))
    assert P.merge_groups(parts, ["g"], "s").first().s == row.w
