import hashlib

from pulsegrid.llm.lines import drop_shared_lines


def brute(texts, least=10):
    key = lambda l: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in enumerate(texts):
        for l in (t or "").split("\n"):
            seen.setdefault(key(l), set()).add(i)
    gone = {k for k, docs in seen.items() if k and len(docs) >= least}
    return [[l for l in (t or "").split("\n") if key(l) not in gone] for t in texts]


def test_shared_lines_go_everywhere(spark, documents, clashing):
    texts = [f"unique {i}\n  Shared LINE \t\nÉTÉ\n\nend {i}\n" for i in range(12)]
    texts += ["été\nshared line", "", None, "shared line", "\n\n", "x" * 100_000 + "\nshared line\n" + "y\n" * 3000]
    docs = clashing(documents([(i, t) for i, t in enumerate(texts)]))
    got = {r.doc_id: r for r in drop_shared_lines(docs).collect()}
    assert len(got) == len(texts)
    for i, left in enumerate(brute(texts)):
        assert got[i].kept_text == "\n".join(left)
        assert got[i].n_lines == len((texts[i] or "").split("\n"))
        assert got[i].n_dropped == got[i].n_lines - len(left)
        assert got[i]._k1 == "own _k1"
    # A-Z only: É and é are different lines, and é occurs once.
    assert "été" in got[12].kept_text and "shared" not in got[12].kept_text


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (None, None)]
    got = drop_shared_lines(documents(rows), min_docs=2).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in got) == [(0, ""), (0, "c"), (1, "b"), (1, "b")]
    assert drop_shared_lines(documents([])).count() == 0


def test_hash_of_what_stays(spark, documents, tmp_path):
    from pulsegrid.llm.lines import op3_line_dedup

    documents([(i, "same\nother %d" % i) for i in range(10)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in op3_line_dedup(spark, str(tmp_path)).collect():
        assert (r.n_lines, r.n_dropped) == (2, 1)
        assert r.kept_sha256 == hashlib.sha256(b"other %d" % r.doc_id).hexdigest()
