"""Quality rules against a plain recomputation, on texts with every edge."""

import re

import pytest
from pulsegrid.llm.rules import COUNTS, STOP_WORDS, SYMBOLS, Rule, quality, rules_from

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FORMS = {f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}
PROSE = "the cat sat on a mat and it was not the dog that we saw in the old house by the sea"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    open_lines = sum(x.strip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines)
    return [len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), sum(w in FORMS for w in words), len(lines), len(lines) - len(set(lines)), open_lines, len(covered)]


TEXTS = [
    None,
    "",
    "   \n\t\n ",
    PROSE,
    PROSE.upper(),
    PROSE + "\n" + PROSE,
    "x " * 9,
    "x " * 8,
    "a b c d e f g h i a b c d e f g h " + PROSE,
    "\n".join(["same line", " same line", "same line", "", "other..."] * 3),
    "# $ % & | < > * " * 5 + PROSE,
    "ünïcödé 🙂 " * 12 + " no break … \x0bvt",
    "one " * 5_000 + PROSE,
    "\x1c\x1d words \x85 by   ascii space",
    "w" * 10_000,
]


def test_counts_equal_a_plain_recomputation(documents):
    rows = quality(documents(list(enumerate(TEXTS)))).collect()
    assert {r["doc_id"]: [r[c] for c in COUNTS] for r in rows} == {i: plain(t) for i, t in enumerate(TEXTS)}
    for r in rows:
        n, repeated = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and not r["failed"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert 3 in kept and 0 not in kept and 10 not in kept


def test_rules_compile_into_one_narrow_projection(documents):
    plan = quality(documents([(1, PROSE)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_any_table_of_rules(spark, documents):
    table = spark.createDataFrame([("few", "n_words", None, None, 5.0), ("none", "n_symbols", "n_lines", None, None)], "name string, over string, under string, low double, high double")
    out = quality(documents([(1, PROSE), (2, PROSE[:60])]), rules_from(table)).collect()
    assert {r["doc_id"]: r["failed"] for r in out} == {1: ["few"], 2: ["few"]}
    assert quality(documents([(1, PROSE)]), ()).first()["kept"] is True
    with pytest.raises(ValueError, match="no such counts"):
        rules_from(spark.createDataFrame([("x", "words", None, None, 5.0)], table.schema))


def test_a_zero_denominator_is_not_tested(documents):
    assert quality(documents([(1, None)]), [Rule("r", "n_symbols", "n_words", low=1)]).first()["failed"] == []


def test_repeats_null_ids_empty_tables_and_clashing_names(documents, clashing):
    out = quality(clashing(documents([(1, PROSE), (1, PROSE), (None, PROSE)]))).collect()
    assert [r["kept"] for r in out] == [True] * 3 and out[0]["_k1"] == "own _k1" and out[0]["n_lines"] == 1
    assert quality(documents([])).count() == 0
