"""Quality rules: a table of thresholds compiled into one projection of counts and ratios; built-in expressions only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, read_documents, whole_text

# The usual function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is it that for was with as on be by at this are from or an have not
der die das und ist ein eine nicht mit auf für von zu den dem des im sich auch als
le la les de du des et est un une que qui dans pour par sur pas avec ne au
el la los las de del y que en un una es por con para se su como al no
""".split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_RULES = 1_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_stop", "n_lines", "n_dup_lines", "n_open_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= over / under <= high``; a missing bound is not tested, nor is a zero ``under``."""

    name: str
    over: str
    under: str | None = None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        """Never null."""
        value = F.col(self.over).cast("double")
        if self.under:
            value = F.try_divide(value, F.col(self.under).cast("double"))
        tests = [value >= self.low] * (self.low is not None) + [value <= self.high] * (self.high is not None)
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t, F.lit(True))
        return out


#: The table of this library; ``quality`` takes any other.
THRESHOLDS = (
    Rule("length", "n_words", low=20, high=10_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("open_lines", "n_open_lines", "n_lines", high=0.9),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.3),
)


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table (name, over, under, low, high). It is a table of settings: more than 1,000 rows are refused."""
    rows = table.select("name", "over", "under", "low", "high").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    unknown = {c for r in rows for c in (r["over"], r["under"]) if c and c not in COUNTS}
    if unknown:
        raise ValueError(f"no such counts: {sorted(unknown)}; known are {COUNTS}")
    return tuple(Rule(*r) for r in rows)


def word_list(text: Column) -> Column:
    r"""All ``[^\x20\x09-\x0D]+`` of a text."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def stop_count(words: Column, stop_words: Iterable[str]) -> Column:
    """Words that are stop words as they stand: in small letters, with a capital, or in capitals."""
    known = sorted({form for w in stop_words for form in (w, w.capitalize(), w.upper())})
    return F.size(F.filter(words, lambda w: w.isin(known)))


def _window_hash(words: Column, i: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.get(words, i + j) for j in range(WINDOW)])


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first occurrence included.

    Windows are hashed to 64 bits. If no hash occurs twice, no window does, and that is most texts. Otherwise windows
    are hashed again with another seed and sorted by both hashes, so that 128 bits decide; equal neighbours are
    repeats, and their places, sorted, tell how many words they cover. Linear but for the sorts.
    """
    last = F.size(words) - WINDOW

    def covered(first: Column) -> Column:
        entries = F.transform(first, lambda h, i: F.struct(h.alias("a"), _window_hash(words, i, 2).alias("b"), i.alias("i")))
        return let(F.sort_array(entries), lambda s: let(F.sort_array(places(s)), extent))

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))), lambda x: x["i"])

    def extent(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: _window_hash(words, i, 1))
    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(last >= 1, repeats).otherwise(0)


def with_counts(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts that rules may name; columns of these names are replaced.

    A null text has no words and no lines; an empty one neither. Rows are counted one by one, so repeated rows get
    equal counts; no other row and no other column has an influence.
    """
    docs = docs.drop(*COUNTS, "_words", "_lines")
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.octet_length(F.btrim(line, F.lit(SPACE))) > 0)
    with_lists = docs.withColumns({"_words": word_list(text), "_lines": lines})
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_stop": stop_count(F.col("_words"), stop_words),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_open_lines": F.size(F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACE)).endswith("...") | F.btrim(x, F.lit(SPACE)).endswith("…"))),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    return with_lists.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop("_words", "_lines")


def quality(docs: DataFrame, rules: Iterable[Rule] = THRESHOLDS, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed`` (names of the rules that a document breaks) and ``kept``.

    Narrow: one projection, no shuffle and no user function, whatever the table of rules. A document with fewer than 20
    words, or with more than 30 % of its words in repeated windows, fails whatever the rules are.
    """
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules])).cast("array<string>")
    counted = with_counts(docs.drop("base_failed", "failed", "kept"), stop_words)
    judged = counted.withColumns({"base_failed": (F.col("n_words") < MIN_WORDS) | repeated, "failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op11_quality_rules(spark, folder):
    docs = quality(read_documents(spark, folder))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop", F.array_join("failed", ",").alias("failed"))


def _sql() -> str:
    known = ", ".join(sorted({f"'{form}'" for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())}))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    fails = []
    for r in THRESHOLDS:
        value = f"{r.over}::DOUBLE" + (f" / nullif({r.under}, 0)::DOUBLE" if r.under else "")
        tests = [f"{value} < {r.low}"] * (r.low is not None) + [f"{value} > {r.high}"] * (r.high is not None)
        fails.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF trim(l, {space}) <> ''] AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(words, i + 1, i + 8) AS gram
  FROM (SELECT doc_id, words, unnest(range(len(words) - 7)) AS i FROM texts)
), twice AS (
  SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM grams JOIN twice USING (doc_id, gram))
  GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    len([w FOR w IN words IF w IN ({known})]) AS n_stop,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len([l FOR l IN lines IF trim(l, {space}) LIKE '%...' OR trim(l, {space}) LIKE '%…']) AS n_open_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    concat_ws(',', {', '.join(fails)}) AS failed
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed = '' AS kept, n_stop, failed
FROM judged
"""


OP11_SQL = _sql()
