"""Personal data: spans of fixed forms, and terms that the corpus shows to give them away."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import checked_join
from .common import materialize, read_documents, row_key, slices, whole_text
from .components import connected_components
from .shingles import mix64

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
SUPPORT = 5
MIN_TERM = 3
LIKENESS = 0.5
BANDS = 16

# The forms of the four kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: The same words in the JVM: letters and numbers of all kinds, also superscripts and fractions.
JVM_WORD = r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"
DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """From every @, to the left as far as the local part's characters go, and no further than the match before."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds, by kind and then start. Time is linear in the text for every input."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def term_spans(text: str, terms: set[str], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Words of ``terms`` outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    out = []
    for m in WORD.finditer(text):
        if m[0].lower() in terms:
            at = bisect_right(starts, m.end() - 1) - 1
            if at < 0 or reach[at] <= m.start():
                out.append(("term", *m.span()))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def generalised(word: str) -> str:
    """Words with digits keep their shape only; others are removed."""
    return re.sub(r"[^\W\d_]", "x", re.sub(r"\d", "0", word)) if DIGIT.search(word) else ""


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with base spans replaced by their kind and terms generalised or removed; overlaps are one span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        out.append(generalised(text[a:b]) if kind == "term" else f"[{kind.upper()}]" if a >= at else "")
        at = b
    return "".join(out) + text[at:]


# ---- what terms give away ----


def _last(line: str, end: int) -> list[str]:
    """The last two words before ``end``, without a look at the whole line."""
    for reach in (64, 1024, 1 << 15):
        if reach < end:
            found = line[end - reach : end].split()
            if len(found) > 2:  # the first may be cut
                return found[-2:]
    return line[:end].split()[-2:]


def _next(line: str, begin: int) -> list[str]:
    for reach in (64, 1024, 1 << 15):
        if begin + reach < len(line):
            found = line[begin : begin + reach].split()
            if len(found) > 2:  # the last may be cut
                return found[:2]
    return line[begin:].split()[:2]


def _contexts(batches):
    """Per entity found and line it stands in: the entity and its nearest words. Per such line: its distinct other words."""
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            lines = {}
            for kind, a, b in spans:
                begin = text.rfind("\n", 0, a) + 1
                end = text.find("\n", b)
                lines.setdefault((begin, len(text) if end < 0 else end), []).append((kind, a, b))
            for (begin, end), inside in lines.items():
                line = text[begin:end]
                parts, at = [], 0
                for _, a, b in sorted(inside, key=lambda x: x[1:]):
                    parts += [line[at : max(a - begin, at)], " " * (b - begin - max(a - begin, at))]
                    at = max(b - begin, at)
                blank = "".join(parts) + line[at:]
                words = sorted({w.lower() for w in WORD.findall(blank) if len(w) >= MIN_TERM})
                digest = int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)
                for kind, a, b in inside:
                    near = " ".join(_last(blank, a - begin) + ["_"] + _next(blank, b - begin))
                    rows.append((f"{kind}:{text[a:b].lower()}", near, digest, None))
                rows.append((None, None, digest, words))
        names = ["entity", "near", "line", "words"]
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _line_words(docs: DataFrame) -> DataFrame:
    """Every line of the corpus with its distinct words, by built-in expressions."""
    line = F.explode(F.split(whole_text(), "\n", -1)).alias("l")
    words = F.array_distinct(F.regexp_extract_all(F.lower("l"), F.lit(JVM_WORD), F.lit(1)))
    return docs.select(line).select(F.xxhash64("l").alias("line"), F.explode(words).alias("term"))


def _bands(batches):
    """Per line: the least hashes of its words, two orders at a time. Near copies agree in at least one such pair."""
    salts = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
    for batch in slices(batches):
        bands = []
        for words in batch.column("words").to_pylist():
            tokens = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words], np.uint64)
            least = np.array([mix64(tokens ^ s).min() for s in salts]).reshape(-1, 2)
            bands.append(mix64(least[:, 0] ^ mix64(least[:, 1] ^ salts[::2])).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(bands, pa.list_(pa.int64()))], ["line", "bands"])


def _near_copies(named: DataFrame, words: DataFrame) -> DataFrame:
    """``entity``, ``line`` and ``copy``, one number for all lines of an entity that are near copies. Written.

    Two lines are near copies when they share half of all their words, and so are those that a chain of such lines
    connects. A line is compared with one line per band that it shares with others of its entity, so the work grows
    with the lines, however many are alike. Lines without words are alone.
    """
    named = materialize(named.withColumn("v", F.xxhash64("entity", "line")))
    bands = words.filter(F.size("words") > 0).mapInArrow(_bands, "line bigint, bands array<bigint>")
    placed = named.join(bands.hint("shuffle_merge"), "line").select("entity", "v", "line", F.explode("bands").alias("band"))
    placed = materialize(placed.select(F.xxhash64("entity", "band").alias("band"), "v", "line"))
    heads = placed.groupBy("band").agg(F.min(F.struct("v", "line")).alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    pairs = placed.join(materialize(heads).hint("shuffle_merge"), "band").filter(F.col("v") != F.col("head.v"))
    pairs = materialize(pairs.select("v", "line", F.col("head.v").alias("w"), F.col("head.line").alias("other")).distinct())
    both = materialize(pairs.select("line", "other").distinct()).join(words.hint("shuffle_merge"), "line")
    both = both.join(words.select(F.col("line").alias("other"), F.col("words").alias("others")).hint("shuffle_merge"), "other")
    common = F.size(F.array_intersect("words", "others"))
    alike = both.filter(common >= LIKENESS * (F.size("words") + F.size("others") - common)).select("line", "other")
    links = pairs.join(materialize(alike).hint("shuffle_merge"), ["line", "other"]).select(F.col("v").alias("a"), F.col("w").alias("b"))
    roots = connected_components(links)
    return materialize(named.join(roots.hint("shuffle_merge"), "v", "left").select("entity", "line", F.coalesce("root", "v").alias("copy")))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Terms that reveal an entity: ``entity``, ``term``, ``share``. Written.

    With n counting different lines of the corpus and N all lines, PMI = log2(n(e,t) N / (n(e) n(t))) is what term t
    tells about entity e, and IC = log2(N / n(e)) what there is to know. A term discloses e when PMI >= disclosure * IC
    and it was seen beside e in at least ``support`` different surroundings (the two words on either side of e) and as
    many lines. In all of this, lines of e that are near copies of each other count as one line.
    Counts are over the whole corpus. Words are counted for candidate terms
    only; they are broadcast if they fit a checked size and are joined by a shuffle otherwise.
    """
    empty = docs.sparkSession.createDataFrame([], "entity string, term string, share double")
    found = docs.select("text").mapInArrow(_contexts, "entity string, near string, line bigint, words array<string>")
    found = materialize(found)
    # Only entities with enough surroundings can be disclosed; copies are combined before they are shuffled.
    often = found.filter("entity is not null").groupBy("entity", "near").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= support)
    often = materialize(often)
    if often.isEmpty():
        return empty
    rows = found.join(often.select("entity").hint("shuffle_merge"), "entity", "left_semi")
    per_line = materialize(rows.select("entity", "near", "line").distinct())
    words = found.filter("words is not null").join(per_line.select("line").distinct().hint("shuffle_merge"), "line", "left_semi")
    words = materialize(words.groupBy("line").agg(F.first("words").alias("words")))
    copies = _near_copies(per_line.select("entity", "line").distinct(), words)
    # Lines, and lines with near copies as one.
    entity = copies.groupBy("entity", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.sum("n").alias("all_e"), F.count(F.lit(1)).alias("n_e"))
    entity = materialize(entity.filter(F.col("n_e") >= support))
    if entity.isEmpty():
        return empty
    often = entity.select("entity").hint("shuffle_merge")
    per_line = materialize(per_line.join(often, "entity", "left_semi").join(copies.hint("shuffle_merge"), ["entity", "line"]))
    each = per_line.join(words.hint("shuffle_merge"), "line").select("entity", "near", "line", "copy", F.explode("words").alias("term"))

    def different(rows, name):
        rows = rows.groupBy("entity", "term", name).agg(F.lit(1).alias("one"))
        return rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    several = materialize(different(each, "copy").filter(F.col("n_copy") >= support))
    each = each.join(several.select("entity", "term").hint("shuffle_merge"), ["entity", "term"], "left_semi")
    seen = different(each, "near").filter(F.col("n_near") >= support)
    seen = materialize(seen.join(several.hint("shuffle_merge"), ["entity", "term"]).select("entity", "term", F.col("n_copy").alias("n_both")))
    if seen.isEmpty():
        return empty
    both = each.join(seen.hint("shuffle_merge"), ["entity", "term"]).select("entity", "term", "line", "n_both").distinct()
    both = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("all_both"), F.first("n_both").alias("n_both"))
    terms = materialize(seen.select("term").distinct())
    counted = checked_join(_line_words(docs), terms, ["term"], rows=terms.count(), row_bytes=128)
    term = counted.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    lines = docs.agg(F.sum(F.size(F.split(whole_text(), "\n", -1)))).first()[0]
    # No term is lost if the two sides should ever cut a word differently: it then occurs where it was seen.
    joined = both.join(entity, "entity").join(term, "term", "left")
    n = F.lit(float(lines)) - F.col("all_e") + F.col("n_e")
    # A line may be cut differently in the two counts; a term is in no fewer lines than with the entity.
    n_t = F.greatest(F.coalesce("n_t", "all_both") - F.col("all_both"), F.lit(0)) + F.col("n_both")
    # An entity that every line names has no information.
    known = F.try_divide(F.log2(F.col("n_both") * n / (F.col("n_e") * n_t)), F.log2(n / F.col("n_e")))
    return materialize(joined.withColumn("share", known).filter(F.col("share") >= disclosure).select("entity", "term", "share"))


def _find(batches):
    for batch in slices(batches):
        n = len(KINDS)
        counts, base_sha, all_spans, clean = [[] for _ in range(n)], [], [], []
        for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
            text = text or ""
            base = base_spans(text)
            spans = base + (term_spans(text, set(terms), base) if terms else [])
            for i, kind in enumerate(KINDS):
                counts[i].append(sum(k == kind for k, _, _ in base))
            base_sha.append(hashlib.sha256(written(base).encode()).hexdigest())
            all_spans.append(written(spans)), clean.append(sanitise(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_sha), pa.array(all_spans), pa.array(clean)],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean"],
        )


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Per row: doc_id, counts of the four kinds, ``base_sha256``, ``spans`` and ``clean``, the sanitised text.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start; disclosing terms follow as ``term``,
    wherever in the corpus they occur. Null and empty texts have no spans. Each row stands for itself.
    """
    given_away = disclosing_terms(docs, disclosure, support)
    terms = materialize(given_away.select("term").distinct())
    rows = docs.select("doc_id", "text", *row_key(F.col("doc_id"), whole_text()))
    if terms.isEmpty():
        rows = rows.withColumn("terms", F.array().cast("array<string>"))
    else:
        words = F.array_distinct(F.regexp_extract_all(F.lower(whole_text()), F.lit(JVM_WORD), F.lit(1)))
        holds = checked_join(rows.select("_k1", "_k2", F.explode(words).alias("term")), terms, ["term"], rows=terms.count(), row_bytes=128)
        holds = holds.groupBy("_k1", "_k2").agg(F.collect_set("term").alias("terms"))
        rows = rows.join(holds.hint("shuffle_merge"), ["_k1", "_k2"], "left")
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.select("doc_id", "text", "terms").mapInArrow(_find, f"doc_id bigint, {counts}, base_sha256 string, spans string, clean string")


def op10_personal_data(spark, folder):
    return find_personal_data(read_documents(spark, folder)).drop("clean")
