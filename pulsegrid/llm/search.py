"""Ranked lexical search: an inverted index of segments, searched by Block-Max MaxScore; segment heaps are merged.

A task turns the texts that it reads into segments of about 16 MB, without a shuffle. A segment holds, for each of its
terms, a list of (document, occurrences) in blocks of 128, and for each block the pairs (occurrences, length) that no
other pair of the block beats. From these pairs follows a block's exact maximum once the corpus's totals are known, so
the index is written in one pass and stays valid when other segments join it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_documents, scratch, slices
from .shingles import text_bytes

SEGMENT_BYTES = 16 << 20
PIECE_BYTES = 4 << 20
BLOCK = 128
QUERIES_PER_BLOCK = 256
BROADCAST_BYTES = 16 << 20
FIRST_WINDOW = 256
LAST_WINDOW = 8_192
TOP = 10

INDEX = "segment bigint, term binary, df int, n_terms bigint, list binary"
NAMES = [f.split()[0] for f in INDEX.split(", ")]
ROWS_PER_BATCH = 16_384
HITS = "query bigint, doc_id bigint, score bigint"
HEAD = np.dtype([("last", "<u4"), ("size", "<u2"), ("pairs", "<u2"), ("doc_bytes", "u1"), ("tf_bytes", "u1")])
PAIR = np.dtype([("tf", "<u4"), ("n", "<u4")])
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])

_FOLD = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_b] = _b + 32 if 0x41 <= _b <= 0x5A else _b
_FOLD = bytes(_FOLD)


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of UTF-8 bytes: runs of digits, letters and all that is not ASCII, A-Z lower-cased."""
    folded, counts, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


# ---- building ----


def _width(top: int) -> int:
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def _put(buffer: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Writes values of a fixed width to their places in a buffer of bytes."""
    cells = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), -1)
    buffer[at[:, None] + np.arange(cells.shape[1])] = cells


def _wide(data: bytes, at: int, count: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}", count, at).astype(np.int64)


class _Segment:
    """Documents in memory until there are enough for a segment."""

    def __init__(self):
        self.terms, self.ids, self.held = defaultdict(), [], 0
        self.terms.default_factory = self.terms.__len__
        self.codes, self.tf, self.distinct, self.lengths = [], [], [], []

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = term_counts(text)
        if counts:
            self.ids.append(doc_id)
            self.codes.append(np.fromiter(map(self.terms.__getitem__, counts), np.int64, len(counts)))
            self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.distinct.append(len(counts))
            self.lengths.append(int(self.tf[-1].sum()))
        self.held += len(text)

    def rows(self, segment: int):
        """The row of documents, then one row for each term, by term, in batches. Documents are numbered by ascending doc_id."""
        docs = np.zeros(len(self.ids), DOC)
        docs["id"], docs["null"], docs["n"] = [i or 0 for i in self.ids], [i is None for i in self.ids], self.lengths
        order = np.lexsort((docs["id"], docs["null"]))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        head = [segment], [None], [len(docs)], [int(docs["n"].sum(dtype=np.int64))], [docs[order].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()))], NAMES)

        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        code, doc, tf = rank[np.concatenate(self.codes)], np.repeat(number, self.distinct), np.concatenate(self.tf)
        by = np.lexsort((doc, code))
        code, doc, tf = code[by], doc[by], tf[by]
        n = docs["n"][order].astype(np.int64)[doc]
        df = np.bincount(code, minlength=len(names))
        start = np.concatenate([[0], np.cumsum(df)])
        blocks = -(-df // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        block = first[code] + (np.arange(len(code)) - start[code]) // BLOCK
        # Pairs that no pair of the same block beats: most occurrences first, then only ever shorter documents.
        best = np.lexsort((n, -tf, block))
        key = n[best] - block[best] * (int(n.max()) + 1)
        low = np.minimum.accumulate(key)
        best = best[np.concatenate([[True], key[1:] < low[:-1]])]
        pairs = np.zeros(len(best), PAIR)
        pairs["tf"], pairs["n"] = tf[best], n[best]
        pair_at = np.concatenate([[0], np.cumsum(np.bincount(block[best], minlength=first[-1]))])
        # A term's list: the number of blocks, their heads, their pairs, and for each block gaps, then occurrences.
        doc_bytes, tf_bytes = _width(len(docs)), _width(int(tf.max()))
        block_term = np.repeat(np.arange(len(names)), blocks)
        nth = np.arange(first[-1]) - first[block_term]
        heads = np.zeros(first[-1], HEAD)
        heads["size"] = np.minimum(df[block_term] - nth * BLOCK, BLOCK)
        heads["last"] = doc[start[block_term] + nth * BLOCK + heads["size"] - 1]
        heads["pairs"] = np.diff(pair_at)
        heads["doc_bytes"], heads["tf_bytes"] = doc_bytes, tf_bytes
        own_pairs = pair_at[first[1:]] - pair_at[first[:-1]]
        size = 4 + blocks * HEAD.itemsize + own_pairs * PAIR.itemsize + df * (doc_bytes + tf_bytes)
        end = np.cumsum(size)
        head_at = end - size + 4
        pairs_from = head_at + blocks * HEAD.itemsize
        body_at = (pairs_from + own_pairs * PAIR.itemsize)[block_term] + nth * BLOCK * (doc_bytes + tf_bytes)
        buffer = np.zeros(int(end[-1]), np.uint8)
        _put(buffer, end - size, blocks.astype("<u4"))
        _put(buffer, head_at[block_term] + nth * HEAD.itemsize, heads)
        pair_term = np.repeat(np.arange(len(names)), own_pairs)
        _put(buffer, pairs_from[pair_term] + (np.arange(len(pairs)) - pair_at[first[pair_term]]) * PAIR.itemsize, pairs)
        gaps = np.diff(doc, prepend=-1) - 1
        gaps[start[:-1]] = doc[start[:-1]]
        place = np.arange(len(code)) - start[code] - nth[block] * BLOCK
        _put(buffer, body_at[block] + place * doc_bytes, gaps.astype(f"<u{doc_bytes}"))
        _put(buffer, body_at[block] + heads["size"][block] * doc_bytes + place * tf_bytes, tf.astype(f"<u{tf_bytes}"))
        offsets = np.concatenate([[0], end])
        for lo in range(0, len(names), ROWS_PER_BATCH):
            hi = min(len(names), lo + ROWS_PER_BATCH)
            here = pa.py_buffer((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32))
            lists = pa.Array.from_buffers(pa.binary(), hi - lo, [None, here, pa.py_buffer(buffer[offsets[lo] : offsets[hi]])])
            zeros = np.zeros(hi - lo, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zeros + segment), pa.array(names[lo:hi], pa.binary()), pa.array(df[lo:hi].astype(np.int32)), pa.array(zeros), lists], NAMES)


def _index(batches):
    """For ``mapInArrow`` over (doc_id, text as binary)."""

    context, segment, number = TaskContext.get().partitionId() << 32, _Segment(), 0
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column(1))
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            segment.add(doc_id, data[offsets[i] : offsets[i + 1]].tobytes())
            if segment.held >= SEGMENT_BYTES:
                if segment.ids:
                    yield from segment.rows(context | number)
                segment, number = _Segment(), number + 1
    if segment.ids:
        yield from segment.rows(context | number)


@dataclass(frozen=True)
class SearchIndex:
    """A written index: ``table`` has a row without a term for every segment, and a row for each of its terms."""

    table: DataFrame
    n_docs: int
    n_terms: int

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None) -> SearchIndex:
        """Index all of ``docs`` (``doc_id``, ``text``; other columns are not read) in ``folder``, a new shared one if None.

        Null and empty texts have no terms and are in no result; they do not count as documents. A null doc_id is
        allowed; it ranks after others of its score. Rows with one doc_id are documents of their own.
        """
        folder = folder or scratch(docs.sparkSession, "search-index")
        narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        narrow.mapInArrow(_index, INDEX).write.parquet(folder)
        return cls.open(docs.sparkSession, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SearchIndex:
        table = spark.read.schema(INDEX).parquet(folder)
        totals = table.filter("term IS NULL").agg(F.sum(F.col("df").cast("bigint")), F.sum("n_terms")).first()
        return cls(table, totals[0] or 0, totals[1] or 0)

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """``queries``' columns with ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each row's ``text``.

        Only documents that score above 0 are returned, fewer than ``k`` if there are fewer; none for a query without
        known terms. Rows of ``queries`` are queries of their own, equal or not; columns with the names of the result's
        are replaced.
        """
        row = F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("_row")
        asked = materialize(queries.select(F.monotonically_increasing_id().alias("query"), row, F.col("text").cast("binary").alias("_text")))
        count = asked.count()
        blocks = max(1, -(-count // QUERIES_PER_BLOCK))
        terms = asked.select("query", "_text").mapInArrow(_query_terms, "query bigint, term binary")
        terms = terms.groupBy("term", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list("query").alias("queries"))
        terms = materialize(terms)
        hits = self._hits(terms, blocks, k)
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        ranked = ranked.filter(F.col("rank") <= k)
        kept = [F.col(f"_row.`{c}`") for c in queries.columns if c not in ("rank", "doc_id", "score")]
        return ranked.join(asked.drop("_text"), "query").select(*kept, "rank", "doc_id", "score")

    def _hits(self, terms: DataFrame, blocks: int, k: int) -> DataFrame:
        lists = self.table.filter("term IS NOT NULL").select("segment", "term", "df", "list")
        size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 8 * F.size("queries") + 32), F.lit(0))).first()[0]
        join_side = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df.hint("shuffle_merge"))
        known = terms.select("term").distinct()
        df = lists.select("term", "df").join(join_side(known), "term").groupBy("term").agg(F.sum(F.col("df").cast("bigint")).alias("all_df"))
        weighed = join_side(terms.join(materialize(df), "term"))
        found = lists.drop("df").join(weighed, "term").select("segment", "block", "term", "all_df", "queries", "list")
        docs = self.table.filter("term IS NULL").select(
            "segment",
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
            F.lit(None).cast("binary").alias("term"),
            F.lit(None).cast("bigint").alias("all_df"),
            F.lit(None).cast("array<bigint>").alias("queries"),
            "list",
        )
        search = _search(self.n_docs, self.n_terms, k)
        return found.unionByName(docs).groupBy("segment", "block").applyInArrow(search, HITS)


def _query_terms(batches):
    for batch in slices(batches):
        found = [(q, t) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in term_counts(text or b"")]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["query", "term"])


# ---- searching one segment ----


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_marks(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length against the mean one, in hundredths: at least 10."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n.astype(np.int64) * n_docs // n_terms
    return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _List:
    """One term's list in one segment. Blocks are unpacked when a query needs them, once."""

    def __init__(self, data: bytes, w: int, marks: np.ndarray, totals: tuple[int, int]):
        self.data, self.w, self.marks, self.unpacked = data, w, marks, {}
        count = int.from_bytes(data[:4], "little")
        self.heads = np.frombuffer(data, HEAD, count, 4)
        self.last = self.heads["last"].astype(np.int64)
        pair_count = self.heads["pairs"].astype(np.int64)
        at = 4 + count * HEAD.itemsize
        pairs = np.frombuffer(data, PAIR, int(pair_count.sum()), at)
        bounds = w * impact(pairs["tf"].astype(np.int64), length_marks(pairs["n"], *totals))
        # The last entry stands for documents beyond the list.
        self.bound = np.append(np.maximum.reduceat(bounds, np.cumsum(pair_count) - pair_count), 0)
        self.most = int(self.bound.max())
        sizes = self.heads["size"].astype(np.int64) * (self.heads["doc_bytes"] + self.heads["tf_bytes"]).astype(np.int64)
        self.at = at + pairs.nbytes + np.cumsum(sizes) - sizes

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and what the term adds to their scores."""
        if b not in self.unpacked:
            size, doc_bytes, tf_bytes = (int(self.heads[f][b]) for f in ("size", "doc_bytes", "tf_bytes"))
            at = int(self.at[b])
            docs = np.cumsum(_wide(self.data, at, size, doc_bytes) + 1) + (int(self.last[b - 1]) if b else -1)
            tf = _wide(self.data, at + size * doc_bytes, size, tf_bytes)
            self.unpacked[b] = docs, self.w * impact(tf, self.marks[docs])
        return self.unpacked[b]

    def add_all(self, scores: np.ndarray, begin: int) -> None:
        """Adds to the scores of the documents from ``begin`` on."""
        end = begin + len(scores)
        for b in range(int(np.searchsorted(self.last, begin)), len(self.last)):
            docs, add = self.block(b)
            lo, hi = np.searchsorted(docs, (begin, end))
            scores[docs[lo:hi] - begin] += add[lo:hi]
            if docs[-1] >= end - 1:
                break

    def blocks_of(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, docs)

    def add_to(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What the term adds to ascending ``docs``, which lie in ``blocks``; only these are unpacked."""
        out = np.zeros(len(docs), np.int64)
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(docs))):
            if blocks[lo] < len(self.last):
                have, add = self.block(int(blocks[lo]))
                where = np.minimum(np.searchsorted(have, docs[lo:hi]), len(have) - 1)
                out[lo:hi] = np.where(have[where] == docs[lo:hi], add[where], 0)
        return out


def best_documents(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best by score, then number: Block-Max MaxScore over windows of documents.

    Lists are sorted by their bounds. Those whose bounds together do not exceed the k-th score so far cannot bring in a
    document by themselves; only the others, the essential ones, are read. What they find is dropped if the bounds of
    the blocks it lies in, of all other lists, cannot lift it above the k-th score, before any of these blocks is
    unpacked; what is left is scored list by list, with bounds giving way to scores. Documents come in ascending order,
    so a later one needs more than the k-th score, and equal scores need no care.
    """
    lists = sorted(lists, key=lambda x: x.most)
    prefix = np.cumsum([x.most for x in lists])
    docs, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    begin, window = 0, FIRST_WINDOW
    while begin < n_docs:
        end = min(n_docs, begin + window)
        spare = int(np.searchsorted(prefix, least, "right"))
        if spare == len(lists):
            break
        window_scores = np.zeros(end - begin, np.int64)
        for x in lists[spare:]:
            x.add_all(window_scores, begin)
        found = np.flatnonzero(window_scores)
        sums = window_scores[found]
        found += begin
        if spare:
            fit = sums + prefix[spare - 1] > least
            found, sums = found[fit], sums[fit]
            where = [x.blocks_of(found) for x in lists[:spare]]
            bounds = [x.bound[b] for x, b in zip(lists, where)]
            rest = np.sum(bounds, axis=0)
            for i in range(spare - 1, -1, -1):
                fit = sums + rest > least
                if not fit.all():
                    found, sums, rest = found[fit], sums[fit], rest[fit]
                    where, bounds = [b[fit] for b in where[: i + 1]], [b[fit] for b in bounds[: i + 1]]
                if not len(found):
                    break
                rest = rest - bounds[i]
                sums = sums + lists[i].add_to(found, where[i])
        fit = sums > least
        if fit.any():
            docs, scores = np.append(docs, found[fit]), np.append(scores, sums[fit])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            least = int(scores[-1]) if len(scores) == k else 0
        begin, window = end, min(LAST_WINDOW, 2 * window)
    return docs, scores


def _search(n_docs: int, n_terms: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("term", "all_df", "queries", "list")}
        docs = next(np.frombuffer(x, DOC) for t, x in zip(columns["term"], columns["list"]) if t is None)
        marks = length_marks(docs["n"], n_docs, n_terms)
        by_query = defaultdict(list)
        for term, df, queries, data in zip(*columns.values()):
            if term is not None:
                own = _List(data, weight(n_docs, df), marks, (n_docs, n_terms))
                for q in queries:
                    by_query[q].append(own)
        out = [(q, *best_documents(lists, len(docs), k)) for q, lists in by_query.items()]
        found = np.concatenate([d for _, d, _ in out]) if out else np.empty(0, np.int64)
        scores = np.concatenate([s for _, _, s in out]) if out else np.empty(0, np.int64)
        ids = pa.array(docs["id"][found], mask=docs["null"][found].astype(bool))
        query = pa.array(np.repeat([q for q, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int64))
        return pa.Table.from_arrays([query, ids, pa.array(scores)], ["query", "doc_id", "score"])

    return run


def op12_lexical_search(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return SearchIndex.build(read_documents(spark, folder)).search(items).select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
