"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed, whatever document they are in.

A sparse suffix array does it. Only suffixes at anchors are sorted (``anchors``), because equal strings have their
anchors at the same offset: every pair of equal strings is seen as a pair of anchored suffixes with equal bytes to the
right and to the left. The leading token of a suffix is its anchor's gram, ordered by bits of its hash; suffixes of one
hash are told apart by the gram's own bytes.

1. Grams that occur once in the corpus are left out. They travel as packed hashes, once per batch of documents.
2. Splitters sampled from the remaining grams cut the order of tokens into ranges. A suffix goes to its range's bucket
   with its gram, up to 60 bytes after it, and the bytes to the left that its strings can begin in.
3. A bucket sorts its suffixes by multikey quicksort, and equal neighbours give the first start of every string.
4. A gram too frequent for one bucket has several. Their first starts are compared across buckets by an aggregate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import compress_text, materialize, read_documents, slices, tiered_join, unpack_text, whole_text
from .shingles import mix64, text_bytes

LENGTH = 100
GRAM = 40
PARTS_PER_PARTITION = 4
BATCH_BYTES = 8 << 20
SAMPLES_PER_PART = 32
MAX_HOT = 5_000
MIN_HOT = 4_000
NEIGHBOURS = 1 << 12
COUNTED = 1 << 31
SMALLEST = -(2**63)

HEAD = np.dtype([("id", "<i8"), ("k", "<i8"), ("t1", "<i8"), ("t2", "<i8"), ("null", "<i8"), ("bytes", "<i8"), ("anchors", "<i8"), ("sha", "S32")])
ITEM = np.dtype([("key", "<u8"), ("id", "<i8"), ("k", "<i8"), ("at", "<i8"), ("near", "<u2"), ("far", "<u2")])


def rows_of(docs: DataFrame) -> DataFrame:
    """``id`` and ``k`` name a row: its doc_id (null: the smallest long) and a hash of doc_id and text."""
    text = whole_text()
    return docs.select(
        F.coalesce("doc_id", F.lit(SMALLEST)).alias("id"), F.xxhash64("doc_id", text).alias("k"), "doc_id", text.cast("binary").alias("text")
    )


def order_key(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The order of leading tokens: the part they are counted in, then further hash bits."""
    return ((hashes % np.uint64(parts)) << np.uint64(32)) | ((hashes // np.uint64(parts)) & np.uint64(0xFFFFFFFF))


# ---- 1. which anchors have a gram that occurs elsewhere ----


def _post(length: int, gram: int, parts: int):
    def run(batches):
        context, number = TaskContext.get(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BATCH_BYTES, "right")) - 1)
                head = np.zeros(end - begin, HEAD)
                for name in ("id", "k", "t1", "t2"):
                    head[name] = batch.column(name).slice(begin, end - begin).to_numpy()
                head["null"] = batch.column("doc_id").slice(begin, end - begin).is_null().to_numpy(zero_copy_only=False)
                # Of copies inside the batch, the row that can come first in the corpus stands for all.
                by = np.lexsort((head["k"], head["id"], head["t2"], head["t1"]))
                posts = np.ones(len(head), bool)
                posts[by[1:]] = (head["t1"][by[1:]] != head["t1"][by[:-1]]) | (head["t2"][by[1:]] != head["t2"][by[:-1]])
                grams = []
                for i in range(begin, end):
                    text = data[offsets[i] : offsets[i + 1]]
                    row = head[i - begin]
                    row["bytes"], row["sha"] = len(text), hashlib.sha256(text).digest()
                    if not posts[i - begin]:  # a copy inside the batch adds nothing
                        grams.append(np.empty(0, np.uint64))
                        continue
                    grams.append(anchors(text, length, gram)[1])
                    row["anchors"] = len(grams[-1])
                yield _pack(head, grams, parts, (context.partitionId() << 32) | number)
                number, begin = number + 1, end

    return run


def _pack(head, grams, parts, batch):
    hashes = np.concatenate(grams)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    fresh = np.diff(hashes, prepend=hashes[:1] + np.uint64(1)) != 0
    group = np.cumsum(fresh) - 1
    count = np.bincount(group) if len(group) else np.empty(0, np.int64)
    several = count[group] > 1 if len(group) else np.empty(0, bool)
    here = np.sort(order[several]).astype("<u4")
    answer = np.where(several, COUNTED + count[group], order)[fresh].astype("<u4") if len(group) else np.empty(0, "<u4")
    keys = order_key(hashes[fresh], parts)
    by = np.argsort(keys, kind="stable")
    keys, answer = keys[by], answer[by]
    low, edges = keys.astype("<u4"), np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(edges)).tolist()
    blobs = [low[edges[i] : edges[i + 1]].tobytes() + answer[edges[i] : edges[i + 1]].tobytes() for i in used]
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([parts + batch % parts] * 2 + used, pa.int32()),
            "batch": pa.array([batch] * (len(used) + 2), pa.int64()),
            "kind": pa.array(["head", "alive"] + ["posted"] * len(used)),
            "blob": pa.array([head.tobytes(), here.tobytes(), *blobs], pa.binary()),
        }
    )


def _answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For one part: the anchors of each batch whose gram another batch has, a sample of such grams, and hot ones."""
    posted = frame[frame["kind"] == "posted"]
    out = [frame.loc[frame["kind"] != "posted", ["batch", "kind", "blob"]]]
    if len(posted):
        lengths = np.array([len(b) // 8 for b in posted["blob"]])
        low = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(posted["blob"], lengths)])
        ask = np.concatenate([np.frombuffer(b, "<u4", n, 4 * n) for b, n in zip(posted["blob"], lengths)]).astype(np.int64)
        batch = np.repeat(np.arange(len(posted)), lengths)
        order = np.argsort(low, kind="stable")
        low, ask, batch = low[order], ask[order], batch[order]
        group = np.cumsum(np.diff(low, prepend=low[:1] + np.uint32(1)) != 0) - 1
        times = np.bincount(group, weights=np.where(ask >= COUNTED, ask - COUNTED, 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        shared = times > 1
        rank = np.cumsum(np.where(shared, times, 0))
        step = max(1, int(rank[-1]) // SAMPLES_PER_PART) if len(rank) else 1
        picked = shared & ((rank // step) != ((rank - np.where(shared, times, 0)) // step))
        keys = (np.uint64(key[0]) << np.uint64(32)) | low[first].astype(np.uint64)
        note = np.stack([keys[picked].view(np.int64), times[picked]]) if picked.any() else np.empty((2, 0), np.int64)
        hot = np.argsort(-times)[:MAX_HOT]
        hot = hot[times[hot] >= MIN_HOT]
        heavy = np.stack([keys[hot].view(np.int64), times[hot]])
        waits = shared[group] & (ask < COUNTED)
        docs, batch = ask[waits].astype("<u4"), batch[waits]
        by = np.argsort(batch, kind="stable")
        docs, batch = docs[by], batch[by]
        edges = np.searchsorted(batch, np.arange(len(posted) + 1))
        blobs = [docs[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        out.append(pd.DataFrame({"batch": posted["batch"].to_numpy(), "kind": "alive", "blob": blobs}))
        notes = [("sample", note.astype("<i8").tobytes()), ("total", np.array([rank[-1] if len(rank) else 0], "<i8").tobytes()), ("hot", heavy.astype("<i8").tobytes())]
        out.append(pd.DataFrame([(-1, k, b) for k, b in notes if b], columns=["batch", "kind", "blob"]))
    return pd.concat(out)


def _decide(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per document of a batch; ``alive`` holds the places of its anchors that other anchors match."""
    head = np.frombuffer(frame["blob"][frame["kind"] == "head"].iloc[0], HEAD)
    found = [np.frombuffer(b, "<u4") for b in frame["blob"][frame["kind"] == "alive"]]
    found = np.unique(np.concatenate(found)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(head["anchors"])])
    cuts = np.searchsorted(found, begin)
    alive = [(found[a:b] - o).astype("<u4").tobytes() if b > a else None for a, b, o in zip(cuts, cuts[1:], begin)]
    sha = [head["sha"][i].ljust(32, b"\0").hex() for i in range(len(head))]
    ids = pd.array(head["id"], dtype="Int64")
    ids[head["null"] != 0] = pd.NA
    return pd.DataFrame({"id": head["id"], "k": head["k"], "doc_id": ids, "t1": head["t1"], "t2": head["t2"], "n_bytes": head["bytes"], "sha": sha, "alive": alive})


# ---- 2. suffixes to the buckets of their ranges ----


def _suffixes(length: int, gram: int, parts: int, splitters: np.ndarray, hot: np.ndarray, pieces: np.ndarray):
    """Blobs of suffixes by bucket. Ranges come first, then the pieces of each hot gram."""
    offsets = len(splitters) + 1 + np.concatenate([[0], np.cumsum(pieces)])

    def run(batches):
        packer, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def flush():
            items, lefts, rights = (np.concatenate(x) for x in zip(*held))
            bucket = np.searchsorted(splitters, items["key"], "right").astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, items["key"]), len(hot) - 1)
                is_hot = hot[at] == items["key"]
                # By document and place, as one document may have any number; neighbours stay together.
                spread = mix64(items["k"].view(np.uint64) ^ mix64((items["at"] // NEIGHBOURS).astype(np.uint64))) % pieces[at].astype(np.uint64)
                bucket[is_hot] = (offsets[at] + spread.astype(np.int64))[is_hot]
            by = np.argsort(bucket, kind="stable")
            bucket = bucket[by]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = []
            for a, b in zip(begin, np.append(begin[1:], len(by))):
                rows = by[a:b]
                blobs.append(packer.compress(items[rows].tobytes() + lefts[rows].tobytes() + rights[rows].tobytes()))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[begin], pa.int64()), "blob": pa.array(blobs, pa.binary())})

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("id", "k", "packed", "alive")]
            for id_, k, packed, alive in zip(*columns):
                text = unpack_text(packed)
                places, hashes, first, last = anchors(text, length, gram)
                alive = np.frombuffer(alive, "<u4")
                places, hashes, first, last = places[alive], hashes[alive], first[alive], last[alive]
                padded = np.concatenate([np.zeros(length, np.uint8), text, np.zeros(length, np.uint8)])
                ahead, behind = sliding_window_view(padded, length), sliding_window_view(padded, length - gram)
                for a in range(0, len(places), 1 << 13):
                    part = slice(a, a + (1 << 13))
                    p = places[part]
                    items = np.zeros(len(p), ITEM)
                    items["key"], items["id"], items["k"], items["at"] = order_key(hashes[part], parts), id_, k, p
                    items["near"], items["far"] = p - last[part], p - first[part]
                    left = behind[p + gram][:, ::-1].copy()
                    left[np.arange(length - gram) >= items["far"][:, None]] = 0
                    right = ahead[p + length]
                    right[np.arange(length) >= length - items["near"][:, None].astype(int)] = 0
                    held.append((items, left, right))
                    size += len(p)
                    if size >= 1 << 16:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


# ---- 3. a bucket ----


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (unsigned, one token per column), by ternary partitioning.

    Every segment of rows that agree in all tokens so far is split around a pivot token into smaller, equal and larger
    rows. The equal ones go on with the next token, the others with the same. All segments of a round are split
    together, so a round is a few array operations.
    """
    n, depth = words.shape
    order = np.arange(n)
    if n < 2 or depth == 0:
        return order
    segments = [(0, n, 0)]
    begin, end, level = (np.array([x]) for x in segments[0])
    while len(begin):
        sizes = end - begin
        rows = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        segment = np.repeat(np.arange(len(begin)), sizes)
        token = words[order[rows], level[segment]]
        low = np.cumsum(sizes) - sizes
        a, b, c = (token[low + (sizes - 1) * i // 2] for i in range(3))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = (token > pivot).astype(np.int8) - (token < pivot)
        by = np.argsort(segment * 3 + side + 1, kind="stable")
        order[rows] = order[rows][by]
        less, same = np.bincount(segment[side < 0], minlength=len(begin)), np.bincount(segment[side == 0], minlength=len(begin))
        one, two = begin + less, begin + less + same
        begin, end, level = np.concatenate([begin, one, two]), np.concatenate([one, two, end]), np.concatenate([level, level + 1, level])
        open_ = (end - begin > 1) & (level < depth)
        begin, end, level = begin[open_], end[open_], level[open_]
    return order


def _words(cells: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Rows of bytes as rows of tokens of eight bytes, with the token ``first`` in front of them."""
    ahead = 0 if first is None else 1
    wide = np.zeros((len(cells), (ahead - (-cells.shape[1] // 8)) * 8), np.uint8)
    wide[:, ahead * 8 : ahead * 8 + cells.shape[1]] = cells
    words = wide.view(np.uint64)
    words.byteswap(inplace=True)
    if first is not None:
        words[:, 0] = first
    return words


def _common(cells: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row in ``order`` and the row before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):  # a piece at a time, as this compares all bytes
        rows = order[at - 1 : at + (1 << 14)]
        differ = cells[rows[1:]] != cells[rows[:-1]]
        out[at : at + len(rows) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), cells.shape[1])
    return out


def repeats(items: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (suffix, offset): strings that a smaller suffix of the bucket has too, and strings seen here first."""
    span = length - gram + 1
    order = multikey_quicksort(_words(right, items["key"]))
    ahead = _common(right, order)  # the gram's bytes are the first ones, so suffixes of one key need not have one gram
    ahead[1:][items["key"][order][1:] != items["key"][order][:-1]] = 0
    back = multikey_quicksort(_words(left))
    behind = _common(left, back)
    rank = np.lexsort((items["at"], items["k"], items["id"]))
    again = np.zeros((len(items), span), bool)
    first = np.zeros((len(items), span), bool)
    by_right, by_left = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    for offset in range(span):
        serves = rank[(items["near"][rank] <= offset) & (offset <= items["far"][rank])]
        if not len(serves):
            continue
        by_right[order] = np.cumsum(ahead < length - offset)
        by_left[back] = np.cumsum(behind < offset) if offset else 0
        string = by_right[serves] * (len(items) + 1) + by_left[serves]
        by = np.argsort(string, kind="stable")
        new = np.diff(string[by], prepend=-1) != 0
        first[serves[by[new]], offset] = True
        again[serves[by[~new]], offset] = True
    return again, first


def joined_spans(ids: np.ndarray, k: np.ndarray, at: np.ndarray, to: np.ndarray) -> pd.DataFrame:
    """Spans of documents, with those that overlap or touch as one."""
    by = np.lexsort((at, k, ids))
    ids, k, at, to = ids[by], k[by], at[by], to[by]
    document = np.cumsum((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(k, prepend=k[:1]) != 0))
    reach = np.maximum.accumulate(document * (1 << 40) + to)  # how far the spans so far go, by document
    new = np.ones(len(by), bool)
    new[1:] = document[1:] * (1 << 40) + at[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(by)) - 1 if len(by) else by
    return pd.DataFrame({"id": ids[new], "k": k[new], "at": at[new], "to": reach[last] - document[last] * (1 << 40)})


def _bucket(length: int, gram: int, ranges: int):
    out = {"kind": "int32", "id": "int64", "k": "int64", "at": "int64", "to": "int64", "s1": "int64", "s2": "int64"}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for blob in frame["blob"]:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = len(raw) // (ITEM.itemsize + 2 * length - gram)
            cells = np.frombuffer(raw, np.uint8, offset=n * ITEM.itemsize)
            left, right = cells[: n * (length - gram)], cells[n * (length - gram) :]
            parts.append((np.frombuffer(raw, ITEM, n), left.reshape(n, length - gram), right.reshape(n, length)))
        items, left, right = (np.concatenate(x) for x in zip(*parts))
        del parts, raw, cells
        again, first = repeats(items, left, right, length, gram)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge > 0)
        high = np.nonzero(edge < 0)[1] - 1
        at = items["at"][row]
        found = [joined_spans(items["id"][row], items["k"][row], at - high, at - low + length).assign(kind=0, s1=0, s2=0)]
        if key[0] >= ranges:  # a piece of a hot gram: what is first here is compared with the other pieces
            row, offset = np.nonzero(first)
            shown = [left[r, :o][::-1].tobytes() + right[r, : length - o].tobytes() for r, o in zip(row.tolist(), offset.tolist())]
            marks = [hashlib.blake2b(s, digest_size=16, salt=int(o).to_bytes(8, "little")).digest() for s, o in zip(shown, offset)]
            marks = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            at = items["at"][row] - offset
            found.append(pd.DataFrame({"kind": 1, "id": items["id"][row], "k": items["k"][row], "at": at, "to": at + length, "s1": marks[:, 0], "s2": marks[:, 1]}))
        return pd.concat(found)[list(out)].astype(out)

    return run


# ---- 4. spans and the texts that remain ----


def _cut(batches):
    for batch in slices(batches):
        removed, spans, sha, kept = [], [], [], []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("found")):
            text = unpack_text(packed)
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, found.values.field("at").to_numpy(zero_copy_only=False), 1)
            np.add.at(edge, found.values.field("to").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(edge[:-1]) > 0
            rest = text[~gone].tobytes()
            removed.append(int(gone.sum())), spans.append(int((np.diff(gone, prepend=False) & gone).sum()))
            sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
        yield pa.RecordBatch.from_pydict(
            {"id": batch.column("id"), "k": batch.column("k"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha), "kept": pa.array(kept, pa.binary())}
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``rows`` (one per row, with ``first`` false for copies) and ``spans`` (id, k, at, to; may overlap) of the others."""
    if not 8 <= gram < length <= 60_000:
        raise ValueError("gram has to be at least 8 and below length")
    spark = docs.sparkSession
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows_of(docs)
    hashed = named.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    posted = hashed.mapInArrow(_post(length, gram, parts), "part int, batch bigint, kind string, blob binary")
    answers = materialize(posted.groupBy("part").applyInPandas(_answer, "batch bigint, kind string, blob binary"))
    decided = answers.filter("batch >= 0").groupBy("batch").applyInPandas(
        _decide, "id bigint, k bigint, doc_id bigint, t1 bigint, t2 bigint, n_bytes bigint, sha string, alive binary"
    )
    decided = materialize(decided)
    lead = decided.groupBy("t1", "t2").agg(F.min(F.struct("id", "k")).alias("_lead"), F.count(F.lit(1)).alias("_m"))
    lead = materialize(lead)
    several = lead.filter("_m > 1")
    grouped = tiered_join(decided, several, ["t1", "t2"], "_m")
    is_first = (F.col("_lead.id") == F.col("id")) & (F.col("_lead.k") == F.col("k"))
    single = decided.join(lead.filter("_m = 1").select("t1", "t2").hint("shuffle_merge"), ["t1", "t2"], "left_semi")
    columns = ["id", "k", "doc_id", "n_bytes", "sha", "alive"]
    rows = materialize(grouped.select(*columns, is_first.alias("first")).unionByName(single.select(*columns, F.lit(True).alias("first"))))

    notes = answers.filter("batch < 0")
    total = sum(int(np.frombuffer(r[0], "<i8")[0]) for r in notes.filter("kind = 'total'").select("blob").toLocalIterator())
    sample = [np.frombuffer(r[0], "<i8").reshape(2, -1) for r in notes.filter("kind = 'sample'").select("blob").collect()]
    # A hot gram has more than 1/5000 of all suffixes, so there are at most 5,000.
    limit = max(MIN_HOT, -(-total // MAX_HOT))
    hot = [np.frombuffer(r[0], "<i8").reshape(2, -1) for r in notes.filter("kind = 'hot'").select("blob").toLocalIterator()]
    hot = np.concatenate([h[:, h[1] >= limit] for h in hot], axis=1) if hot else np.empty((2, 0), np.int64)
    hot = hot[:, np.argsort(hot[0].view(np.uint64))]
    keys = np.sort(np.concatenate([s[0] for s in sample]).view(np.uint64)) if sample else np.empty(0, np.uint64)
    splitters = np.unique(keys[:: max(1, len(keys) // parts)])
    pieces = -(-hot[1] // limit)

    texts = named.select("id", "k", "text").mapInArrow(compress_text, "id bigint, k bigint, packed binary")
    live = rows.filter("first and alive is not null").dropDuplicates(["id", "k"]).select("id", "k", "alive")
    work = texts.join(live.hint("shuffle_merge"), ["id", "k"]).dropDuplicates(["id", "k"]).select("id", "k", "packed", "alive")
    blobs = work.mapInArrow(_suffixes(length, gram, parts, splitters, hot[0].view(np.uint64), pieces), "bucket bigint, blob binary")
    found = blobs.groupBy("bucket").applyInPandas(
        _bucket(length, gram, len(splitters) + 1), "kind int, id bigint, k bigint, at bigint, to bigint, s1 bigint, s2 bigint"
    )
    found = materialize(found)
    spans = found.filter("kind = 0").select("id", "k", "at", "to")
    if hot.size:
        pieces_first = found.filter("kind = 1")
        least = pieces_first.groupBy("s1", "s2").agg(F.min(F.struct("id", "k", "at")).alias("m"))
        later = pieces_first.join(least.hint("shuffle_merge"), ["s1", "s2"]).filter(F.struct("id", "k", "at") != F.col("m"))
        spans = spans.unionByName(later.select("id", "k", "at", "to"))
    return rows, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``.

    ``kept`` is null where nothing is removed and empty where everything is. Documents come in the order of doc_id, a
    null one first, rows of one doc_id by a hash of their text. Rows equal in both are one document and are returned as
    often as they occur. Null texts count as empty. Strings never cross documents. Strings are compared by their bytes;
    only equal texts and the strings compared across buckets are known by hashes, of 128 bits.
    """
    rows, spans = repeated_spans(docs, length, gram)
    texts = rows_of(docs).select("id", "k", "text").mapInArrow(compress_text, "id bigint, k bigint, packed binary")
    grouped = spans.groupBy("id", "k").agg(F.collect_list(F.struct("at", "to")).alias("found"))
    cut = texts.join(grouped.hint("shuffle_merge"), ["id", "k"]).dropDuplicates(["id", "k"]).select("id", "k", "packed", "found")
    cut = cut.mapInArrow(_cut, "id bigint, k bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    gone = ~F.col("first") & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("bigint")
    return rows.join(cut.hint("shuffle_merge"), ["id", "k"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op2_suffix_dedup(spark, folder):
    return remove_repeats(read_documents(spark, folder)).drop("kept")
