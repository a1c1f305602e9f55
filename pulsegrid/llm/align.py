"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, by windows between white-space anchors.

Texts are tokenised whole by both tokenizers. A place where tokens of both end is verified on byte offsets; where the
next token of both carries the mark of a space, it is an anchor. Windows between anchors are mostly single words, so
the alignment of a window is looked up by its two tuples of ids, and worked out only if it is new.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_documents, scratch, slices

TOKENIZERS = "/opt/tokenizers"
TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
# Fixed value: how the vocabulary's texts were cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACED = re.compile(" +[^ ]*")
MIXED = re.compile(r"[^\S ] ")
WINDOWS_KEPT = 300_000
LONGEST_KEPT = 64
DOCS_PER_BATCH = 64
BATCH_CHARS = 1 << 20
HOT_PAIRS = 50_000
PAIR_BITS = 32

ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<struct<pair: bigint, n: bigint>>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every id, their number, and whether they begin with a space."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.lengths = [len(x) for x in spelled]
        self.length = np.array(self.lengths, np.int64)
        self.spaced = np.array([x[:1] == b" " for x in spelled])


class ByteLevel(Vocabulary):
    """A byte-level BPE file; texts are encoded behind a space, and no string is a special token.

    Every byte has an id, so the tokens of a text always spell it. The file's merges stand in the order of the ids they
    make, so the ids of the bytes say which pair is merged first.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        super().__init__([x for x, _ in sorted(ranks.items(), key=lambda item: item[1])])
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"ids of {path} have gaps")
        self.encoding = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts of texts; a text's first part begins with the space in front of it."""
        return list(map(self.encoding.encode_ordinary, parts))


class Pieces(Vocabulary):
    """A SentencePiece file that puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: No piece has a space behind another character, so no merge goes across such a place.
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.model.piece_to_id("▁")

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts of texts that begin with a space, which the model adds by itself; none for an empty rest."""
        return [x or [self.space] for x in self.model.encode([p[1:] for p in parts], num_threads=1)]


class Parts(dict):
    """Numbers of parts of texts, and by number their packed ids in both vocabularies.

    A text with a space in front of it is cut before every space that stands behind something else than white space.
    Neither tokenizer joins what such a place divides, so the ids of the parts are those of the whole text, and a part
    seen before is not tokenised again. ``wrong`` has the numbers of parts that B's ids do not spell.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        super().__init__()
        self.vocabularies = a, b
        self.ids_a: list[bytes] = []
        self.ids_b: list[bytes] = []
        self.wrong: set[int] = set()

    def cut(self, text: str) -> list[str]:
        text = " " + text
        if not self.vocabularies[1].apart:
            return [text]
        found = SPACED.findall(text)
        if not MIXED.search(text):
            return found
        out = found[:1]
        for part in found[1:]:
            if out[-1][-1].isspace():
                out[-1] += part
            else:
                out.append(part)
        return out

    def numbers(self, parts: list[str]) -> list[int]:
        """Numbers of parts, until the next call. Long parts are tokenised each time."""
        if len(self.ids_a) > WINDOWS_KEPT:
            self.clear()
            self.wrong.clear()
            del self.ids_a[:], self.ids_b[:]
        found = list(map(self.get, parts))
        new = list(dict.fromkeys([p for p, x in zip(parts, found) if x is None]))
        if new:
            made = dict(zip(new, range(len(self.ids_a), len(self.ids_a) + len(new))))
            self._tokenise(new)
            found = [made[p] if x is None else x for p, x in zip(parts, found)]
            if max(map(len, new)) > LONGEST_KEPT:
                made = {p: x for p, x in made.items() if len(p) <= LONGEST_KEPT}
            self.update(made)
        return found

    def _tokenise(self, new: list[str]) -> None:
        first = len(self.ids_a)
        for vocabulary, kept in zip(self.vocabularies, (self.ids_a, self.ids_b)):
            ids = vocabulary.encode(new)
            count = list(map(len, ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(count))
            raw, end = flat.tobytes(), np.cumsum(count)
            kept += [raw[a:b] for a, b in zip((4 * (end - count)).tolist(), (4 * end).tolist())]
        spelled = list(map(str.encode, new))
        joined = b"".join(map(vocabulary.spelled.__getitem__, flat.tolist()))
        if joined != b"".join(spelled) or (np.cumsum(vocabulary.length[flat])[end - 1] != np.cumsum(list(map(len, spelled)))).any():
            self.wrong.update(first + i for i, (x, s) in enumerate(zip(ids, spelled)) if b"".join(map(vocabulary.spelled.__getitem__, x)) != s)


class Windows(dict):
    """Numbers of windows by their ids, packed as (number of A's ids, A's ids, B's ids) in 32 bits each.

    By number: the groups as text, how many they are, how many links they have, and the linked pairs in 64 bits each, as
    often as they are linked. A group with very many links has its pairs in ``many`` instead, with counts.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        super().__init__()
        self.a, self.b = a, b
        self.text: list[str] = []
        self.pairs: list[bytes] = []
        self.groups, self.links, self.listed = array("q"), array("q"), array("q")
        self.many: dict[int, Counter] = {}
        # An id of either side behind what stands before it in the text of a window's groups.
        n_a, n_b = len(a.spelled), len(b.spelled)
        self.written = [f"{mark}{i}" for mark in ("", ";", ",") for i in range(n_a)] + [f"{mark}{i}" for mark in ("|", ",") for i in range(n_b)]

    def forget(self) -> None:
        """All windows, if there are too many; numbers given before are void then."""
        if len(self.text) > WINDOWS_KEPT:
            self.clear()
            self.many.clear()
            for kept in (self.text, self.pairs, self.groups, self.links, self.listed):
                del kept[:]

    def numbers(self, keys: list[bytes]) -> list[int]:
        """Numbers of windows; new ones are aligned together. Long ones are worked out each time."""
        self.forget()
        found = list(map(self.get, keys))
        new = list(dict.fromkeys([k for k, x in zip(keys, found) if x is None]))
        if new:
            made = dict(zip(new, range(len(self.text), len(self.text) + len(new))))
            self._align(new)
            found = [made[k] if x is None else x for k, x in zip(keys, found)]
            if max(map(len, new)) > 4 * LONGEST_KEPT:
                made = {k: x for k, x in made.items() if len(k) <= 4 * LONGEST_KEPT}
            self.update(made)
        return found

    def _align(self, windows: list[bytes]) -> None:
        """Cuts both sides of each window where tokens of both end, and notes its groups, links and pairs."""
        packed = np.frombuffer(b"".join(windows), np.int32)
        size = np.fromiter(map(len, windows), np.int64, len(windows)) // 4
        begin = np.cumsum(size) - size
        n_a = packed[begin].astype(np.int64)
        place = np.arange(len(packed)) - np.repeat(begin, size)
        of_a = (place > 0) & (place <= np.repeat(n_a, size))
        a, b = packed[of_a].astype(np.int64), packed[place > np.repeat(n_a, size)].astype(np.int64)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        stop_a, stop_b = last_a + 1, at[last_a] + 1
        in_a, in_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        window = np.searchsorted(np.cumsum(n_a), last_a, "right")
        links = in_a * in_b
        total = np.bincount(window, links, len(windows)).astype(np.int64)

        # Text: of each group A's ids, then B's, each behind its mark.
        length = in_a + in_b
        group_at = np.cumsum(length) - length
        codes = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) - np.repeat(stop_a - in_a, in_a)
        place_b = np.arange(len(b)) - np.repeat(stop_b - in_b, in_b)
        opens = np.repeat(np.diff(window, prepend=-1) > 0, in_a)
        ids_a, ids_b = len(self.a.spelled), len(self.b.spelled)
        codes[np.repeat(group_at, in_a) + place_a] = a + ids_a * np.where(place_a > 0, 2, np.where(opens, 0, 1))
        codes[np.repeat(group_at + in_a, in_b) + place_b] = b + 3 * ids_a + ids_b * (place_b > 0)
        marks = list(map(self.written.__getitem__, codes.tolist()))
        stops = np.cumsum(size - 1).tolist()
        self.text += ["".join(marks[x:y]) for x, y in zip([0, *stops], stops)]

        # Pairs: every one of A's ids with every one of B's, for groups of an ordinary size.
        shown = np.where(links <= LONGEST_KEPT, links, 0)
        group = np.repeat(np.arange(len(links)), shown)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(shown) - shown, shown)
        left = a[(stop_a - in_a)[group] + nth // in_b[group]]
        right = b[(stop_b - in_b)[group] + nth % in_b[group]]
        raw = ((left << PAIR_BITS) | right).tobytes()
        listed = np.bincount(window, shown, len(windows)).astype(np.int64)
        stops = (8 * np.cumsum(listed)).tolist()
        first = len(self.pairs)
        self.pairs += [raw[x:y] for x, y in zip([0, *stops], stops)]
        for kept, values in ((self.groups, np.bincount(window, minlength=len(windows)).astype(np.int64)), (self.links, total), (self.listed, listed)):
            kept.frombytes(values.tobytes())
        # Larger groups by counts of ids: n and m tokens have n * m links, but few different pairs.
        for g in np.flatnonzero(links > LONGEST_KEPT).tolist():
            found = self.many.setdefault(first + int(window[g]), Counter())
            count_b = Counter(b[stop_b[g] - in_b[g] : stop_b[g]].tolist()).items()
            for x, n in Counter(a[stop_a[g] - in_a[g] : stop_a[g]].tolist()).items():
                for y, m in count_b:
                    found[(x << PAIR_BITS) | y] += n * m


class Aligner:
    def __init__(self, folder: str):
        self.a, self.b = ByteLevel(f"{folder}/{TOKENIZER_A}"), Pieces(f"{folder}/{TOKENIZER_B}")
        self.parts, self.windows = Parts(self.a, self.b), Windows(self.a, self.b)

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Packed windows of the tokens of texts behind one another, and where windows end in tokens of A.

        A window ends where tokens of both end and the next ones of both begin with a space; a text begins with one.
        """
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.searchsorted(end_b, end_a)
        ends = np.flatnonzero(end_b[at] == end_a)
        inner = ends[:-1]
        ends = np.append(inner[self.a.spaced[a[inner + 1]] & self.b.spaced[b[at[inner] + 1]]], len(a) - 1)
        cut_a, cut_b = ends + 1, at[ends] + 1
        n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        size = 1 + n_a + n_b
        begin = np.cumsum(size) - size
        packed = np.empty(int(size.sum()), np.int32)
        packed[begin] = n_a
        packed[np.repeat(begin + 1 - (cut_a - n_a), n_a) + np.arange(len(a))] = a
        packed[np.repeat(begin + 1 + n_a - (cut_b - n_b), n_b) + np.arange(len(b))] = b
        raw = packed.tobytes()
        return cut_a, [raw[x:y] for x, y in zip((4 * begin).tolist(), (4 * (begin + size)).tolist())]

    def texts(self, texts: list[str | None]) -> Aligned:
        known = self.windows
        nothing = np.empty(0, np.int32)
        parts = [self.parts.cut(x) if x else [] for x in texts]
        found = self.parts.numbers(list(chain.from_iterable(parts)))
        ids_a, ids_b, wrong = self.parts.ids_a, self.parts.ids_b, self.parts.wrong
        tokens, at = [], 0
        for own in parts:
            own, at = found[at : at + len(own)], at + len(own)
            right = own and (not wrong or wrong.isdisjoint(own))
            tokens.append(tuple(np.frombuffer(b"".join(map(ids.__getitem__, own)), np.int32) if right else nothing for ids in (ids_a, ids_b)))
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in zip(*tokens))
        if not n_a.any():
            zeros = np.zeros(len(texts), np.int64)
            return Aligned(n_a, n_b, zeros, zeros, [""] * len(texts), zeros, np.empty(0, np.int64), np.empty(0, np.int64))
        cut_a, keys = self.cut(*(np.concatenate(side) for side in zip(*tokens)))
        numbers = known.numbers(keys)
        ends = np.where(n_a > 0, np.searchsorted(cut_a, np.cumsum(n_a), "right"), 0)
        ends = np.maximum.accumulate(ends)
        begins = np.concatenate([[0], ends[:-1]])
        text_of = np.repeat(np.arange(len(texts)), ends - begins)
        window = np.array(numbers)
        by_window = lambda values: np.frombuffer(values, np.int64)[window]
        sums = lambda values: np.bincount(text_of, by_window(values), len(texts)).astype(np.int64)
        spelled = [";".join(map(known.text.__getitem__, numbers[a:b])) for a, b in zip(begins.tolist(), ends.tolist())]

        # Links by text and pair: one number for both, sorted and counted.
        pairs = np.frombuffer(b"".join(map(known.pairs.__getitem__, numbers)), np.int64)
        place, times = np.repeat(text_of, by_window(known.listed)), np.ones(len(pairs), np.int64)
        if known.many:
            more = [(t, p, n) for t, i in zip(text_of.tolist(), numbers) for p, n in known.many.get(i, {}).items()]
            extra = np.array(more, np.int64).reshape(-1, 3)
            place, pairs, times = (np.concatenate(x) for x in zip((place, pairs, times), extra.T))
        ids_b = len(self.b.spelled)
        key = place * (len(self.a.spelled) * ids_b) + (pairs >> PAIR_BITS) * ids_b + (pairs & ((1 << PAIR_BITS) - 1))
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place, pairs, times = place[order][first], pairs[order][first], np.add.reduceat(times, first)
        return Aligned(n_a, n_b, sums(known.groups), sums(known.links), spelled, np.bincount(place, minlength=len(texts)), pairs, times)


class Aligned(NamedTuple):
    """Several texts: numbers and groups of each, how many different pairs it links, and these pairs with their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    n_pairs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(folder: str) -> Aligner:
    """One for each worker: reading the vocabularies takes a second, and known windows serve the next task too."""
    if folder not in _ALIGNERS:
        _ALIGNERS[folder] = Aligner(folder)
    return _ALIGNERS[folder]


def _align(folder: str):
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches):
        aligner, number = _aligner(folder), TaskContext.get().partitionId() << 40
        for batch in slices(batches, DOCS_PER_BATCH):
            texts = batch.column(1).to_pylist()
            for at, end in _few_at_a_time(texts):
                found = aligner.texts(texts[at:end])
                links = pa.StructArray.from_arrays([pa.array(found.pairs), pa.array(found.times)], ["pair", "n"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(found.n_pairs)]).astype(np.int32))
                rows = pa.array(np.arange(number + at, number + end))
                numbers = [pa.array(x) for x in found[:4]]
                columns = [rows, batch.column(0).slice(at, end - at), *numbers, pa.array(found.groups), pa.ListArray.from_arrays(offsets, links)]
                yield pa.RecordBatch.from_arrays(columns, names)
            number += len(texts)

    return run


def _few_at_a_time(texts: list[str | None]):
    """Ranges of about a megabyte of text, so that a very long one is never held with many others."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_CHARS):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def alignments(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Both tokenizations of each text as ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order), with counts and ``links``.

    ``links`` holds each linked pair of ids, A's in the upper 32 bits, with the number of its links in the text; a link
    is a pair of token occurrences whose bytes share a group. ``row`` numbers the rows of this table: write it before
    reading it twice. Of ``docs``, only ``doc_id`` and ``text`` are read, so other columns may have any name.

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros, no
    links, and an empty ``groups``. Repeated rows give a row each, null doc_ids too. ``folder`` holds the vocabularies
    on every machine.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_align(folder), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``docs`` (documents that hold it linked) and ``best`` (no pair of its A id is in more documents)."""
    counts = materialize(aligned.select(F.inline("links")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    # One row for each id of the vocabulary at most.
    top = counts.groupBy(F.shiftright("pair", PAIR_BITS).alias("a")).agg(F.max("docs").alias("top"))
    joined = counts.withColumn("a", F.shiftright("pair", PAIR_BITS)).join(F.broadcast(top), "a")
    return materialize(joined.select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")))


def with_corpus_counts(aligned: DataFrame) -> DataFrame:
    """A written table of ``alignments`` with ``n_best`` (links whose pair is a best one) and ``count_sum`` (of all links).

    Frequent pairs, at most 50,000 whatever the corpus, are looked up where the links are; what is left of a row after
    that is one sum. All other links meet their counts in a shuffle by pair, in which no pair is frequent.
    """
    pairs = pair_counts(aligned)
    total = pairs.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    limit = max(2, math.ceil(total / HOT_PAIRS))
    hot, cold = F.broadcast(pairs.filter(F.col("docs") >= limit)), pairs.filter(F.col("docs") < limit)
    links = aligned.select("row", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")]
    near = links.join(hot, "pair").select("row", "n", "docs", "best")
    far = links.join(hot, "pair", "left_anti").join(cold.hint("shuffle_merge"), "pair").select("row", "n", "docs", "best")
    scored = near.unionByName(far).groupBy("row").agg(*sums)
    zero = F.lit(0).cast("bigint")
    out = aligned.drop("links").join(scored, "row", "left")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def op13_token_alignment(spark, folder):
    aligned = alignments(read_documents(spark, folder))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    where = scratch(spark, "alignments")
    aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links").write.parquet(where)
    done = with_corpus_counts(spark.read.parquet(where))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
