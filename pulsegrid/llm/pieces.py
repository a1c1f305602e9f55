"""SentencePiece encoding and decoding of BPE vocabularies by streaming Viterbi."""

from __future__ import annotations

import heapq
import threading
from array import array
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_documents, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_CHARS = 1 << 20
LONG_WORD = 256
CACHE_ENTRIES = 450_000
COMMIT_EVERY = 64
IDLE_SECONDS = 5


@dataclass
class Pieces:
    """A vocabulary: ``ids`` and ``scores`` of normal pieces, the id of every byte, and what each id stands for."""

    ids: dict[str, int]
    scores: dict[int, float]
    byte_ids: list[int]
    unknown: int
    spelled: list[bytes]
    longest: int
    inside: set[str] = field(default_factory=set)
    sizes: dict[str, tuple[int, ...]] = field(default_factory=dict)


def read_pieces(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model file that holds a BPE model with identity normalisation and a leading space."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only BPE models with identity normalisation and a leading space are read")
    kind = {p.piece: (i, p.score, p.type) for i, p in enumerate(model.pieces)}
    ids = {p: i for p, (i, _, t) in kind.items() if t == 1}
    spelled = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
    byte_ids = [kind[f"<0x{b:02X}>"][0] for b in range(256)] if model.trainer_spec.byte_fallback else []
    unknown = next(i for i, _, t in kind.values() if t == 2)
    spelled[unknown] = " ⁇ ".encode()
    inside = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
    ends: dict[str, set[int]] = {}
    for p in ids:
        if len(p) > 1:
            ends.setdefault(p[-2:], {1}).add(len(p))
    sizes = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
    return Pieces(ids, {i: s for i, s, t in kind.values() if t == 1}, byte_ids, unknown, spelled, max(map(len, ids)), inside, sizes)


class Encoder:
    """Encodes text of any length with a window of the longest piece.

    A lattice position is a place between two characters. Of the pieces that end there, one survives: the piece that
    follows the survivor at its own start without being merged otherwise, which is decided for two pieces at a time by
    merging their characters in the order of the vocabulary's scores. The survivors of all prefixes are then the
    pieces of byte-pair encoding. Only positions within the longest piece of the last one can be continued; where the
    paths of all of them go back to one boundary, the ids before it are final and leave the window.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.fits: dict[int, bool] = {}
        self.words = _Words(self)

    def merge(self, text: str) -> list[int]:
        """Ids of a short text by merging neighbours, best score first and leftmost of equal ones."""
        ids, scores = self.p.ids, self.p.scores
        cells, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(a, b):
            if a >= 0 and b < len(text):
                found = ids.get(cells[a] + cells[b])
                if found is not None:
                    heapq.heappush(heap, (-scores[found], a, b, cells[a], cells[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if cells[a] != left or cells[b] != right or after[a] != b:
                continue
            cells[a], cells[b] = left + right, ""
            after[a] = after[b]
            if after[b] < len(text):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [ids.get(c, -1) for c in cells if c]

    def follows(self, left: int, right: int, spelled: str) -> bool:
        """Whether piece ``right`` stays as it is after piece ``left``; ``spelled`` is their text."""
        if len(self.fits) >= 2 * CACHE_ENTRIES:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self.merge(spelled) == [left, right]
        return known

    def advance(self, text: str, start: int, stop: int, base: int, last: list[int], width: list[int]) -> None:
        """Append the survivors, and their lengths, of positions ``start`` to ``stop``; ``last`` begins at ``base``."""
        known, fits, sizes, one = self.p.ids.get, self.fits.get, self.p.sizes.get, (1,)
        for end in range(start, stop):
            for size in sizes(text[end - 2 : end], one) if end > 1 else one:
                at = end - size - base
                if at < 0:
                    continue
                piece = known(text[end - size : end])
                if piece is None:
                    continue
                left = last[at]
                if left >= 0:
                    fit = fits(left << 32 | piece)
                    if fit is False or fit is None and not self.follows(left, piece, text[end - size - width[at] : end]):
                        continue
                last.append(piece)
                width.append(size)
                break
            else:
                last.append(-1)
                width.append(1)

    def path(self, text: str, at: int, base: int, last: list[int], width: list[int]) -> list[int]:
        """Ids from ``base`` to ``at``. Unknown characters are given by their bytes, or by the unknown id."""
        found = []
        while at > base:
            piece = last[at - base]
            if piece >= 0:
                found.append(piece)
            elif self.p.byte_ids:
                found += [self.p.byte_ids[b] for b in reversed(text[at - 1].encode())]
            else:
                found.append(self.p.unknown)
            at -= width[at - base]
        found.reverse()
        return found

    def viterbi(self, text: str):
        """Yields lists of final ids."""
        longest, base, last, width = self.p.longest, 0, [-1], [0]
        for start in range(1, len(text) + 1, COMMIT_EVERY):
            end = min(start + COMMIT_EVERY - 1, len(text))
            self.advance(text, start, end + 1, base, last, width)
            # Paths of all positions that can be continued; the longest piece reaches back so far and no further.
            alive = {end} if end == len(text) else set(range(max(base, end - longest + 1), end + 1))
            while len(alive) > 1:
                far = max(alive)
                alive.discard(far)
                alive.add(far - width[far - base])
            meet = alive.pop()
            yield self.path(text, meet, base, last, width)
            last, width, base = last[meet - base :], width[meet - base :], meet

    def final(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers. A text that fits the window is decided at its end."""
        if len(text) <= COMMIT_EVERY:
            last, width = [-1], [0]
            self.advance(text, 1, len(text) + 1, 0, last, width)
            return array("i", self.path(text, len(text), 0, last, width)).tobytes()
        return b"".join([array("i", ids).tobytes() for ids in self.viterbi(text)])

    def segments(self, text: str):
        """Cuts where no piece can span: all paths meet there, so each part stands for itself."""
        begin, inside = 0, self.p.inside
        for at in range(1, len(text)):
            if text[at - 1 : at + 1] not in inside:
                yield text[begin:at]
                begin = at
        yield text[begin:]

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text. Works through slices that end before a space."""
        if not text:
            return np.empty(0, "<i4")
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE_CHARS:
                end = text.find(" ", at + SLICE_CHARS)
                while end > 0 and text[end - 1] in " " + MARK:  # a run of spaces stays together
                    end = text.find(" ", end + 1)
                end = len(text) if end < 0 else end
            part = text[at:end]
            if at == 0:
                part = " " + part
            if MARK in part or "  " in part or part[0] != " " or part[-1] == " ":
                out.append(self._spaced(part.replace(" ", MARK)))
            else:
                out.append(b"".join(map(self.words.__getitem__, part[1:].split(" "))))
            at = end
        return np.frombuffer(b"".join(out), "<i4")

    def _spaced(self, part: str) -> bytes:
        """Slices with runs of spaces: no piece has a space after another character, so words begin at spaces."""
        out, begin = [], 0
        while begin < len(part):
            at = begin
            while at < len(part) and part[at] == MARK:
                at += 1
            end = part.find(MARK, at)
            end = len(part) if end < 0 else end
            out.append(self.words[part[begin + 1 : end]] if part[begin] == MARK and at == begin + 1 else self.final(part[begin:end]))
            begin = end
        return b"".join(out)


class _Words(dict):
    """Ids of words that begin with a space and of parts of words, in two generations of bounded size.

    What is not found among the younger entries is taken from the older ones before it is made. When the younger ones
    are too many, they become the older ones.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self.encoder.final(MARK + word)
        out = self.old.get(word)
        if out is None and word[:1] == " ":  # a part that stands inside a word, under a name that no word has
            out = self.encoder.final(word[1:])
        elif out is None:
            first, *others = self.encoder.segments(MARK + word)
            if others:
                begin = self[first[1:]] if len(first) > 1 else self[" " + MARK]
                out = begin + b"".join([self[" " + part] for part in others])
            else:
                out = self.encoder.final(first)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


def decode(ids: np.ndarray, spelled: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join(map(spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_LAST: list[Encoder] = []
_CLEAR: list[threading.Timer] = []


@contextmanager
def _encoder(pieces: Pieces):
    """One encoder per worker process, so that what it remembers serves the next tasks too.

    A worker that stays without such a task for some seconds gives the memory back to other stages.
    """
    while _CLEAR:
        _CLEAR.pop().cancel()
    if not _LAST or _LAST[0].p is not pieces:
        _LAST[:] = [Encoder(pieces)]
    try:
        yield _LAST[0]
    finally:
        timer = threading.Timer(IDLE_SECONDS, _LAST.clear)
        timer.daemon = True
        _CLEAR.append(timer)
        timer.start()


def _encode(shared):
    def run(batches):
        with _encoder(shared.value) as encoder:
            for batch in slices(batches):
                ids, exact = [], []
                for text in batch.column("text").to_pylist():
                    ids.append(encoder.encode(text or ""))
                    exact.append(decode(ids[-1], encoder.p.spelled) == (text or ""))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, "<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(exact, pa.bool_())], [*batch.schema.names, "ids", "exact"])

    return run


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with ``ids`` and ``exact``, which tells whether decoding the ids gives the text again.

    The ids are those of the vocabulary's byte-pair encoding. The vocabulary is read on the driver and broadcast; its
    size does not depend on the corpus. Null texts count as empty and have no ids. A text with the character U+2581
    encodes like one with spaces, so it does not come back. Columns named ``ids`` or ``exact`` are replaced.
    """
    docs = docs.drop("ids", "exact")
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    return docs.mapInArrow(_encode(pieces), T.StructType([*docs.schema.fields, *added]))


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its column ``ids``; null ids give an empty text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches):
        for batch in slices(batches):
            texts = [decode(np.array(x or [], "<i4"), pieces.value.spelled) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_documents(read_documents(spark, folder).select("doc_id", "text"))
    return encoded.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.size("ids").cast("bigint").alias("n_ids"), "ids", "exact")
