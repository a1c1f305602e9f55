"""Language ID: averaged embeddings of hashed subwords, a linear softmax, and rejection by a calibrated score."""

from __future__ import annotations

import math
import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, materialize, read_documents, row_key, whole_text
from .shingles import _BYTE, text_bytes

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 16
PER_LANGUAGE = 800
MAX_SAMPLE = 20_000
SALTS = 64
FETCH_BYTES = 4 << 20
EPOCHS = 12
MIN_STEPS = 500
MINI = 64
RATE = 0.5
REJECT_SHARE = 0.002
PIECE_BYTES = 1 << 18
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that are no letters: all of ASCII but a-z (after lower-casing) become one mark.
_MARK = np.arange(256, dtype=np.uint8)
_MARK[[b for b in range(128) if not ord("a") <= b <= ord("z")]] = ord(" ")


def _plain(data: np.ndarray, after_mark: bool = False) -> np.ndarray:
    """Lower-cased bytes with a mark for each run of bytes that are no letters; a run may have begun before ``data``."""
    plain = _MARK[_LOWER[data]]
    mark = plain == 32
    return plain[~(mark & np.concatenate([[after_mark], mark[:-1]]))] if len(plain) else plain


def _grams(plain: np.ndarray, known: int = 0) -> np.ndarray:
    """Buckets of all 2-, 3- and 4-byte runs that do not lie in the first ``known`` bytes."""
    values, out = _BYTE[plain], []
    run = values
    for n in range(2, max(GRAMS) + 1):
        if len(values) < n:
            break
        run = run[: len(values) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + values[n - 1 :]
        run = run ^ (run >> np.uint64(29))
        if n in GRAMS:
            out.append(((run[max(0, known - n + 1) :] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def subwords(data: np.ndarray) -> np.ndarray:
    """Buckets of all 2-, 3- and 4-byte runs of a text, with marks for what is not a letter; runs of marks are left out."""
    return _grams(_plain(data))


def counts(text: np.ndarray) -> np.ndarray:
    """Bucket counts of a whole text, worked through in pieces; the last bytes of a piece go on into the next."""
    total, tail = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint8)
    for at in range(0, len(text), PIECE_BYTES):
        plain = np.concatenate([tail, _plain(text[at : at + PIECE_BYTES], len(tail) > 0 and tail[-1] == 32)])
        total += np.bincount(_grams(plain, len(tail)), minlength=BUCKETS)
        tail = plain[-(max(GRAMS) - 1) :]
    return total


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds every bucket's embedding times the output weights; a text's logits are its mean plus ``bias``.

    ``temperature`` is fitted on calibration documents, and a text whose score is below ``threshold`` is rejected.
    """

    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, grams: np.ndarray) -> np.ndarray:
        return self.table[grams].mean(axis=0) + self.bias if len(grams) else self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def _features(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        packed = []
        for a, b in zip(offsets, offsets[1:]):
            c = counts(data[a:b])
            at = np.flatnonzero(c)
            packed.append(at.astype("<u2").tobytes() + (c[at] / max(c.sum(), 1)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "fold": batch.column("fold"), "share": pa.array(packed, pa.binary())})


def held_out(doc_id) -> F.Column:
    """Whether the driver's test fold has the document; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` documents of each language and 20,000 in all, by hash order, with their features.

    Ranks stop early, first in 64 salts of a language and then over what they leave, so a hot language is not gathered. Features are counted over whole
    texts, in tasks. A fifth is for calibration.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    names = ["_k1", "_k2"]
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "lang", order.alias("_o"), *row_key(F.col("doc_id"), whole_text())
    )
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("_o", F.lit("salt")), F.lit(SALTS)))
    leading = F.row_number().over(W.partitionBy("lang", "_s").orderBy("_o", *names))
    rows = rows.withColumn("_r", leading).filter(F.col("_r") <= per_language)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_o", *names))
    chosen = rows.withColumn("_r", rank).filter(F.col("_r") <= per_language).orderBy("_r", "_o", *names).limit(MAX_SAMPLE)
    chosen = chosen.select(*names, "lang", (F.pmod("_o", F.lit(5)) == 0).alias("fold"))
    texts = docs.select(*row_key(F.col("doc_id"), whole_text()), whole_text().alias("text"))
    # At most 20,000 rows of a key and a label, whatever the corpus. Repeated rows are taken once.
    sample = texts.join(F.broadcast(chosen.dropDuplicates(names)), names).dropDuplicates(names)
    return sample.select("lang", "fold", "text").mapInArrow(_features, "lang string, fold boolean, share binary")


def fit(sample: DataFrame, seed: int = 1) -> LanguageModel:
    """Stochastic gradient descent in numpy over the bounded sample, then calibration on its other part.

    A text's features take up to 196 KB, and the sample's some GB. The driver fetches them in parts of a few MB and puts
    them into a file of its own, which training reads from. Equal features keep the order that the sample has.
    """
    give_back(sample.sparkSession)
    sample = materialize(sample.withColumn("at", F.monotonically_increasing_id()))
    size = sample.agg(F.coalesce(F.sum(F.octet_length("share")), F.lit(0))).first()[0]
    langs, folds, at, ends = [], [], [], [0]
    with tempfile.TemporaryFile() as file:
        for row in sample.repartition(1 + size // FETCH_BYTES).toLocalIterator():
            langs.append(row["lang"]), folds.append(row["fold"]), at.append(row["at"])
            ends.append(ends[-1] + file.write(row["share"]))
        file.flush()
        features = np.memmap(file, np.uint8, "r") if size else np.empty(0, np.uint8)
        model = _trained(langs, folds, at, features, ends, seed)
    give_back(sample.sparkSession)
    return model


def _trained(langs: list[str], folds: list[bool], at: list[int], features: np.ndarray, ends: list[int], seed: int) -> LanguageModel:
    """``features``: those of all texts one after the other; ``ends`` are their edges, ``at`` is their order."""
    labels = tuple(sorted(set(langs)))
    if not labels:
        return LanguageModel((), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 1.0)
    blobs = [memoryview(features)[a:b] for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(blobs)), key=lambda i: (zlib.crc32(blobs[i]), at[i]))
    known = {x: i for i, x in enumerate(labels)}
    y = np.array([known[x] for x in langs])[order]
    fold = np.array(folds, dtype=bool)[order]
    # Views of the file; nothing is copied.
    parts = [blobs[i] for i in order]
    ids = [np.frombuffer(p, "<u2", len(p) // 6) for p in parts]
    share = [np.frombuffer(p, "<f4", len(p) // 6, len(p) // 3) for p in parts]
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~fold) if (~fold).any() else np.arange(len(y))
    check = np.flatnonzero(fold) if fold.any() else train
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)

    def dense(part):
        x = np.zeros((len(part), BUCKETS), np.float32)
        for r, i in enumerate(part):
            x[r, ids[i]] = share[i]
        return x

    each = math.ceil(len(train) / MINI)
    epochs = max(EPOCHS, -(-MIN_STEPS // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), each):
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            x = dense(part)
            hidden = x @ embed
            z = hidden @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            # Means of thousands of subwords are small, so steps are sums over the mini-batch.
            back = p @ weight.T
            weight -= rate * hidden.T @ p
            bias -= rate / len(part) * p.sum(axis=0)
            embed -= rate * x.T @ back
    table = embed @ weight
    z = np.stack([share[i] @ table[ids[i]] if len(ids[i]) else np.zeros(len(labels)) for i in check]) + bias
    grid = np.geomspace(0.002, 20, 160)

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        logs = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        # One label in 500 is taken to be wrong, so that a sample without errors does not make scores infinite.
        return -float((0.998 * logs[np.arange(len(check)), y[check]] + 0.002 * logs.mean(axis=1)).mean())

    temperature = float(min(grid, key=loss))
    model = LanguageModel(labels, table.astype(np.float32), bias, temperature, 0.0)
    p = model.score(z)
    right = p[p.argmax(axis=1) == y[check]].max(axis=1) if len(check) else np.ones(1)
    threshold = float(np.quantile(right, REJECT_SHARE)) if len(right) else 0.0
    # A text on which all languages are about as likely says nothing; one that leans to a language is not refused.
    floor = 1.0 / len(labels)
    return LanguageModel(labels, model.table, bias, temperature, min(threshold, floor + 0.5 * (1 - floor)))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_bytes(column)
            labels, scores, rejected = [], [], []
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                text = data[a:b]
                # Letters of ASCII are found at once; otherwise the text's other letters are looked for.
                lettered = bool(((_LOWER[text] >= 97) & (_LOWER[text] <= 122)).any()) or _has_letter(column[i].as_py() or "")
                if not lettered or not model.labels:
                    labels.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                if len(text) <= PIECE_BYTES:
                    z = model.logits(subwords(text))
                else:
                    c = counts(text)
                    z = (c @ model.table) / max(c.sum(), 1) + model.bias
                p = model.score(z.astype(np.float64))
                best = int(p.argmax())
                labels.append(model.labels[best]), scores.append(float(p[best])), rejected.append(bool(p[best] < model.threshold))
            keys = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(labels), pa.array(scores, pa.float64()), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Row key, doc_id, ``lang_pred``, ``score``, ``rejected`` of every row, from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0 and rejected. Rows and other columns do not matter to
    one another; repeated rows get the same answer each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*row_key(F.col("doc_id"), whole_text()), "doc_id", "text")
    return rows.mapInArrow(_predict(shared), "_k1 bigint, _k2 bigint, doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows that the model rejects. Text passes through the tasks once and is not shuffled.

    Null texts and texts without letters are rejected. A model that had no labelled document to learn from rejects
    nothing. Repeated rows share one fate; columns may have any names.
    """
    if not model.labels:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = _predict(shared)

    def kept(batches):
        for batch in batches:
            answer = next(run(iter([batch.select(["text"])])))
            yield batch.filter(pc.invert(answer.column("rejected")))

    return docs.mapInArrow(kept, docs.schema)


def op1_language_id(spark, folder):
    docs = read_documents(spark, folder)
    model = fit(training_sample(docs))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
