"""Language ID: blended-spectrum presence kernel, Nystrom landmarks, one-versus-rest kernel ridge regression.

A text is the set of its 1- to 3-byte strings (UTF-8, A-Z lower-cased) hashed to DIM buckets, and
k(x, y) = |x & y| / sqrt(|x| |y|).  The regression lives in the span of LANDMARKS training texts
(subset-of-regressors form of the Nystrom approximation); its scores k(x, L) @ alpha are matrix products over
batches.  The kernel is bilinear in normalised presence vectors, so (X L^T) alpha is computed as X (L^T alpha).

Training takes at most ROWS_PER_LANG texts of each language, fewer (down to four) where there are so many languages that
MOST_ROWS are reached: those first in the order of a hash of the id.  These bounds are parameters; every language
with a usable text is learned, every text is read and scored whole.

Edge cases: null text, or text without a letter (Unicode): `und`, score 0; no usable training row: every text
is `und`; one learned language: it gets score 1; ties go to the language first in order; a null doc_id is never
learned from and counts as not held out; repeated rows stay; an empty table gives an empty result; other
columns are ignored, or passed through by `identified`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, small
from .textbatch import FOLD, U, buffers, mix, trim

DIM = 8192
LANDMARKS, ROWS_PER_LANG, MOST_ROWS = 160, 400, 65_536
RIDGE, SHARPNESS = 1e-3, 6.0
#: Below this score the pipeline rejects a document.
REJECT_BELOW = 0.4

_A = mix(np.arange(256, dtype=np.uint64) + U(0x51ED))
_B = mix(np.arange(256, dtype=np.uint64) + U(0xA7C0FFEE))
_C = mix(np.arange(256, dtype=np.uint64) + U(0x0DDBA11))
_SHIFT = U(64 - 13)
_MULT = U(0x9E3779B97F4A7C15)
assert DIM == 1 << 13


def presence(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, uint8 matrix of hi-lo rows by DIM, whether each text has a letter), at most 256 texts at a time."""
    data, off = buffers(array)
    n, lo = len(off) - 1, 0
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    while lo < n:
        hi = min(n, lo + 256, max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1))
        a, b = int(off[lo]), int(off[hi])
        raw = data[a:b]
        out = np.zeros((hi - lo, DIM), np.uint8)
        flat = out.reshape(-1)
        size = np.diff(off[lo : hi + 1])
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * DIM, size)
        x = FOLD[raw]
        one = _A[x]
        flat[row + (one * _MULT >> _SHIFT).astype(np.int64)] = 1
        if len(x) > 1:
            two = one[:-1] ^ _B[x[1:]]
            whole = row[:-1] == row[1:]
            flat[(row[:-1] + (two * _MULT >> _SHIFT).astype(np.int64))[whole]] = 1
            if len(x) > 2:
                three = two[:-1] * U(3) ^ _C[x[2:]]
                whole = row[:-2] == row[2:]
                flat[(row[:-2] + (three * _MULT >> _SHIFT).astype(np.int64))[whole]] = 1
        runs = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
        letter = (runs[off[lo + 1 : hi + 1] - a] - runs[off[lo:hi] - a]) > 0
        for i in np.flatnonzero(~letter & (size > 0)):
            letter[i] = any(map(str.isalpha, array[lo + int(i)].as_py()))  # categories L: number signs are none
        yield lo, hi, out, letter
        lo = hi


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # DIM by languages: landmarks' transpose times alpha; DIM by landmarks with very many languages
    alpha: np.ndarray | None = None  # landmarks by languages, then

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for lo, hi, seen, letter in presence(array):
            if not self.langs:
                names += ["und"] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                continue
            got = unit(seen) @ self.weights
            got = (got if self.alpha is None else got @ self.alpha).astype(float) * SHARPNESS
            p = np.exp(got - got.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            names += [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist())]
            scores.append(np.where(letter, p[np.arange(hi - lo), best], 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> LanguageModel:
    """A model from docs(doc_id, text, lang) outside the held-out third."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> '' AND lang IS NOT NULL").filter(~held_out())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([], np.zeros((DIM, 0), np.float32))
    # a share of each language's ids that gives ROWS_PER_LANG with room to spare; the first by hash are then kept
    order = F.xxhash64("doc_id")
    most = max(4, min(ROWS_PER_LANG, MOST_ROWS // len(counts)))
    shares = [(r["lang"], min(1.0, (1.3 * most + 30) / r["count"])) for r in counts]
    bounds = docs.sparkSession.createDataFrame([(x, min(2**63 - 1, int((2 * share - 1) * 2**63))) for x, share in shares], "lang string, _most long")
    wide = rows.join(small(bounds, MOST_ROWS), "lang").filter(order <= F.col("_most"))
    # rows that repeat an id count once, so a much repeated one does not swell the sample
    picked = wide.groupBy("lang", order.alias("order")).agg(F.min("text").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, seen, letter in presence(batch.column(2)):
                ok = pa.array(letter)
                bits = np.packbits(seen, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(ok), batch.column(1).slice(lo, hi - lo).filter(ok), pa.array([bits[i].tobytes() for i in np.flatnonzero(letter)], pa.binary())], names=["lang", "order", "bits"])

    kept: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in sorted(picked.mapInArrow(make, "lang string, order long, bits binary").collect(), key=lambda r: (r["order"], bytes(r["bits"]))):
        if len(kept[r["lang"]]) < most:
            kept[r["lang"]].append(bytes(r["bits"]))
    langs = sorted(x for x, rows in kept.items() if rows)
    if not langs:
        return LanguageModel([], np.zeros((DIM, 0), np.float32))
    # at most 4 * LANDMARKS in all, whatever the number of languages: of more than LANDMARKS, those first by name's hash give four each
    each = max(4, LANDMARKS // len(langs))
    named = sorted(langs, key=lambda y: zlib.crc32(y.encode()))[:LANDMARKS] if len(langs) > LANDMARKS else langs
    land = np.concatenate([_unpacked(kept[y][:each]) for y in named])
    left = RIDGE * len(langs) * (land @ land.T).astype(float) + 1e-9 * np.eye(len(land))
    right = np.zeros((len(land), len(langs)))
    for k, y in enumerate(langs):  # one language's texts at a time; languages count alike
        k_nm = (_unpacked(kept[y]) @ land.T).astype(float)
        left += k_nm.T @ k_nm / len(k_nm)
        mean = k_nm.mean(0)
        right -= mean[:, None]
        right[:, k] += 2 * mean
    alpha = np.linalg.solve(left, right)
    if len(langs) > LANDMARKS:
        return LanguageModel(langs, np.ascontiguousarray(land.T), alpha.astype(np.float32))
    return LanguageModel(langs, (land.T @ alpha).astype(np.float32))


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return unit(np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in bits]), axis=1))


def _predictor(docs: DataFrame, model: LanguageModel):
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores = sent.value.predict(text)
        trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang)."""
    model = model or train(docs)
    predict = _predictor(docs, model)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(F.col("text").cast("string")).alias("_p"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """docs without the rows whose language isn't recognised (`und`, or a score under REJECT_BELOW)."""
    model = model or train(docs)
    predict = _predictor(docs, model)
    marked = docs.withColumn("_millrace_lang", predict(F.col("text").cast("string")))
    return marked.filter(F.col("_millrace_lang.score") >= REJECT_BELOW).drop("_millrace_lang")
