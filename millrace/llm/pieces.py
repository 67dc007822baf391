"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text is cut into units that begin at its spaces (a space is the sign U+2581 of the vocabulary).  In a unit every
piece that matches somewhere is an edge; a character without a piece is an edge of byte pieces, and so is a literal
U+2581.  Edge weights come from the vocabulary's own order: a piece of rank r weighs (r + 30)^-alpha.  Forward
filtering sums the weights of all paths to each position; backward sampling draws the last piece, then the one
before, with exactly the probability that the path has among all paths.  Draws are a hash of (seed, row key,
position), so a row's segmentation is the same whatever the partitioning, and decoding gives the text back.

Units of up to DENSE characters go through the lattice together, as arrays over the distinct units of a chunk;
longer ones one by one, a window of characters at a time.

Edge cases: null text: null ids, no pieces, lossless; empty text: no ids; null key: key 0; rows with equal key and text
get equal ids; texts are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textbatch import U, mix, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 0.3, 17
DENSE, CHUNK_CHARS = 40, 200_000
#: Characters of a long unit whose edges are held at a time.
WINDOW = 1 << 15
NONE, SEVERAL = -1, -2
SPACE, SIGN, LITERAL = 0x20, 0x2581, 0x110000


class Lattice:
    """Vocabulary tables of one model file."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        self.raw: list[bytes] = [b""] * self.size
        self.ids: dict[str, int] = {}
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                self.raw[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and chr(SIGN) not in p[1:] and p:
                self.raw[i] = p.replace(chr(SIGN), " ").encode()
                self.ids[p.replace(chr(SIGN), " ")] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces, so encoding could lose text")
        self.logp = -alpha * np.log(np.arange(self.size) + 30.0)
        self.byte_logp = -alpha * np.log(self.size + 30.0)
        self.weights = np.append(self.logp, -np.inf).astype(np.float32)
        self.longest = max(map(len, self.ids))
        # by length: hashes of all prefixes of pieces, and the id where the prefix is itself a piece
        none = np.zeros(0, np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = [(none.astype(np.uint64), none, none, U(0))]
        for n in range(1, self.longest + 1):
            names = sorted({s[:n] for s in self.ids if len(s) >= n})
            code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            h = mix(code[:, 0])
            for j in range(1, n):
                h = _longer(h, mix(code[:, j]))
            by = np.argsort(h)
            # most hashes are found by their leading bits: the place of the one that has them, NONE, or SEVERAL
            shift = U(64 - max(4, (4 * len(h)).bit_length()))
            slot, count = np.unique(h[by] >> shift, return_counts=True)
            direct = np.full(1 << (64 - int(shift)), NONE, np.int32)
            direct[slot.astype(np.int64)] = np.where(count == 1, np.cumsum(count) - count, SEVERAL)
            self.tables.append((h[by], np.array([self.ids.get(s, -1) for s in names], np.int64)[by], direct, shift))

    def find(self, code: np.ndarray, room: np.ndarray) -> np.ndarray:
        """[n-1, i] -> id of the piece of n characters that begins at i and ends within room[i], or -1.

        A position is looked at as long as what stands there begins some piece.
        """
        h = mix(code.astype(np.uint64))
        out, at, run = [], np.arange(len(code)), h
        for n in range(1, self.longest + 1):
            keys, ids, direct, shift = self.tables[n]
            if n > 1:
                on = room[at] >= n
                at, run = at[on], run[on]
                run = _longer(run, h[at + n - 1])
            k = direct[(run >> shift).astype(np.int64)]
            many = np.flatnonzero(k == SEVERAL)
            k[many] = np.minimum(np.searchsorted(keys, run[many]), len(keys) - 1)
            on = (keys[k] == run) & (k >= 0)
            at, run = at[on], run[on]
            if n > 1 and not len(at):
                break
            got = np.full(len(code), -1, np.int32)
            got[at] = ids[k[on]]
            out.append(got)
        return np.stack(out)


def _longer(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(h * U(0xD6E8FEB86659FD93) + more)


@lru_cache(maxsize=2)
def lattice(path: str = MODEL, alpha: float = ALPHA) -> Lattice:
    return Lattice(path, alpha)


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (mix(key + mix(at.astype(np.uint64) + U(0x9E3779B97F4A7C15))) >> U(11)).astype(np.float64) * 2.0**-53


def _dense(lat: Lattice, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lattice of distinct units lying at start..start+size of code.

    Returns (cumulative probabilities by position and length of the piece ending there, ids by position and length of
    the piece beginning there, first row of each unit); a unit of m characters has m+1 rows.
    """
    rows = np.concatenate([[0], np.cumsum(size + 1)])
    n = int(rows[-1])
    pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat = code[np.repeat(start, size) + pos]
    at = np.repeat(rows[:-1], size) + pos
    room = np.repeat(size, size) - pos
    found = lat.find(flat, room)
    width = len(found)
    bare = found[0] < 0  # byte pieces stand in, marked -2 - code point
    weight = lat.weights[found]  # -1 reads the last, which no piece has
    if bare.any():
        length = np.select([flat < 0x80, flat < 0x800, flat < 0x10000], [1, 2, 3], 4)
        length[flat == LITERAL] = 3
        weight[0, bare] = lat.byte_logp * length[bare]
        found[0, bare] = -2 - flat[bare]
    ids = np.full((width, n), -1, np.int32)
    ids[:, at] = found
    score = np.full((width, n), -np.inf, np.float32)
    score[:, at] = weight
    del found, weight
    alpha = np.full(n, -np.inf, np.float32)
    alpha[rows[:-1]] = 0.0
    cum = np.zeros((n, width), np.float32)
    order = np.argsort(-size, kind="stable")
    first, longest = rows[:-1][order], size[order]
    for j in range(1, int(size.max()) + 1):
        first = first[: int(np.searchsorted(-longest, -j, "right"))]
        most = min(j, width)
        end = first + j
        terms = np.empty((most, len(end)), np.float32)
        for k in range(1, most + 1):
            np.add(alpha[end - k], score[k - 1, end - k], out=terms[k - 1])
        top = terms.max(0)
        terms -= top
        run = np.cumsum(np.exp(terms, out=terms), axis=0, out=terms)
        alpha[end] = top + np.log(run[-1])
        cum[end, :most] = (run / run[-1]).T
        cum[end, most:] = 2.0
    return cum, ids, rows[:-1]


def _edges(lat: Lattice, code: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int], list[float], list[int]]:
    """Edges of a unit that end in lo+1..hi, by end and length: where each end's begin (from lo+1 on), and lengths, weights, ids."""
    first = max(0, lo - lat.longest)
    part = code[first:hi]
    found = lat.find(part, np.arange(len(part), 0, -1))
    bare = np.flatnonzero(found[0] < 0)
    weight = lat.logp[np.maximum(found, 0)]
    if len(bare):  # byte pieces stand in
        c = part[bare]
        length = np.select([c == LITERAL, c < 0x80, c < 0x800, c < 0x10000], [3, 1, 2, 3], 4)
        found[0, bare], weight[0, bare] = -2 - c, lat.byte_logp * length
    k, i = np.nonzero(found != -1)
    end = first + i + k + 1
    kept = np.flatnonzero(end > lo)
    kept = kept[np.lexsort((k[kept], end[kept]))]
    k, i, end = k[kept], i[kept], end[kept]
    return np.searchsorted(end, np.arange(lo + 1, hi + 2)).tolist(), (k + 1).tolist(), weight[k, i].tolist(), found[k, i].tolist()


def _long(lat: Lattice, code: np.ndarray, key: int, at: int) -> Iterator[tuple[int, int]]:
    """(end, id) of the pieces of one long unit, sampled backwards; position 0 of the unit is `at` of its text.

    What is kept of the whole unit is one number a character; edges are made for a WINDOW of it at a time, twice.
    """
    m = len(code)
    alpha = array("d", bytes(8 * (m + 1)))
    for lo in range(0, m, WINDOW):
        begin, length, weight, _ = _edges(lat, code, lo, min(m, lo + WINDOW))
        for j in range(lo + 1, min(m, lo + WINDOW) + 1):
            base, total = alpha[j - 1], 0.0
            for e in range(begin[j - lo - 1], begin[j - lo]):
                total += exp(alpha[j - length[e]] + weight[e] - base)
            alpha[j] = base + log(total)
    j = m
    while j:
        lo, hi = (j - 1) // WINDOW * WINDOW, j
        begin, length, weight, ids = _edges(lat, code, lo, hi)
        u = _uniform(np.full(hi - lo, key, np.uint64), np.arange(at + lo + 1, at + hi + 1)).tolist()
        while j > lo:
            run = 0.0
            for e in range(begin[j - lo - 1], begin[j - lo]):
                run += exp(alpha[j - length[e]] + weight[e] - alpha[j])
                if u[j - lo - 1] < run:
                    break
            yield j, ids[e]
            j -= length[e]


def _encode_chunk(texts: list[str], keys: np.ndarray, lat: Lattice) -> list[np.ndarray]:
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    code[code == SIGN] = LITERAL
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    n = len(code)
    if not n:
        return [np.zeros(0, np.int32) for _ in texts]
    begin = code == SPACE
    begin[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, n))
    text = np.searchsorted(bounds, start, "right") - 1
    token = np.full(n, -1, np.int64)  # at the last character of each piece
    dense = size <= DENSE
    if dense.any():
        s, m = start[dense], size[dense]
        with np.errstate(over="ignore"):
            # equal units have equal hashes: 64 bits over the code points and the length
            power = np.multiply.accumulate(np.full(DENSE, 0x9E3779B97F4A7C15, np.uint64))
            pos = np.arange(n) - np.repeat(start, size)
            part = mix(code.astype(np.uint64)) * power[np.minimum(pos, DENSE - 1)]
            run = np.concatenate([[U(0)], np.cumsum(part, dtype=np.uint64)])
            h = mix((run[s + m] - run[s]) ^ m.astype(np.uint64))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        cum, ids, first = _dense(lat, code, s[one], m[one])
        row = first[which] + m
        root, at, key = first[which], s + m, keys[text[dense]]
        offset = bounds[text[dense]]
        while len(row):
            u = np.minimum(_uniform(key, at - offset).astype(np.float32), np.float32(1 - 2.0**-24))  # rounding may reach 1
            k = np.minimum((cum[row] <= u[:, None]).sum(1) + 1, row - root)
            token[at - 1] = ids[k - 1, row - k]
            row, at = row - k, at - k
            on = row > root
            row, root, at, key, offset = row[on], root[on], at[on], key[on], offset[on]
    for i in np.flatnonzero(~dense):
        a = int(start[i])
        for end, piece in _long(lat, code[a : a + int(size[i])], int(keys[text[i]]), a - int(bounds[text[i]])):
            token[a + end - 1] = piece
    at = np.flatnonzero(token != -1)
    got = token[at]
    cuts = np.searchsorted(at, bounds)
    bare = np.flatnonzero(got < -1)
    if len(bare):
        points = -2 - got[bare]
        codes, of = np.unique(points, return_inverse=True)
        spelled = [lat.bytes[np.frombuffer(chr(SIGN if c == LITERAL else int(c)).encode(), np.uint8)] for c in codes.tolist()]
        count = np.ones(len(got), np.int64)
        count[bare] = np.array([len(x) for x in spelled])[of]
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(to[-1]), np.int64)
        out[to[:-1]] = got
        for j in range(4):
            has = np.array([len(x) > j for x in spelled])[of]
            out[to[bare[has]] + j] = np.array([x[j] if len(x) > j else 0 for x in spelled])[of[has]]
        got, cuts = out, to[cuts]
    got = got.astype(np.int32)
    return [got[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode(texts: list[str | None], keys: list[int | None], model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> list[np.ndarray | None]:
    """Sampled piece ids of each text, by its key."""
    lat = lattice(model, alpha)
    hashed = mix(np.array([k or 0 for k in keys], np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64))) if keys else np.zeros(0, np.uint64)
    out: list[np.ndarray | None] = [None] * len(texts)
    held, total = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        held.append(i)
        total += len(t)
        if total >= CHUNK_CHARS or len(held) >= 20_000:
            for k, x in zip(held, _encode_chunk([texts[k] for k in held], hashed[held], lat)):
                out[k] = x
            held, total = [], 0
    if held:
        for k, x in zip(held, _encode_chunk([texts[k] for k in held], hashed[held], lat)):
            out[k] = x
    return out


def decode(ids: np.ndarray | list[int] | None, model: str = MODEL) -> str | None:
    """The text that was encoded."""
    if ids is None:
        return None
    raw = lattice(model, ALPHA).raw
    return b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode()


def encoder(model: str = MODEL, alpha: float = ALPHA, seed: int = SEED):
    """Column function (text, key) -> struct(ids, n_pieces, lossless); lossless is a decoding of the very ids."""

    @F.arrow_udf("struct<ids array<int>, n_pieces long, lossless boolean>")
    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        got: list[np.ndarray | None] = []
        same: list[bool] = []
        for lo in range(0, len(text), 500):
            texts = text.slice(lo, 500).to_pylist()
            some = encode(texts, key.slice(lo, 500).to_pylist(), model, alpha, seed)
            same += [decode(x, model) == t for x, t in zip(some, texts)]
            got += some
        sizes = np.array([0 if x is None else len(x) for x in got], np.int64)
        none = np.array([x is None for x in got], bool)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(none, False))
        trim()
        values = np.concatenate([x for x in got if x is not None]) if (~none).any() else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(sizes), pa.array(same, pa.bool_())], names=["ids", "n_pieces", "lossless"])

    return run


def decoder(model: str = MODEL):
    """Column function ids -> text."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([decode(x, model) for x in ids.to_pylist()], pa.string())

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) for every row of docs(doc_id, text), keyed by doc_id."""
    bounded_batches(docs.sparkSession)
    key: Column = F.col("doc_id").cast("long")
    out = docs.select(key.alias("doc_id"), encoder(model, alpha, seed)(F.col("text").cast("string"), key).alias("_e"))
    return out.select("doc_id", "_e.n_pieces", "_e.lossless", "_e.ids")
