r"""Secret scans: fixed patterns, and random strings exposed by how badly a public tokenizer compresses them.

Base kinds, leftmost non-overlapping each: `assign` (a key word, `:` or `=`, a value of 8+ characters), `access`
(AKIA..., 16+ characters), `hex` (32+ lower-case hex digits).  The method adds `random`: runs of 20 or more of
`[A-Za-z0-9+/_=-]` holding a letter, whose characters per token under a tiktoken vocabulary fall below LEAST_RATIO,
unless they are a known digest (hex of a digest's length), an identifier (UUID, a decimal number) or lie within a base
span.  Runs without a digit, and plain words and short numbers joined by signs, must fall below the stricter PLAIN_RATIO,
and are a path or a name if their parts have under LEAST_PART characters on average.  Prose compresses to 2 and more
characters a token, random base-62 to about 1.5, random letters of both cases to 1.4; of random lower-case letters
alone (1.7) about two thirds are told from long words.

Spans are code points, end exclusive, as kind:start:end in the order of start, then kind as listed.

Edge cases: null text counts as empty (no spans, the digest of an empty string); ids may be null or repeat, a row
each; texts are scanned whole; an empty table gives an empty result; other columns are ignored, or passed through
by `redacted`.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textbatch import trim

#: Fixed patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run is maximal, so this is [0-9a-f]+ with 32+ characters
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 8, 16

LEAST_RUN, LEAST_RATIO = 20, 1.9
PLAIN_RATIO, LEAST_PART = 1.7, 5
#: Characters that are encoded at once; a longer run is counted piece by piece.
PIECE = 4096
#: Lengths, in hex digits, of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of words, numbers, punctuation and space before byte-pair merges that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NUMBER = re.compile(r"[0-9/_=+-]+")
_PART = re.compile(r"[A-Za-z0-9]+")
_PLAIN = re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))*")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest, UUID or number: not a secret by itself."""
    return bool(_UUID.fullmatch(run) or (_DIGEST.fullmatch(run) and len(run) in DIGESTS) or _NUMBER.fullmatch(run))


def is_random(run: str, path: str = VOCABULARY) -> bool:
    """Few characters a token, and neither known nor a path or name."""
    if is_known(run):
        return False
    least = LEAST_RATIO
    if _PLAIN.fullmatch(run) or not any(c.isdigit() for c in run):
        parts = _PART.findall(run)
        if sum(map(len, parts)) < LEAST_PART * len(parts):
            return False
        least = PLAIN_RATIO
    encode = tokenizer(path).encode_ordinary
    return len(run) < least * sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def random_spans(text: str, base: list[tuple[int, int, int]], path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs with few characters a token."""
    out = []
    i, covered = 0, 0  # base spans that start by here, and the last place they cover
    for m in _RUN.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] <= a:
            covered = max(covered, base[i][2])
            i += 1
        if b > covered and is_random(m[0], path):
            out.append((a, 3, b))
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, path: str = VOCABULARY) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, path))


def redact(text: str | None, path: str = VOCABULARY) -> str | None:
    """The text with every secret replaced by [SECRET]; in an assignment the key word stays."""
    if text is None:
        return None
    spans = []
    for a, k, b in scan(text, path)[1]:
        if k == 0:
            a = _ASSIGN.match(text, a).start(2)
        spans.append((a, b))
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs(doc_id, text)."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string>")
    def look(text: pa.Array) -> pa.Array:
        rows = []
        for x in text:
            x = x.as_py()
            base, every = scan(x, vocabulary)
            kinds = [k for _, k, _ in every]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(render(base).encode()).hexdigest(), render(every)))
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), look(F.col("text").cast("string")).alias("_s"))
    return out.select("doc_id", "_s.*")


def redacted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with secrets blanked out of `text` (and `n_chars`, where it is a column, counted again)."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        out = pa.array([redact(x.as_py(), vocabulary) for x in text], pa.string())
        trim()
        return out

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
