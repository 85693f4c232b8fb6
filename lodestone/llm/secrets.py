"""Secret scan by token efficiency: random strings need many tokens for few characters.

Candidates are runs of at least ``MIN_CHARS`` characters of ``[A-Za-z0-9+/_-]`` (with trailing ``=``) that
hold a digit or mixed case, and any runs of ``NAMED_CHARS`` right after a credential's name. Each is encoded with a tiktoken vocabulary; a run with at most ``MAX_RATIO``
characters a token is reported. Before that, known digests (hex of a digest's length) and identifiers (only
digits, UUIDs, parts of addresses and links, parts of words with letters beyond ASCII; other characters beyond ASCII,
such as typographic quotes, may touch a run) are set aside, by the whole white-space-delimited token that holds the run - but not where a credential's name stands just before the run (``token = "..."``), since a key may look like a digest.

Defined results: null and empty texts and texts without such runs give no row; a null ``doc_id`` is carried
as null; repeated rows and repeated runs are reported each; ``start`` counts characters from 0; other columns
are ignored. The value itself is never returned, only its first four characters and a SHA-256.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import buffers, pieces, strings
from ._tokens import VOCABULARY, on_executor, shipped

MIN_CHARS = 16
#: Shorter words are often a token for two characters, whatever they are.
NAMED_CHARS = 8
MAX_RATIO = 2.0

_RUN = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-":
    _RUN[_c] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True

#: Bytes looked at for a credential's name before a run (20 of the longest name, 5 between) and the character beside it.
AROUND = 48
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True

NAME = re.compile(rb"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?", re.I)
CREDENTIAL = re.compile(NAME.pattern + rb"\W{0,5}$", re.I)
DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")

def in_word(c: str) -> bool:
    """Whether a character beyond ASCII continues a word."""
    return c > "\x7f" and (c.isalnum() or unicodedata.category(c)[0] == "M")


def address(token: bytes) -> bool:
    """Whether a white-space-delimited token is a link or an address."""
    return b"://" in token or bool(re.match(rb"[^@]*@[\w-]+\.", token)) or token.startswith(b"www.")


def excluded(run: bytes, before: bytes, after: bytes, linked: bool) -> str | None:
    """Why a run is no candidate: ``digest``, ``identifier`` or ``word``; None where it is one.

    ``before`` and ``after`` are what surrounds it (at most ``AROUND`` bytes: more than a credential's name and what may
    follow it, or a character, take); ``linked``: whether the whole token that holds it is a link or an address.
    """
    if CREDENTIAL.search(before):
        return None
    if UUID.match(run) or run.isdigit():
        return "identifier"
    if DIGEST.match(run) and len(run) in DIGEST_CHARS:
        return "digest"
    if in_word(before.decode(errors="ignore")[-1:]) or in_word(after.decode(errors="ignore")[:1]):
        return "word"
    return "identifier" if linked else None


def scan(col, enc, min_chars: int, max_ratio: float):
    """(row, start character, run, tokens, named) of every reported run."""
    for at, piece in pieces(strings(col)):
        data, off = buffers(piece)
        if not len(data):
            continue
        own = _RUN[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(own[1:], own[:-1], out=edge[1:-1])
        edge[off] = True
        cuts = np.flatnonzero(edge)
        start, end = cuts[:-1], cuts[1:]
        names = np.array([-9, *(m.end() for m in NAME.finditer(data.tobytes()))])
        near = start - names[np.searchsorted(names, start, "right") - 1] <= 5  # what CREDENTIAL allows between
        use = own[start] & (end - start >= np.where(near, min(NAMED_CHARS, min_chars), min_chars))
        start, end = start[use], end[use]
        if not len(start):
            continue
        sums = [np.concatenate([[0], np.cumsum(k[data])]) for k in (_DIGIT, _UPPER, _LOWER)]
        gap = np.flatnonzero(_GAP[data])  # tokens end at white space and at the row's ends
        token, linked = -1, False
        begins = None
        for s, e in zip(start.tolist(), end.tolist()):
            digit, upper, lower = (int(c[e] - c[s]) for c in sums)
            row = int(np.searchsorted(off, s, "right")) - 1
            lo, hi = int(off[row]), int(off[row + 1])
            before = data[max(lo, s - AROUND) : s].tobytes()
            plain = e - s < min_chars or not (digit or (upper > 1 and lower))
            named = bool(CREDENTIAL.search(before))
            if plain and not named:
                continue
            while e < hi and data[e] == 61:
                e += 1
            run = data[s:e].tobytes()
            i = int(np.searchsorted(gap, s))
            first = max(lo, int(gap[i - 1]) + 1 if i else 0)
            if first != token:
                last = min(hi, int(gap[i]) if i < len(gap) else len(data))
                token, linked = first, address(data[first:last].tobytes())
            if excluded(run, before, data[e : min(hi, e + AROUND)].tobytes(), linked):
                continue
            n = len(enc.encode_ordinary(run.decode("ascii")))
            if len(run) <= max_ratio * n:
                if begins is None:
                    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                yield at + row, int(begins[s] - begins[lo]), run, n, named


def secret_scan(docs: DataFrame, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, n_chars, n_tokens, chars_per_token, named, preview, sha256) of every suspected secret."""
    name = shipped(docs.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("named", pa.bool_()), ("preview", pa.string()), ("sha256", pa.string())])

    def find(batches):
        enc = on_executor(name)
        for b in batches:
            ids = b.column(0)
            rows = [{"doc_id": ids[row].as_py(), "start": start, "n_chars": len(run), "n_tokens": n, "chars_per_token": round(len(run) / n, 6), "named": named, "preview": run[:4].decode(), "sha256": hashlib.sha256(run).hexdigest()} for row, start, run, n, named in scan(b.column(1), enc, min_chars, max_ratio)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, "doc_id long, start long, n_chars long, n_tokens long, chars_per_token double, named boolean, preview string, sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
