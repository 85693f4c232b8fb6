"""Encoding with a tiktoken vocabulary, whole texts of any shape.

The vocabulary file is shipped once with ``SparkContext.addFile`` and read from there on every executor, so only the
driver needs its path.
"""

from __future__ import annotations

import base64
import os
import re

from pyspark import SparkFiles
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space runs from this length on are encoded apart, since the pattern backtracks over them.
LONG_GAP = 1024
_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_GAP)

_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """The tiktoken encoder over the ranks in ``path``; one for each Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(f"own:{path}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def shipped(spark: SparkSession, path: str = VOCABULARY) -> str:
    """The vocabulary's name on every executor."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def on_executor(name: str):
    """The encoder over a shipped vocabulary, inside a task."""
    return encoder(SparkFiles.get(name))


def encode(enc, text: str) -> list[int]:
    """The same tokens as ``encode_ordinary``, which fails on very long runs of white space.

    The pattern gives such a run without its last character (the whole run at the text's end) to one piece, and
    nothing before a run or from its last character on depends on the rest of it.
    """
    if len(text) < LONG_GAP or not (first := _GAP.search(text)):
        return enc.encode_ordinary(text)
    out, at = [], 0
    while first:
        stop = first.end() if first.end() == len(text) else first.end() - 1
        out += enc.encode_ordinary(text[at : first.start()])
        out += enc._encode_single_piece(text[first.start() : stop].encode())
        at = stop
        first = _GAP.search(text, stop + 1)
    return out + enc.encode_ordinary(text[at:])
