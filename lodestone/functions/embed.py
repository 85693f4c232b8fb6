"""Static word-piece embeddings and bfloat16 vectors, as Arrow-batched column functions.

A model is a list of word pieces with a row of small integers and a scale for each. Text is cleaned, split at white space and
around marks and Chinese characters, cut into the longest known pieces, and the mean of their rows is brought to unit
length. The model is broadcast: its size is that of its vocabulary.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_WORD = 100
_CHINESE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """``gap``, ``drop``, ``alone`` (a mark or a Chinese character) or ``word``."""
    if c in " \t\n\r":
        return "gap"
    category = unicodedata.category(c)
    if category == "Zs":
        return "gap"
    if category[0] == "C" or c == "�":
        return "drop"
    p = ord(c)
    if category[0] == "P" or p < 128 and not c.isalnum() or any(a <= p <= b for a, b in _CHINESE):
        return "alone"
    return "word"


class WordPieces:
    def __init__(self, pieces: list[str], codes: np.ndarray, scales: np.ndarray, unknown: str = "[UNK]", lower: bool = True, strip_accents: bool = True):
        """``codes``: a row of 8-bit integers for each piece; ``scales``: a factor for each."""
        if codes.ndim != 2 or not len(pieces) == len(codes) == len(scales):
            raise ValueError("as many rows and scales as pieces")
        if unknown not in pieces:
            raise ValueError(f"{unknown!r} is no piece")
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.rows = codes.astype(np.float32) * np.asarray(scales, np.float32)[:, None]
        self.unknown, self.lower, self.strip_accents = self.ids[unknown], lower, strip_accents

    def words(self, text: str) -> list[str]:
        text = "".join(f" {c} " if any(a <= ord(c) <= b for a, b in _CHINESE) else " " if _kind(c) == "gap" else c for c in text if _kind(c) != "drop")
        if self.strip_accents:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        if self.lower:
            text = text.lower()
        return "".join(f" {c} " if _kind(c) == "alone" else c for c in text).split()

    def pieces(self, word: str) -> list[int]:
        """The longest known pieces from the left; the unknown piece for a word that can't be covered."""
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                i = self.ids.get(word[at:end] if not at else "##" + word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def embed(self, text: str | None) -> np.ndarray:
        """A unit vector; zeros for a text without words."""
        ids = [i for w in self.words(text or "") for i in self.pieces(w)]
        if not ids:
            return np.zeros(self.rows.shape[1], np.float32)
        mean = self.rows[ids].mean(axis=0)
        norm = float(np.sqrt((mean * mean).sum()))
        return mean / norm if norm else mean

    def column(self, spark, text: Column) -> Column:
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(held.value.embed)

        return run(text)


def load(table: DataFrame, **options) -> WordPieces:
    """A model from a table (id, piece, code, scale)."""
    rows = table.orderBy("id").collect()
    return WordPieces([r.piece for r in rows], np.array([r.code for r in rows], np.int8), np.array([r.scale for r in rows]), **options)


def round_bf16(x: np.ndarray) -> np.ndarray:
    """32-bit floats rounded to bfloat16, nearest and ties to even."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    near = (bits + (((bits >> np.uint32(16)) & np.uint32(1)) + np.uint32(0x7FFF))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(x), x, near.view(np.float32)).astype(np.float32)


def bf16(vector: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else round_bf16(np.asarray(v, np.float32)))

    return run(vector)


def write_rerank(vectors: DataFrame, dim: int, path: str, unit: bool = True) -> None:
    """(doc, v) in bfloat16 precision, sorted by document, for exact scores of an approximate search's candidates."""
    from .text import l2_normalize

    wrong = vectors.where(F.col("v").isNull() | (F.size("v") != dim))
    if not wrong.isEmpty():
        raise ValueError(f"every vector has {dim} components")
    v = l2_normalize(F.col("v")) if unit else F.col("v")
    vectors.select("doc", bf16(v.cast("array<float>")).alias("v")).repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(path)
