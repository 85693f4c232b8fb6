"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

An example is cut only where a limit is exceeded: each piece takes tokens in reading order until the next one would
exceed ``max_tokens`` or ``max_loss``, so one that fits stays whole and no token is lost. The pieces are written
once, numbered as they lie, spread evenly over groups of about ``GROUP`` pieces (one partition each, named by
its number, whatever keys repeat), and each group is packed by itself with the dot-product heuristic: the open
sequence takes the fitting piece with the largest ``sum_d weight_d * size_d * free_d`` (sizes and free room as shares of
the limits, ``weight_d`` the group's mean size), and when none fits the next sequence is opened. The number of
groups grows with the input; a group's work doesn't.

The result has one row for each sequence: token ids, loss mask, and which example's piece lies where.

Defined results: an example without tokens (null or empty texts) gets a row of its own with ``bin_id`` null; ties go to
the smaller (ex_id, piece, tokens). Turns of a conversation follow ``turn``; rows of a conversation that are equal in
turn, loss and text count once; a turn with a null ``conv_id`` is an example of its own; a null turn number comes
first. A conversation is read in blocks of ``max_tokens`` turn numbers, each cut by itself (a longer one can't fit a
sequence anyway). Repeated documents are examples each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut
from ._tokens import VOCABULARY, encode, on_executor, shipped

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 8, 3072
GROUP = 2048
PIECES = "ex_id long, piece long, n_tokens long, n_loss long, tokens binary, loss binary"  # ids and bits
OUT = "bin_id long, n_tokens long, n_loss long, doc_ids array<long>, pieces array<long>, starts array<int>, tokens array<int>, loss array<boolean>"


def id_type(vocabulary: str) -> np.dtype:
    """How token ids lie in the bytes that are moved: 16 bits where the vocabulary allows it."""
    with open(vocabulary, "rb") as f:
        return np.dtype(np.uint16 if sum(1 for _ in f) <= 1 << 16 else np.uint32)


def dot_product(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, slot) of each row of ``sizes`` (n x d integers, each row within ``limits``)."""
    n = len(sizes)
    share = sizes / limits
    value = share * share.mean(axis=0) if n else share
    # Rows of one size are one class; its rows go in their order.
    kinds, inverse, often = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    queue = np.argsort(inverse.ravel(), kind="stable")
    first = np.cumsum(often) - often  # each class's next row in the queue
    last = first + often
    value = value[queue[first]] if n else value
    where, slot = np.full(n, -1), np.full(n, -1)
    free, opened, used = limits.copy(), 0, 0
    live = np.arange(len(kinds))
    left = n
    while left:
        fits = (kinds[live] <= free).all(axis=1)
        if not fits.any():
            free, opened, used = limits.copy(), opened + 1, 0
            continue
        near = live[fits]
        score = np.round(value[near] @ (free / limits), 12)
        ties = near[score == score.max()]
        c = int(ties[queue[first[ties]].argmin()])
        row = queue[first[c]]
        where[row], slot[row] = opened, used
        free = free - kinds[c]
        used += 1
        left -= 1
        first[c] += 1
        if first[c] == last[c]:
            live = live[live != c]
    return where, slot


def cuts(loss: np.ndarray, max_tokens: int, max_loss: int) -> list[int]:
    """Where the pieces of an example with this loss mask begin, and its end."""
    out, total = [0], np.concatenate([[0], np.cumsum(loss)])
    while out[-1] < len(loss):
        full = int(np.searchsorted(total, total[out[-1]] + max_loss, "right")) - 1
        out.append(min(len(loss), out[-1] + max_tokens, full))
    return out


class Pieces:
    """Cuts examples and gives their pieces back in batches of bounded size."""

    def __init__(self, max_tokens: int, max_loss: int, size: int = 1 << 22):
        self.limits, self.size, self.rows, self.held = (max_tokens, max_loss), size, [], 0

    def add(self, ex: int | None, first: int, tokens: np.ndarray, loss: np.ndarray):
        ends = cuts(loss, *self.limits) if len(tokens) else [0, 0]
        for i, (x, y) in enumerate(zip(ends, ends[1:])):
            self.rows.append((ex, first + i, y - x, int(loss[x:y].sum()), tokens[x:y].tobytes(), np.packbits(loss[x:y]).tobytes()))
            self.held += tokens.itemsize * int(y - x)
            if self.held > self.size:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * 6
        self.rows, self.held = [], 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])


def cut_examples(examples: DataFrame, max_tokens: int, max_loss: int, ids: np.dtype) -> DataFrame:
    """``PIECES`` of (ex_id, first_piece, parts: array of (turn, loss, tokens) in reading order)."""

    def run(batches):
        out = Pieces(max_tokens, max_loss)
        for b in batches:
            parts = b.column(2)
            n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, at = parts.flatten(), 0
            tokens, bears = flat.field("tokens"), flat.field("loss").to_numpy(zero_copy_only=False).astype(bool)
            for ex, first, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), n_parts.tolist()):
                own = tokens.slice(at, n).to_pylist()
                loss = np.repeat(bears[at : at + n], [len(x) // ids.itemsize for x in own])
                at += n
                yield from out.add(ex, first, np.frombuffer(b"".join(own), ids), loss)
            yield out.batch()

    return examples.select("ex_id", "first_piece", "parts").mapInArrow(run, PIECES)


def document_pieces(docs: DataFrame, max_tokens: int, max_loss: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``PIECES`` of documents, each one example that bears loss on every token: encoded and cut where they lie."""
    name, ids = shipped(docs.sparkSession, vocabulary), id_type(vocabulary)

    def run(batches):
        enc, out = on_executor(name), Pieces(max_tokens, max_loss)
        for b in batches:
            for ex, text in zip(b.column(0), b.column(1)):
                tokens = np.array(encode(enc, text.as_py()) if text.is_valid else [], ids)
                yield from out.add(ex.as_py(), 0, tokens, np.ones(len(tokens), bool))
            yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("ex_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def checked(*limits: int) -> None:
    if min(limits) < 1:
        raise ValueError("limits must be positive")


def pack(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack (ex_id, first_piece, parts); one row for each sequence (``OUT``; ``doc_ids`` holds the ex_ids, ``starts`` where each piece begins)."""
    checked(max_tokens, max_segments, max_loss)
    ids = id_type(vocabulary)
    return pack_pieces(cut_examples(examples, max_tokens, max_loss, ids), max_tokens, max_segments, max_loss, group, ids)


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Whole documents packed; every token bears loss, so the limit on those is the limit on tokens."""
    checked(max_tokens, max_segments)
    return pack_pieces(document_pieces(docs, max_tokens, max_tokens, vocabulary), max_tokens, max_segments, max_tokens, group, id_type(vocabulary))


def pack_pieces(pieces: DataFrame, max_tokens: int, max_segments: int, max_loss: int, group: int, ids: np.dtype) -> DataFrame:
    rows = cut(pieces)
    # Numbers of the rows of fixed files: dense inside each read partition, the same on every attempt.
    packed = rows.where("n_tokens > 0").withColumn("at", F.monotonically_increasing_id())
    groups = max(1, -(-packed.count() // group))
    limits = np.array([max_tokens, max_segments, max_loss], np.int64)

    def one(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.take(pa.array(np.lexsort([t.column(i).fill_null(-(1 << 62)).to_numpy() for i in (3, 2, 1, 0)])))
        size = np.column_stack([t.column(2).to_numpy(), np.ones(len(t), np.int64), t.column(3).to_numpy()])
        where, slot = dot_product(size, limits)
        order = np.lexsort([slot, where])
        t, where, size = t.take(pa.array(order)), where[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        upto = np.append(first, len(where))
        offset = np.concatenate([[0], np.cumsum(size[:, 0])])
        by_piece, by_token = pa.array(upto, pa.int32()), pa.array(offset[upto], pa.int32())
        flat = [t.column(i).combine_chunks() for i in (0, 1)]
        tokens = np.frombuffer(b"".join(t.column(4).to_pylist()), ids).astype(np.int32)
        loss = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(t.column(5).to_pylist(), size[:, 0].tolist())]).astype(bool)
        begin = offset[:-1] - np.repeat(offset[first], np.diff(upto))
        grp = t.column(6)[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(where[first] + (grp << 20)),
                pa.array(np.add.reduceat(size[:, 0], first)),
                pa.array(np.add.reduceat(size[:, 2], first)),
                pa.ListArray.from_arrays(by_piece, flat[0]),
                pa.ListArray.from_arrays(by_piece, flat[1]),
                pa.ListArray.from_arrays(by_piece, pa.array(begin, pa.int32())),
                pa.ListArray.from_arrays(by_token, pa.array(tokens)),
                pa.ListArray.from_arrays(by_token, pa.array(loss)),
            ],
            [c.split()[0] for c in OUT.split(", ")],
        )

    spread = packed.withColumn("grp", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int"))
    done = spread.repartitionById(groups, "grp").drop("at").mapInArrow(one, OUT)
    zero = F.lit(0).cast("long")
    none = rows.where("n_tokens = 0").select(F.lit(None).cast("long").alias("bin_id"), zero.alias("n_tokens"), zero.alias("n_loss"), F.array("ex_id").alias("doc_ids"), F.array("piece").alias("pieces"), F.array(F.lit(0)).alias("starts"), F.array().cast("array<int>").alias("tokens"), F.array().cast("array<boolean>").alias("loss"))
    return done.unionByName(none)


def encoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with ``tokens`` (ids as bytes, see ``id_type``) in the place of their last column, ``text``."""
    name, ids = shipped(rows.sparkSession, vocabulary), id_type(vocabulary)
    keep = rows.dtypes[:-1]

    def run(batches):
        enc = on_executor(name)
        for b in batches:
            got = [np.array(encode(enc, t.as_py()), ids).tobytes() if t.is_valid else b"" for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.binary())], [*(c for c, _ in keep), "tokens"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in keep), "tokens binary"]))


def conversation_examples(turns: DataFrame, vocabulary: str = VOCABULARY, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Each conversation as one example; its assistant turns bear the loss."""
    rows = turns.select(F.col("conv_id").cast("long").alias("ex_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"), F.col("text").cast("string").alias("text"))
    n = encoded(rows, vocabulary)
    block = F.coalesce(F.floor(F.col("turn") / max_tokens), F.lit(0)).cast("long")
    lone = F.when(F.col("ex_id").isNull(), F.monotonically_increasing_id())
    # Sets, so that copies of a turn are merged before they move.
    whole = n.withColumn("lone", lone).groupBy("ex_id", "lone", block.alias("block")).agg(F.sort_array(F.collect_set(F.struct("turn", "loss", "tokens"))).alias("parts"))
    return whole.select("ex_id", F.when(F.col("lone").isNull(), F.shiftleft("block", 32)).otherwise(F.lit(0)).alias("first_piece"), "parts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(conversation_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
