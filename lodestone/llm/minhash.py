"""Near-dedup with Circulant MinHash, banding and exact Jaccard verification.

A document is its set of hashed word trigrams (lower case, marks dropped). One permutation of the 32-bit ring,
sigma, shuffles the set once; the second, pi, is shifted circularly for each coordinate:
``h_k = min pi(sigma(x) - k mod 2^32)``. ``BANDS`` bands of ``ROWS`` coordinates give the candidates.

Documents with equal sets are one from the start: inside a batch each copy is linked to the batch's first, and only
those go on. Inside a band's bucket each set is paired with the bucket's first and with the one before it
(linear in the bucket, whatever its size); pairs are verified exactly, verified pairs give connected components, and
the members of buckets that still hold several components are then compared across components by signature, in blocks
of ``BLOCK`` (a task for each pair of blocks of a large bucket; what isn't likely is never emitted). Pairs whose
signatures (one byte of each coordinate) agree in a share that is ``SLACK`` below the threshold - more than four standard
deviations - count as unlike; every other candidate pair ends in one component or has been verified itself.
Verification moves the 32-bit shingle sets of documents that pairs name, which an id filter of bounded size picks
before anything is shuffled. A group is a component of verified pairs (Jaccard >= ``THRESHOLD``).

Defined results: null and empty texts and texts without words aren't compared and form groups of their own;
texts of fewer than three words compare as a whole; the smallest ``doc_id`` of a group represents it; rows
with one ``doc_id`` are one document (its trigrams those of all its rows' texts, each compared by itself); a null
``doc_id`` is a group of its own that is always kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, maybe_in, without_ids
from ._text import Tokens, mix, pieces, strings

SHINGLE = 3
BANDS, ROWS = 48, 4
THRESHOLD = 0.5
SLACK = 0.2
#: Members of a bucket that are compared with each other in one task.
BLOCK = 512


def sigma(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit ring (murmur's finaliser)."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def pi(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Another bijection, into the buffer ``a``."""
    np.multiply(x, np.uint32(0x9E3779B1), out=a)
    np.right_shift(a, np.uint32(15), out=b)
    np.bitwise_xor(a, b, out=a)
    np.multiply(a, np.uint32(0x2C1B3C6D), out=a)
    np.right_shift(a, np.uint32(12), out=b)
    np.bitwise_xor(a, b, out=a)
    np.multiply(a, np.uint32(0x297A2D39), out=a)
    return a


def shingles(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit shingle), sorted and distinct inside a row."""
    doc, h = Tokens(col).grams(k)
    key = np.sort((doc.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


def signatures(shingle: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n x sets; ``starts``: where each (non-empty) set begins."""
    out = np.empty((n, len(starts)), np.uint32)
    block = 1 << 15
    i = 0
    ends = np.append(starts[1:], len(shingle))
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        x = sigma(shingle[starts[i] : ends[j - 1]])
        a, b, y = np.empty_like(x), np.empty_like(x), np.empty_like(x)
        at = starts[i:j] - starts[i]
        for k in range(n):
            np.subtract(x, np.uint32(k), out=y)
            out[k, i:j] = np.minimum.reduceat(pi(y, a, b), at)
        i = j
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, set1, set2, n, same, bands, sig): two sums over the set as its name, a hash for each band, a byte of each coordinate.

    ``same`` is the document with an equal set that comes first in the batch; those behind it have no bands and signature.
    """

    def find(batches):
        for b in batches:
            ids = b.column(0)
            seen: dict[tuple[int, int, int], int] = {}
            for at, piece in pieces(strings(b.column(1), lower=True)):
                row, s = shingles(piece)
                if not len(row):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                wide = s.astype(np.uint64)
                one, two = (np.add.reduceat(mix(wide + np.uint64(c)), starts).view(np.int64) for c in (0x1234567, 0x7654321 << 20))
                n = np.diff(np.append(starts, len(s)))
                own = ids.take(pa.array(at + row[starts]))
                same, new = np.empty(len(starts), np.int64), np.zeros(len(starts), bool)
                for i, (k, doc) in enumerate(zip(zip(one.tolist(), two.tolist(), n.tolist()), own.to_pylist())):
                    new[i] = k not in seen
                    same[i] = seen.setdefault(k, doc)
                firsts = np.flatnonzero(new)
                sig = np.zeros((bands * rows, 0), np.uint32)
                if len(firsts):
                    keep = np.repeat(new, n)
                    sig = signatures(s[keep], np.cumsum(n[firsts]) - n[firsts], bands * rows)
                low = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8).T)
                sig = sig.astype(np.uint64)
                with np.errstate(over="ignore"):
                    keys = []
                    for k in range(bands):
                        h = np.full(len(firsts), k + 1, np.uint64)
                        for r in range(rows):
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[k * rows + r])
                        keys.append(h.view(np.int64))
                flat = pa.array(np.ascontiguousarray(np.stack(keys, axis=1)).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(firsts) + 1, bands), pa.int32()), flat)
                place = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
                yield pa.RecordBatch.from_arrays([own, pa.array(one), pa.array(two), pa.array(n), pa.array(same), lists.take(place), pa.array([x.tobytes() for x in low], pa.binary()).take(place)], ["doc_id", "set1", "set2", "n", "same", "bands", "sig"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, "doc_id long, set1 long, set2 long, n long, same long, bands array<long>, sig binary")


def agreement(sa: list[bytes], sb: list[bytes]) -> np.ndarray:
    """Share of equal coordinates of each of one list with each of the other."""
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (sa, sb))
    out = np.empty((len(a), len(b)), np.float32)
    for i in range(len(a)):
        out[i] = (a[i] == b).mean(axis=1)
    return out


def signatures_of(ids: DataFrame, sketches: DataFrame) -> DataFrame:
    """(id, sig) of the documents named by ``ids`` (id) and maybe of some others, each set of one document once."""
    rows = sketches.select(F.col("doc_id").alias("id"), "set1", "sig")
    return maybe_in(rows, "id", ids, "may").where("may").select("id", "set1", "sig").repartition("id").dropDuplicates(["id", "set1"]).select("id", "sig")


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures don't rule the threshold out."""
    sig = signatures_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), sketches)
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8) for i in (2, 3))
            use = pa.array((sa == sb).mean(axis=1) >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(use), batch.column(1).filter(use)], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long").distinct()


def jaccard(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` (distinct) whose exact similarity reaches ``threshold``."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def reduce(batches):
        for b in batches:
            for at, piece in pieces(strings(b.column(1), lower=True)):
                row, s = shingles(piece)
                first = np.searchsorted(row, np.arange(len(piece) + 1)).tolist()
                own = dict.fromkeys((i, s[x:y].tobytes()) for i, x, y in zip(b.column(0).slice(at, len(piece)).to_pylist(), first, first[1:]) if y > x)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([v for _, v in own], pa.binary())], ["id", "set"])

    # Repeated rows go before the joins.
    sets = maybe_in(texts, "id", involved, "may").where("may").select("id", "text").mapInArrow(reduce, "id long, set binary").repartition("id").dropDuplicates(["id", "set"])
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches):
        for batch in batches:
            share = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                every = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((every[1:] == every[:-1]).sum())
                share[i] = shared / (len(every) - shared)
            use = pa.array(share >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(use), batch.column(1).filter(use)], ["a", "b"])

    return both.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component, for ids that have an edge (alternating large and small stars)."""

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = nearest(both).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = nearest(large)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = cut(small.where("u <> v").distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def across(rest: DataFrame, known: DataFrame, sketches: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Likely (a, b) across components (``root``) of the buckets (h, id, root, n), without those of ``known``.

    Small buckets are paired by a join, at most ``block / 2`` partners a member. The members of larger ones go to blocks, and
    a task compares two blocks.
    """
    small, large = rest.where(F.col("n") <= block // 2), rest.where(F.col("n") > block // 2)
    pairs = small.select("h", F.col("id").alias("a"), F.col("root").alias("ra")).join(small.select("h", F.col("id").alias("b"), F.col("root").alias("rb")), "h").where("a < b and ra <> rb").select("a", "b").distinct()
    found = likely(cut(pairs.join(known, ["a", "b"], "left_anti")), sketches, threshold)
    if large.isEmpty():
        return found
    # Every member is sent to the tasks of its block with each block.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "h"), blocks).cast("int")
    sent = large.join(signatures_of(large.select("id").distinct(), sketches), "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sent = sent.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "root", "sig")

    def compare(table: pa.Table) -> pa.Table:
        own, lo, hi, ids, root = (table.column(c).to_numpy() for c in ("own", "lo", "hi", "id", "root"))
        s = table.column("sig").to_pylist()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = agreement([s[i] for i in left], [s[i] for i in right]) >= threshold - SLACK
        near &= root[left][:, None] != root[right][None, :]
        x, y = np.nonzero(near)
        x, y = ids[left[x]], ids[right[y]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    more = sent.groupBy("h", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()
    return found.union(more.join(known, ["a", "b"], "left_anti")).distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, root) of every document that has a near duplicate with a smaller ``doc_id``."""
    found = cut(sketch(docs, bands, rows))
    firsts = found.where("bands is not null")
    sets = Window.partitionBy("set1", "set2", "n").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    equal = firsts.select("doc_id", F.first("doc_id").over(sets).alias("same")).unionByName(found.select("doc_id", "same")).where("doc_id <> same").select(F.col("doc_id").alias("a"), F.col("same").alias("b"))
    # One exchange by band; of equal sets a bucket counts the smallest document, which is the same in all of them.
    keys = firsts.select(F.col("doc_id").alias("id"), "set1", F.explode("bands").alias("h")).repartition("h").groupBy("h", "set1").agg(F.min("id").alias("id"))
    order = Window.partitionBy("h").orderBy("id")
    near = keys.withColumns({"head": F.first("id").over(order.rowsBetween(Window.unboundedPreceding, 0)), "prev": F.lag("id").over(order)})
    buckets = cut(near.where("id <> head").select("h", "id", "head", "prev"))
    pairs = cut(buckets.select(F.explode(F.array_distinct(F.array("head", "prev"))).alias("a"), F.col("id").alias("b")).where("a <> b").distinct())
    good = cut(jaccard(cut(likely(pairs, firsts, threshold)), docs, threshold).union(equal))
    linked = components(good)
    # Buckets that still hold several components.
    members = buckets.select("h", "id").union(buckets.select("h", F.col("head").alias("id"))).distinct()
    labelled = members.join(linked, "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))
    mixed = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("h", "n")
    rest = cut(labelled.join(mixed, "h"))
    more = cut(jaccard(cut(across(rest, pairs, firsts, threshold, block)), docs, threshold))
    return components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)) if not more.isEmpty() else linked


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    named = ids.join(groups(docs, threshold, bands, rows).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    sizes = named.where("group_id is not null").groupBy("group_id").agg(F.countDistinct("doc_id").alias("group_size"))
    return named.join(sizes, "group_id", "left").select("doc_id", "group_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("keep"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, without those that have a near duplicate with a smaller ``doc_id``."""
    return without_ids(docs, "doc_id", cut(groups(docs, threshold).select("id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
