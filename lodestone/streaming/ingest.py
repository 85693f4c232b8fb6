"""Incremental datasets: add, delete, flush, compact, resume, over Parquet with a versioned manifest.

A flush writes the new split's documents and tombstones as Parquet, then one manifest file; a reader takes the highest
manifest, so a failed flush leaves nothing visible. A manifest's version is claimed by creating a file that mustn't
exist, and follows from the version the writer has read: a second writer fails instead of losing splits. The manifest keeps
the last micro-batch of each stream, so one that is replayed adds nothing twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import assign_ranks
from ..operators.splits import alive
from ..sources.staging import filesystem

SCHEMA, DEAD = "doc long, text string", "doc long"


class ConcurrentWriter(RuntimeError):
    """Another writer has published since this one read the manifest."""


class SplitWriter:
    def __init__(self, spark: SparkSession, path: str, flush_bytes: int | None = None):
        """``flush_bytes``: pending text from which ``add`` flushes by itself."""
        self.spark, self.path, self.flush_bytes = spark, path.rstrip("/"), flush_bytes
        self.adds: list[DataFrame] = []
        self.deletes: list[DataFrame] = []
        self.pending_docs = self.pending_bytes = 0
        self._read()

    def _read(self) -> None:
        fs, p = filesystem(self.spark, f"{self.path}/manifest")
        self.version = max([int(f.getPath().getName()) for f in fs.listStatus(p)] or [0]) if fs.exists(p) else 0
        self.state = json.loads(self.spark.read.text(f"{self.path}/manifest/{self.version}", wholetext=True).first().value) if self.version else {"splits": [], "batches": {}}
        self.next_doc = max([s["hi"] + 1 for s in self.splits() if s["n"]] or [0])
        self.epoch = max([s["epoch"] for s in self.splits()] or [0]) + 1

    def splits(self) -> list[dict]:
        return self.state["splits"]

    def _publish(self, splits: list[dict], batch: tuple[str, int] | None = None) -> None:
        v = self.version + 1
        state = {"splits": splits, "batches": self.state["batches"] | ({batch[0]: batch[1]} if batch else {})}
        fs, target = filesystem(self.spark, f"{self.path}/manifest/{v}")
        claim = filesystem(self.spark, f"{self.path}/claims/{v}")[1]
        if fs.exists(target):
            raise ConcurrentWriter(f"version {v} is there already")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise ConcurrentWriter(f"version {v} is claimed; if its writer is gone, remove {self.path}/claims/{v}") from e
        temp = filesystem(self.spark, f"{self.path}/manifest-{v}.tmp")[1]
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        if not fs.rename(temp, target):
            raise ConcurrentWriter(f"version {v} can't be published")
        self.version, self.state = v, state

    def add(self, rows: DataFrame, order: str) -> None:
        """Documents (text, ...) get the next ids in ``order``; texts without words use an id as well."""
        rows = assign_ranks(rows, None, order).select((F.col("doc") + self.next_doc).alias("doc"), "text")
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.next_doc, self.pending_docs, self.pending_bytes = self.next_doc + n, self.pending_docs + n, self.pending_bytes + size
        self.adds.append(rows)
        if self.flush_bytes is not None and self.pending_bytes >= self.flush_bytes:
            self.flush()

    def delete(self, docs: int | DataFrame) -> None:
        """A document, or all of a column ``doc``."""
        self.deletes.append(docs.select(F.col("doc").cast("long").alias("doc")) if isinstance(docs, DataFrame) else self.spark.createDataFrame([(docs,)], DEAD))

    def _write(self, docs: DataFrame, dead: DataFrame, epoch: int) -> dict:
        """A new split under a name of its own, not published yet."""
        name = f"split-{epoch}-{uuid.uuid4().hex[:8]}"
        docs.write.parquet(f"{self.path}/{name}/docs")
        dead.where("doc is not null").distinct().write.parquet(f"{self.path}/{name}/tombstones")
        r = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}/docs").agg(F.min("doc"), F.max("doc"), F.count("*")).first()
        n = self.spark.read.schema(DEAD).parquet(f"{self.path}/{name}/tombstones").count()
        return {"name": name, "lo": r[0] or 0, "hi": r[1] or 0, "n": r[2], "epoch": epoch, "delta": True, "dead": n}

    def flush(self, batch: tuple[str, int] | None = None) -> dict | None:
        """Writes what is pending as one delta split; None if nothing is. Only deletes make a split without documents."""
        if not self.adds and not self.deletes:
            if batch:
                self._publish(self.splits(), batch)
            return None
        data, dead = self.spark.createDataFrame([], SCHEMA), self.spark.createDataFrame([], DEAD)
        for a in self.adds:
            data = data.unionByName(a)
        for d in self.deletes:
            dead = dead.union(d)
        split = self._write(data, dead, self.epoch)
        self._publish([*self.splits(), split], batch)
        self.adds, self.deletes, self.epoch = [], [], self.epoch + 1
        self.pending_docs = self.pending_bytes = 0
        return split

    def _union(self, splits: list[dict], part: str, schema: str) -> DataFrame:
        names = [f"{self.path}/{s['name']}/{part}" for s in splits if s["n" if part == "docs" else "dead"]]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def tombstones(self) -> DataFrame:
        return self._union(self.splits(), "tombstones", DEAD)

    def read(self) -> DataFrame:
        """The documents that no tombstone hides."""
        return alive(self._union(self.splits(), "docs", SCHEMA), self.tombstones())

    def compact(self, names: list[str]) -> dict:
        """Rewrites delta splits as one: ids stay, hidden documents go, tombstones are carried on."""
        mine = [s for s in self.splits() if s["name"] in names]
        if not mine or len(mine) != len(set(names)) or not all(s["delta"] for s in mine):
            raise ValueError("only existing delta splits can be compacted")
        dead = self._union(mine, "tombstones", DEAD)
        split = self._write(alive(self._union(mine, "docs", SCHEMA), dead), dead, max(s["epoch"] for s in mine))
        self._publish([s for s in self.splits() if s["name"] not in names] + [split])
        return split


def ingest_batch(rows: DataFrame, batch: int, path: str, order: str, source: str = "stream") -> bool:
    """One micro-batch as one flush; False where the manifest has this batch already."""
    w = SplitWriter(rows.sparkSession, path)
    if w.state["batches"].get(source, -1) >= batch:
        return False
    new, gone = rows.where("op = 'add'"), rows.where("op = 'delete'")
    if not new.isEmpty():
        w.add(new.select(order, "text"), order)
    if not gone.isEmpty():
        w.delete(gone)
    w.flush((source, batch))
    return True


def stream_into(stream: DataFrame, path: str, order: str, checkpoint: str, source: str = "stream"):
    """Each micro-batch becomes one flush; rows with ``op = 'delete'`` carry the document's id in ``doc``. Replayed batches are skipped."""
    return stream.writeStream.foreachBatch(lambda rows, batch: ingest_batch(rows, batch, path, order, source) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
