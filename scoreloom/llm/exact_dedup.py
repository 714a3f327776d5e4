r"""Exact duplicates by stateful streaming: keyed state on disk, without expiry, and full bytes checked on hits.

Texts are equal when they are the same after all of ``[\x20\x09-\x0D]`` is deleted. Of equal texts the row with the
most code points in the original text stays, then the smallest doc_id.

1. A stateless stream reads the folder of documents as files arrive and writes a fingerprint a row: SHA-256 of the
   normalised text, code points, doc_id and locator (file and row within it).
2. A stateful stream over the fingerprints keeps, for each digest and for good, the locator and identifier of the
   retained content, the rows seen, and the row that stays. State lies in RocksDB, with its log in the shared folder.
   Rows are combined per task before the shuffle, so a large group of copies is a row a task. Each micro-batch writes
   the digests that changed, under its number, so that one that is run again writes the same.
3. Hits, digests seen more than once, are checked: a scan finds their rows again (a Bloom filter of 8 MiB leaves out
   nearly all others), drops those whose bytes equal an earlier row's in the same window of a task, and the rest meet
   by digest, retained content first, which the locator names; each is compared with it byte by byte as they stream by.
4. Digests whose bytes differ (with SHA-256 there is none; tests use narrow digests) are grouped by whole texts.

With a ``home`` of the caller's, state and fingerprints stay there, and the next call reads the new files alone.

Null text is empty, and empty texts are equal. A null doc_id stands behind all others where code points tie. Rows that
repeat a doc_id are rows of their own; of equal ones the first by locator stays. No documents: no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, shared_dir
from . import common as C

#: Bytes of a digest; files of a micro-batch; bytes of distinct texts in a window of a task.
WIDTH, FILES, WINDOW = 32, 512, 1 << 25

SPACES = b" \t\n\x0b\x0c\r"

#: State on disk: RocksDB, whose memory on an executor is bounded; its changes go to the checkpoint, and it reserves no disk ahead (4 MB a partition).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A row's locator.
_AT = "_metadata.file_path AS file", "_metadata.row_index AS row"


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in C.slices(batches):
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        whole = data.tobytes()
        digest = [hashlib.sha256(normal(whole[a:b])).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(points[off])), pa.array(digest, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "chars", "sha", "file", "row"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, sha, file, row) of documents read from files; a stream gives a stream."""
    own = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text", *_AT)
    return own.mapInArrow(C.lean(_fingerprint), "doc_id long, chars long, sha binary, file string, row long")


def keyed(rows: DataFrame, width: int) -> DataFrame:
    """The state of each digest: rows seen, the retained content's locator and id, and the row that stays."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    return rows.groupBy(F.substring("sha", 1, width).alias("digest")).agg(F.count("*").alias("n"), F.min(F.struct("file", "row", "doc_id")).alias("at"), F.min(best).alias("best"))


def run_streams(spark: SparkSession, path: str, home: str, *, width: int = WIDTH, files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, digests with their latest state) after all files that lie in ``path`` now."""
    own = spark.newSession()
    for k, v in (STATE | {"spark.sql.shuffle.partitions": str(C.parts(spark))}).items():
        own.conf.set(k, v)
    docs = own.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file or a folder
    prints = f"{home}/fingerprints"
    ends = lambda q, name: q.trigger(availableNow=True).option("checkpointLocation", f"{home}/{name}").start().awaitTermination()
    ends(fingerprints(docs).writeStream.format("parquet").option("path", prints), "reading")
    rows = own.readStream.schema("doc_id long, chars long, sha binary, file string, row long").option("maxFilesPerTrigger", files).parquet(prints)
    ends(keyed(rows, width).writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{home}/changes/batch={i}")), "state")
    changes = spark.read.schema("digest binary, n long, at struct<file: string, row: long, doc_id: long>, best struct<less: long, none: boolean, doc_id: long, file: string, row: long>, batch long").parquet(f"{home}/changes")
    latest = changes.groupBy("digest").agg(F.max_by(F.struct("n", "at", "best"), "batch").alias("x")).select("digest", "x.*")
    return spark.read.schema("doc_id long, chars long, sha binary, file string, row long").parquet(prints), latest


# ----------------------------------------------------------------- hits


def _normal_texts(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """(digest, file, row, text): normalised texts of the digests in the filter, less those that equal one before in a window; the first locator of equal ones stays."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[bytes, dict[bytes, tuple[str, int]]] = {}
        held = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            flat = [(d, *at, t) for d, of in window.items() for t, at in of.items()]
            for i in range(0, len(flat), 1000):
                d, file, row, text = zip(*flat[i : i + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(file, pa.string()), pa.array(row, pa.int64()), pa.array(text, pa.binary())], ["digest", "file", "row", "text"])
            window.clear()

        for batch, data, off in C.slices(batches):
            whole = data.tobytes()
            texts = [normal(whole[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            digests = [hashlib.sha256(t).digest()[:width] for t in texts]
            hit = C.in_bloom(shared.value, np.frombuffer(b"".join(_hash(d) for d in digests), "<i8"))
            for i in np.flatnonzero(hit).tolist():
                at = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                of = window.setdefault(digests[i], {})
                if texts[i] not in of:  # dictionaries compare whole bytes
                    held += len(texts[i]) + 200
                of[texts[i]] = min(at, of.get(texts[i], at))
            if held > WINDOW:
                yield from passed_on()
                held = 0
        yield from passed_on()

    return docs.selectExpr("text", *_AT).mapInArrow(C.lean(run), "digest binary, file string, row long, text binary")


def _hash(digest: bytes) -> bytes:
    """Eight bytes of a digest of any width."""
    return digest[:8].ljust(8, b"\0")


def _bloom_key() -> Column:
    """The same as a long: Spark reads hex from the high byte, so the bytes are reversed."""
    return F.conv(F.concat(*[F.rpad(F.hex(F.substring("digest", i, 1)), 2, "0") for i in range(8, 0, -1)]), 16, -10).cast("long")


def differing(docs: DataFrame, groups: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Digests of ``groups`` (digest, n, at) with more than one text: every hit is compared with the retained content at its locator."""
    hits = groups.where(F.col("n") > 1).select("digest", F.col("at.file").alias("its_file"), F.col("at.row").alias("its_row"))
    met = _normal_texts(docs, C.bloom(hits.select(_bloom_key())), width).repartition("digest").join(hits, "digest")
    met = met.select("digest", "text", ((F.col("file") != F.col("its_file")) | (F.col("row") != F.col("its_row"))).alias("later")).sortWithinPartitions("digest", "later")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = content = None
        told: bytes | None = None
        for batch in batches:
            out = []
            for digest, text, later in zip(*(batch.column(i) for i in range(3)), strict=True):
                digest, text = digest.as_py(), text.as_py()
                if digest != last:
                    if later.as_py():
                        raise RuntimeError("the retained content is not where its locator says")
                    last, content = digest, text
                elif text != content and told != digest:
                    told = digest
                    out.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    return met.mapInArrow(C.lean(compare), "digest binary")


def _by_text(docs: DataFrame, digests: DataFrame, width: int) -> DataFrame:
    """Rows of ``digests``, grouped by whole normalised texts."""
    text = F.translate("text", SPACES.decode(), "")
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", *_AT).withColumns({"chars": F.length("text").cast("long"), "text": text})
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).join(digests.select(F.col("digest").alias("d")), F.substring("sha", 1, width) == F.col("d"), "left_semi")
    w = Window.partitionBy("text")
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    return rows.select("doc_id", "sha", "file", "row", F.count("*").over(w).alias("group_size"), F.min(best).over(w).alias("best"))


def dedup(spark: SparkSession, path: str, *, home: str | None = None, width: int = WIDTH, files: int = FILES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of the Parquet file or folder ``path``; see the module's doc.

    ``home``: folder, shared by driver and executors, where streams go on from; without it a new one.
    """
    home = home or f"{shared_dir(spark)}/scoreloom-exact-{uuid.uuid4().hex}"
    prints, latest = run_streams(spark, path, home, width=width, files=files)
    groups = materialize(latest, "digests")
    docs = spark.read.schema("doc_id long, text string").parquet(path)
    collided = materialize(differing(docs, groups, width=width), "collisions")
    rows = prints.withColumn("digest", F.substring("sha", 1, width))
    other = None
    if not collided.isEmpty():
        other = _by_text(docs, collided, width)
        rows, groups = rows.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti")
    out = C.hot_join(rows, groups.select("digest", "n", F.col("n").alias("group_size"), "best"), "digest", rows="n").select("doc_id", "sha", "file", "row", "group_size", "best")
    out = out.unionByName(other) if other is not None else out
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""
