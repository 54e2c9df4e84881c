"""Duplicates hidden by formatting: an incremental ledger of canonical-key counts.

The ledger is a folder of buckets (by hash of the canonical key). A batch of records is aggregated to one row per key,
full-outer-joined against the buckets it touches, counts are added and the earliest representative is kept. Only
touched buckets are written again, as a new version; a numbered manifest names the version of each bucket that holds. It is
written under another name and renamed last, and the newest one that is whole counts, so whatever is lost on the way
the ledger is as before the update or after it. Versions that the two newest manifests do not name are removed.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path, stored
from ..plans.skew import lookup

_DROP = re.compile(r"[\W_]+")
#: Marks that show nothing of their own: variation selectors, joiners, enclosing marks.
_UNSEEN = re.compile("[͏⃝-⃤︀-️\U000e0100-\U000e01ef]")
SCHEMA = "bucket int, key binary, copies long, first_at timestamp, first_id long, least_id long"


def canonical(text: str | None) -> str:
    """Letters and digits of a text in order, composed and without regard to case; '' if it holds none.

    Accents count (they are composed with their letters, or stay as marks behind them); white space, punctuation,
    symbols and invisible characters do not.
    """
    if not text:
        return ""
    if text.isascii():
        return _DROP.sub("", text).lower()
    s = unicodedata.normalize("NFC", _UNSEEN.sub("", text).casefold())
    out, last = [], False
    for c in s:
        if c.isalnum():
            out.append(c)
            last = True
        elif last and unicodedata.category(c) in ("Mn", "Mc"):
            out.append(c)
        elif unicodedata.category(c) != "Cf":
            last = False
    return unicodedata.normalize("NFC", "".join(out))


def keyed(records: DataFrame, fields: tuple[str, ...], row_id: str = "page_id", at: str = "fetched_at", loaded: str = "loaded_at") -> DataFrame:
    """``row_id, at, loaded_at, key``: the key is a 128-bit hash of the sorted canonical fields. Records with a field that holds
    no letter or digit have no key and are left out (nothing says that they are the same)."""
    import hashlib

    def run(frames):
        for b in frames:
            cols = [[canonical(x) for x in b.column(i + 3).to_pylist()] for i in range(len(fields))]
            keys = [hashlib.blake2b("\x00".join(sorted(t)).encode(), digest_size=16).digest() if all(t) else None for t in zip(*cols)]
            keep = pa.array([k is not None for k in keys])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), b.column(2).filter(keep), pa.array(keys, pa.binary()).filter(keep)], names=["row_id", "at", "loaded_at", "key"])

    some = records.select(F.col(row_id).cast("long"), F.col(at).cast("timestamp"), F.col(loaded).cast("timestamp"), *[F.col(f) for f in fields])
    for f in fields:
        some = some.filter(F.length(f) > 0)
    return some.mapInArrow(run, "row_id long, at timestamp, loaded_at timestamp, key binary")


#: Keys a bucket should hold at most, and rows a task writes.
BUCKET_KEYS = 2_000_000
_MANIFEST = re.compile(r"manifest-(\d{9})\.json")


class Ledger:
    """Counts of canonical keys, kept in ``path``. ``buckets``: into how many parts (an existing ledger keeps its own)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")
        self.number, state = self._newest()
        self.buckets: int = state.get("buckets", buckets)
        self.keys: int = state.get("keys", 0)
        self.versions: dict[int, str] = {int(k): v for k, v in state.get("versions", {}).items()}

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._at()
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _read(self, name: str) -> dict | None:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest that is whole; 0 and nothing for a new ledger."""
        for number in sorted((int(m[1]) for m in map(_MANIFEST.fullmatch, self._names()) if m), reverse=True):
            state = self._read(f"manifest-{number:09d}.json")
            if state is not None:
                return number, state
        return 0, {}

    def _publish(self) -> None:
        state = {"buckets": self.buckets, "keys": self.keys, "versions": self.versions}
        name = f"manifest-{self.number + 1:09d}.json"
        fs, new = self._at(f"{name}.{uuid.uuid4().hex}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(new, self._at(name)[1]):
            raise RuntimeError(f"another update of {self.path} came first")
        self.number += 1
        before = self._read(f"manifest-{self.number - 1:09d}.json") if self.number > 1 else None
        named = set(self.versions.values()) | set((before or {}).get("versions", {}).values())
        for n in self._names():
            m = _MANIFEST.fullmatch(n)
            if (n.startswith("v-") and n not in named) or (m and int(m[1]) < self.number - 1):
                fs.delete(self._at(n)[1], True)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The ledger's rows, of some buckets or all."""
        paths = sorted({f"{self.path}/{v}/bucket={b}" for b, v in self.versions.items() if buckets is None or b in buckets})
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        versions = sorted({v for b, v in self.versions.items() if buckets is None or b in buckets})
        parts = []
        for v in versions:
            own = [f"{self.path}/{v}/bucket={b}" for b, w in self.versions.items() if w == v and (buckets is None or b in buckets)]
            parts.append(self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/{v}").parquet(*own))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("bucket", "key", "copies", "first_at", "first_id", "least_id")

    def update(self, batch: DataFrame) -> None:
        """Adds a batch of ``keyed`` rows. An empty batch changes nothing."""
        new = stored(
            batch.groupBy("key").agg(
                F.count("*").alias("n"), F.min(F.struct(F.coalesce("at", F.lit("9999-12-31").cast("timestamp")).alias("at"), "row_id")).alias("first"), F.min("row_id").alias("least")
            ).select(self.bucket_of(F.col("key")).alias("bucket"), "key", "n", "first", "least"),
            "ledger-batch",
        )
        touched = {r[0] for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        if not touched:
            return
        old = self.rows(touched)
        was = F.struct(F.col("first_at").alias("at"), F.col("first_id").alias("row_id"))
        both = old.join(new, ["bucket", "key"], "full_outer").select(
            "bucket", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least(F.when(F.col("first_id").isNotNull(), was), F.col("first")).alias("first"), F.least("least_id", "least").alias("least_id"),
        ).select("bucket", "key", "copies", F.col("first.at").alias("first_at"), F.col("first.row_id").alias("first_id"), "least_id")
        version = f"v-{uuid.uuid4().hex}"
        self.keys += new.count()  # at most so many keys
        # a bucket with many keys is written by several tasks
        splits = max(1, -(-self.keys // (self.buckets * BUCKET_KEYS)))
        both.repartition(len(touched) * splits, "bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(splits))).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{version}")
        self.versions |= {b: version for b in touched}
        self._publish()


def fill(ledger: Ledger, rows: DataFrame, batches: int = 3) -> DataFrame:
    """Feeds ``keyed`` rows with a ``loaded_at`` column to the ledger in ``batches`` spans of loading time, oldest first."""
    least, most = rows.agg(F.min("loaded_at").cast("double"), F.max("loaded_at").cast("double")).first()
    if least is None:
        ledger.update(rows)
        return ledger.rows()
    step = (most - least) / batches
    at = F.coalesce(F.col("loaded_at").cast("double"), F.lit(most))
    for i in range(batches):
        ledger.update(rows.filter(((at >= least + i * step) if i else F.lit(True)) & ((at < least + (i + 1) * step) if i < batches - 1 else F.lit(True))))
    return ledger.rows()


def hidden_duplicates(records: DataFrame, fields: tuple[str, ...] = ("title", "meta_description"), row_id: str = "page_id", at: str = "fetched_at", loaded: str = "loaded_at", ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, ledger rows with at least two copies) after all records have gone through the ledger.

    Nulls and texts without letters or digits have no key; repeated rows count as copies; an empty table gives empty results.
    """
    spark = records.sparkSession
    rows = stored(keyed(records, fields, row_id, at, loaded), "ledger-keys")
    ledger = ledger or Ledger(spark, buckets=max(64, rows.count() // BUCKET_KEYS))
    return rows, fill(ledger, rows).filter("copies >= 2")


def copies_of_first(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``: of each group of copies its smallest id, with every other id in turn."""
    total = rows.count()
    pairs = lookup(rows.select("key", "row_id"), repeated.select("key", "least_id", "copies"), ["key"], ["least_id"], "copies", max(total, 1), F.col("row_id"))
    return pairs.filter(F.col("least_id") < F.col("row_id")).select(F.col("least_id").alias("row_id_a"), F.col("row_id").alias("row_id_b")).distinct()
