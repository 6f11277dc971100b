"""Line dedup that can be taken back: exact reference counts of lines, with sharded cuckoo filters in front of them.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, as a digest of 128 bits. An index is a folder of
versions; each insertion or deletion of documents appends one, which counts only once its row in `commits` is there, so a
job that is killed leaves the index as it was and can run again. A version holds
  holders: (key, doc, sign), one row for each document that gains or loses a key;
  refs:    (key, n, doc) of the keys that changed: in how many documents each is now, and the largest of them;
  filters: (shard, seen, repeated) of the shards that changed: cuckoo filters of the keys that any document has, and of those that
           at least least_docs have.
Only the newest row of a key or shard counts. On an insertion, the keys of the new documents meet their shard's `seen` filter: what it
doesn't know is new for certain, and only the rest is looked up in the exact counts. On cleaning, the `repeated` filters go to the tasks while
they are small (`filter_bytes`) and spare all lines but repeated ones the exact join; beyond that size the join reads all holders. Filters never decide
anything: a positive is looked up in the counts. A deletion takes keys out of the filters as their counts fall, and finds a key's
largest document among the holders that are left, so inserting documents and deleting them again gives the index as it was.

Counts are sums over (key, document) rows with partial sums before the shuffle, so a line that every document has is no hot key. A shard holds
about keys_per_shard keys when it is built; when there are twice as many keys, `reshard` deals them out anew.

Defined cases: a null text has one empty line and stays null; keys of fewer than least_chars code points are never dropped; rows with equal
ids, and rows without id, are one document (the one without id is the smallest); inserting an id that is in the index is an error, as is a
deletion's id that isn't in it no error; an empty table changes nothing; extra columns stay, those named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom.llm.common import SPACE_CHARS, materialize, slices
from sparkloom.llm.cuckoo import Cuckoo, digests

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def key_of(line: str) -> bytes:
    return hashlib.blake2b(line.strip(SPACE_CHARS).encode().translate(LOWER), digest_size=16).digest()


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(key, doc): the keys of each document's lines, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                lists = pc.split_pattern(pc.fill_null(part, "").cast(pa.large_string()), "\n")
                lines = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(lists), characters=SPACE_CHARS))
                long = pc.greater_equal(pc.utf8_length(lines), least_chars)
                coded = pc.dictionary_encode(lines.filter(long))
                rows = pc.list_parent_indices(lists).filter(long).to_numpy(zero_copy_only=False)
                names = coded.dictionary.cast(pa.large_binary()).to_pylist()
                rows, codes = np.divmod(np.unique(rows * max(1, len(names)) + coded.indices.to_numpy(zero_copy_only=False)), max(1, len(names)))
                keys = pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in names], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(codes)), ids.take(pa.array(rows))], names=["key", "doc"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"key binary, doc {kind}")


def _change(filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filters after the changes of its keys (key, seen, repeated: 1 comes, -1 goes)."""
    keys, out = digests(changes["key"].to_pylist()), []
    for name in ("seen", "repeated"):
        change = changes[name].to_numpy()
        old = filters[name][0].as_py() if filters.num_rows else None
        # Room for as many again, and for a quarter of the keys to be repeated.
        cuckoo = Cuckoo.read(old) if old else Cuckoo.sized(max(2 * int((change > 0).sum()), len(change) // 4))
        cuckoo.remove(keys[change < 0])
        cuckoo.add(keys[change > 0])
        out.append(pa.array([cuckoo.write()], pa.binary()))
    return pa.Table.from_arrays([changes["shard"].combine_chunks().slice(0, 1), *out], names=["shard", "seen", "repeated"])


def _cochange(filters: pa.Table, changes: pa.Table) -> pa.Table:
    return _change(filters, changes) if changes.num_rows else filters.slice(0, 0)


def _build(changes: pa.Table) -> pa.Table:
    return _change(changes.slice(0, 0), changes)


def _probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
    """keys with `maybe`: whether the shard's filter knows them."""
    maybe = np.zeros(keys.num_rows, bool)
    if filters.num_rows and keys.num_rows:
        maybe = Cuckoo.read(filters["seen"][0].as_py()).has(digests(keys["key"].to_pylist()))
    return keys.append_column("maybe", pa.array(maybe, pa.bool_()))


FILTERS = "shard long, seen binary, repeated binary"
COMMITS = "version long, folder string, op string, shards long, least_docs long, least_chars long, keys long, built_for long"


class LineIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, least_docs: int = 3, least_chars: int = 20, keys_per_shard: int = 250_000):
        self.spark, self.path, self.keys_per_shard = spark, path.rstrip("/"), keys_per_shard
        self.least_docs, self.least_chars = least_docs, least_chars
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        self.commits = sorted(spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()) if there else []  # a row a version
        if self.commits and (self.commits[-1]["least_docs"], self.commits[-1]["least_chars"]) != (least_docs, least_chars):
            raise ValueError("the index was made with other limits")

    @property
    def shards(self) -> int:
        return self.commits[-1]["shards"] if self.commits else 0

    def _folder(self, op: str) -> str:
        return f"{self.path}/v{len(self.commits):06d}-{op}-{uuid.uuid4().hex}"

    def _commit(self, folder: str, op: str, shards: int, keys: int, built: bool = False) -> None:
        row = (len(self.commits), folder, op, shards, self.least_docs, self.least_chars, keys, keys if built else self.commits[-1]["built_for"])
        new = self.spark.createDataFrame([row], COMMITS)
        new.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.commits += new.collect()

    def _write(self, df: DataFrame, folder: str, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def _read(self, name: str, schema: StructType | str, since: str | None = None) -> DataFrame:
        """A table's rows over all versions, with their version."""
        found = [c for c in self.commits if since is None or c["version"] >= max(x["version"] for x in self.commits if x["op"] in (since, "insert0"))]
        parts = [self.spark.read.schema(schema).parquet(f"{c['folder']}/{name}").withColumn("version", F.lit(c["version"])) for c in found]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.commits[0]['folder']}/refs").schema["doc"].dataType.simpleString()

    def holders(self) -> DataFrame:
        """(key, doc) as it is now."""
        all_ = self._read("holders", f"key binary, doc {self._kind()}, sign int")
        if all(c["op"] != "delete" for c in self.commits):
            return all_.select("key", "doc")
        return all_.groupBy("key", "doc").agg(F.sum("sign").alias("sign")).where("sign > 0").select("key", "doc")

    def refs(self, wanted: DataFrame | None = None) -> DataFrame:
        """(key, n, doc) as it is now: the number of documents with this line and the largest of them. wanted: a table whose keys are enough."""
        all_ = self._read("refs", f"key binary, n long, doc {self._kind()}")
        if wanted is not None:
            all_ = all_.join(wanted.select("key"), "key", "left_semi")
        if len(self.commits) > 1:
            all_ = all_.groupBy("key").agg(F.max_by(F.struct("n", "doc"), "version").alias("now")).select("key", "now.n", "now.doc")
        return all_.select("key", "n", "doc").where("n > 0")

    def filters(self) -> DataFrame:
        """(shard, seen, repeated) as they are now."""
        all_ = self._read("filters", FILTERS, since="reshard")
        return all_.groupBy("shard").agg(F.max_by(F.struct("seen", "repeated"), "version").alias("now")).select("shard", "now.seen", "now.repeated")

    def _shard(self, shards: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(shards))

    def _build_filters(self, refs: DataFrame, shards: int) -> DataFrame:
        keys = refs.select(self._shard(shards).alias("shard"), "key", F.lit(1).alias("seen"), (F.col("n") >= self.least_docs).cast("int").alias("repeated"))
        return keys.groupBy("shard").applyInArrow(_build, FILTERS)

    def _change_filters(self, refs: DataFrame) -> DataFrame:
        """The filters of the shards where counts changed from `before` to `n`."""
        step = lambda least: ((F.col("n") >= least).cast("int") - (F.col("before") >= least).cast("int"))
        changes = refs.select(self._shard(self.shards).alias("shard"), "key", step(1).alias("seen"), step(self.least_docs).alias("repeated")).where("seen <> 0 or repeated <> 0")
        return self.filters().groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_cochange, FILTERS)

    def _shards_for(self, keys: int) -> int:
        return max(16, -(-keys // self.keys_per_shard))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Count the lines of documents that aren't in the index."""
        folder = self._folder("insert")
        found = line_keys(docs, id_col, text_col, self.least_chars).distinct()
        held = self._write(found.withColumn("sign", F.lit(1)), folder, "holders")
        gained = held.groupBy("key").agg(F.count("*").alias("more"), F.max("doc").alias("doc"))
        if not self.commits:
            refs = self._write(gained.select("key", F.col("more").alias("n"), "doc"), folder, "refs")
            keys = refs.count()
            shards = self._shards_for(keys)
            self._write(self._build_filters(refs, shards), folder, "filters")
            self._commit(folder, "insert0", shards, keys, built=True)
            return
        gained = materialize(gained.withColumn("shard", self._shard(self.shards)), "lines-gained")
        known = self.holders().select("doc").distinct()
        if not held.select("doc").distinct().join(known.withColumnRenamed("doc", "known"), F.col("doc").eqNullSafe(F.col("known")), "left_semi").isEmpty():
            raise ValueError("some of these documents are in the index: delete them first")
        kind = self._kind()
        probed = self.filters().groupBy("shard").cogroup(gained.groupBy("shard")).applyInArrow(_probe, f"key binary, more long, doc {kind}, shard long, maybe boolean")
        probed = materialize(probed, "lines-probed")
        maybe = probed.where("maybe")
        old = self.refs(maybe).select("key", F.col("n").alias("before"), F.col("doc").alias("old"))
        met = maybe.join(old, "key", "left").select("key", (F.coalesce("before", F.lit(0)) + F.col("more")).alias("n"), F.greatest("doc", "old").alias("doc"), F.coalesce("before", F.lit(0)).alias("before"))
        new = probed.where("not maybe").select("key", F.col("more").alias("n"), "doc", F.lit(0).cast("long").alias("before"))
        refs = self._write(met.unionByName(new), folder, "refs")
        self._write(self._change_filters(refs), folder, "filters")
        keys = self.commits[-1]["keys"] + refs.where("before = 0").count()
        self._commit(folder, "insert", self.shards, keys)
        if keys > 2 * max(self.keys_per_shard, self.commits[-1]["built_for"]):
            self.reshard()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out again: (id_col) of each."""
        if not self.commits:
            return
        folder = self._folder("delete")
        gone = ids.select(F.col(id_col).alias("id")).distinct()
        held = self.holders().join(gone, F.col("doc").eqNullSafe(F.col("id")), "left_semi")
        held = self._write(held.withColumn("sign", F.lit(-1)), folder, "holders")
        lost = held.groupBy("key").agg(F.count("*").alias("less"), F.max("doc").alias("lost"))
        old = self.refs(lost)
        now = old.join(lost, "key").select("key", (F.col("n") - F.col("less")).alias("n"), "doc", F.col("n").alias("before"), F.col("doc").eqNullSafe(F.col("lost")).alias("lost"))
        now = materialize(now, "lines-lost")
        # Keys that lost their largest document find the next one among the holders that are left.
        seek = now.where("lost and n > 0").select("key")
        left = self._left(seek, held)
        next_ = left.groupBy("key").agg(F.max("doc").alias("next"))
        refs = now.join(next_, "key", "left").select("key", "n", F.when(F.col("lost"), F.col("next")).otherwise(F.col("doc")).alias("doc"), "before")
        refs = self._write(refs, folder, "refs")
        self._write(self._change_filters(refs), folder, "filters")
        self._commit(folder, "delete", self.shards, self.commits[-1]["keys"] - refs.where("n = 0").count())

    def _left(self, keys: DataFrame, gone: DataFrame) -> DataFrame:
        """The holders of these keys without those that go."""
        signed = self.holders().join(keys, "key", "left_semi").select("key", "doc", F.lit(1).alias("sign")).unionByName(gone.join(keys, "key", "left_semi").select("key", "doc", "sign"))
        return signed.groupBy("key", "doc").agg(F.sum("sign").alias("sign")).where("sign > 0")

    def reshard(self) -> None:
        """Deal the filters out anew, by the number of keys that there are now."""
        folder = self._folder("reshard")
        refs = self.refs()
        keys, kind = refs.count(), self._kind()
        shards = self._shards_for(keys)
        self._write(self._build_filters(refs, shards), folder, "filters")
        self._write(self.spark.createDataFrame([], f"key binary, doc {kind}, sign int"), folder, "holders")
        self._write(self.spark.createDataFrame([], f"key binary, n long, doc {kind}"), folder, "refs")
        self._commit(folder, "reshard", shards, keys, built=True)

    def drops(self, filter_bytes: int = 32 << 20) -> DataFrame:
        """(doc, keys): the lines that each document loses, as at least least_docs documents have them and it isn't the largest."""
        held, kind = self.holders(), self._kind()
        size = self.filters().agg(F.sum(F.length("repeated"))).first()[0] or 0
        if size <= filter_bytes:
            sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["repeated"]) for r in self.filters().select("shard", "repeated").collect()})  # filter_bytes at most

            def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ready: dict[int, Cuckoo] = {}
                for batch in batches:
                    shard, keys = batch.column(2).to_numpy(), digests(batch.column(0).to_pylist())
                    hit = np.zeros(len(shard), bool)
                    order = np.argsort(shard, kind="stable")
                    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                        s = int(shard[at[0]])
                        if s not in ready:
                            ready[s] = Cuckoo.read(sent.value[s])
                        hit[at] = ready[s].has(keys[at])
                    yield batch.select([0, 1]).filter(pa.array(hit))

            held = held.withColumn("shard", self._shard(self.shards)).mapInArrow(hits, f"key binary, doc {kind}")
        repeated = materialize(self.refs().where(F.col("n") >= self.least_docs).select("key", F.col("doc").alias("keeps")), "lines-repeated")
        found = held.join(repeated, "key").where(~F.col("doc").eqNullSafe(F.col("keeps")))
        return materialize(found.groupBy("doc").agg(F.collect_list("key").alias("keys")), "lines-drops")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20) -> DataFrame:
        """docs of the index without their repeated lines (what is left is joined by \\n), with n_lines and n_dropped. Other documents stay as they are."""
        docs = docs.select([c for c in docs.columns if c not in ("n_lines", "n_dropped")])
        least, own = self.least_chars, docs.schema.fields
        at = [f.name for f in own].index(text_col)
        if self.commits:
            drops = self.drops(filter_bytes).select(F.col("doc").alias("_doc"), F.col("keys").alias("_keys"))
            docs = docs.join(drops, F.col(id_col).eqNullSafe(F.col("_doc")), "left").drop("_doc")
        else:
            docs = docs.withColumn("_keys", F.lit(None).cast("array<binary>"))
        names = [*(f.name for f in own), "n_lines", "n_dropped"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                begin = 0
                for part in slices(batch.column(at)):
                    rows = batch.slice(begin, len(part))
                    begin += len(part)
                    lines = pc.add(pc.fill_null(pc.count_substring(part, "\n"), 0), 1).cast(pa.int64())
                    dropped = np.zeros(len(part), np.int64)
                    some = np.flatnonzero(rows.column(len(own)).is_valid())
                    texts = part
                    if len(some):
                        texts = part.to_pylist()
                        for i in some:
                            keys = set(rows.column(len(own))[int(i)].as_py())
                            whole = (texts[i] or "").split("\n")
                            kept = [s for s in whole if len(s) < least or len(s.strip(SPACE_CHARS)) < least or key_of(s) not in keys]
                            dropped[i] = len(whole) - len(kept)
                            texts[i] = "\n".join(kept) if dropped[i] else texts[i]
                        texts = pa.array(texts, part.type)
                    out = [texts if k == at else c for k, c in enumerate(rows.columns[: len(own)])]
                    yield pa.RecordBatch.from_arrays([*out, lines, pa.array(dropped)], names=names)

        schema = StructType([*own, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
        return docs.select(*[f.name for f in own], "_keys").mapInArrow(run, schema)
