"""Problem 4: duplicates hidden by formatting.

Method: an incremental ledger. Canonical-key counts are kept in buckets; each new batch is aggregated, full-outer-joined
against the matching buckets only, counts are added and the earliest representative is retained.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import new_path

#: A part whose opener many prompts have before a colon is labelled also where formatting took the colon away. An opener
#: counts from this share of the prompts, so there are at most a few hundred.
LABEL_SHARE, LABEL_LEAST = 0.02, 3
_BREAKS = r"[\n\r|\u2028\u0085]+"


def learn_labels(prompts: DataFrame, column: str = "prompt") -> tuple[str, ...]:
    """The openers (up to three words before a colon, at the start of a part) that many prompts have, in lower case."""
    parts = prompts.select(F.explode(F.split(F.lower(F.upper(F.col(column))), _BREAKS)).alias("p"))
    found = parts.select(F.regexp_extract("p", r"^[^\p{L}\p{N}]*(\p{L}+(?: \p{L}+){0,2})\s*:", 1).alias("l")).where("l <> ''").groupBy("l").agg(F.count("*").alias("n"))
    least = max(LABEL_LEAST, LABEL_SHARE * prompts.count())
    return tuple(r.l for r in found.where(F.col("n") >= least).orderBy("l").collect())  # at most 1 / LABEL_SHARE for each place in a prompt


def labelled_pattern(labels: tuple[str, ...]) -> str:
    """What a labelled part begins with: a known opener, or anything before a colon without the end of a sentence."""
    known = "|".join(sorted(labels, key=lambda t: (-len(t), t)))
    return (rf"^[^\p{{L}}\p{{N}}]*(?:{known})(?![\p{{L}}\p{{N}}])|" if labels else "") + r"^[^:.!?]+:"


def closed_pattern(labels: tuple[str, ...]) -> str:
    """What the last part begins with if it is a labelled one too: a known opener and its colon."""
    known = "|".join(sorted(labels, key=lambda t: (-len(t), t)))
    return rf"^[^\p{{L}}\p{{N}}]*(?:{known})\s*:" if labels else r"(?!)"


def letters_digits(c: Column) -> Column:
    """The letters and digits in sequence, case folded (upper, then lower, so that ß and SS agree); null gives ''. Marks
    that combine with a letter are neither: texts that differ in them only are the same here, as the problem has it."""
    return F.coalesce(F.regexp_replace(F.lower(F.upper(c.cast("string"))), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def canonical_prompt(c: Column, labels: tuple[str, ...] = ()) -> Column:
    """Labelled opening parts (one per line, or separated by "|") in sorted order, then the rest, each as its letters
    and digits. A part counts as labelled while every part before it does and it begins as labelled_pattern says; the last
    part only if it begins with a known label and a colon (else it is the rest, whatever it begins with)."""
    parts = F.filter(F.split(F.lower(F.upper(F.coalesce(c.cast("string"), F.lit("")))), _BREAKS), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    bare = lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]+", "")
    none = F.size(parts) < 2
    first_other = F.array_position(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(labelled_pattern(labels))), F.lit(False))
    whole = F.element_at(parts, -1).rlike(closed_pattern(labels))
    n = F.when(none, F.lit(0)).when(first_other > 0, first_other.cast("int") - 1).when(whole, F.size(parts)).otherwise(F.size(parts) - 1)
    head = F.array_sort(F.transform(F.slice(parts, F.lit(1), n), bare))
    body = F.transform(F.slice(parts, n + 1, F.size(parts)), bare)
    return F.concat(F.array_join(head, "|"), F.lit("||"), F.array_join(body, ""))


def canonical_key(prompt: Column, summary: Column, payload_type: Column, labels: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical record: two records have one key if they differ in formatting only."""
    return F.sha2(F.concat_ws("\n", canonical_prompt(prompt, labels), letters_digits(summary), letters_digits(payload_type)), 256)


class Ledger:
    """Counts of canonical keys in a folder, in ``buckets`` buckets of the key.

    A bucket lives in the generation that wrote it last; the manifest names it for each bucket (as many entries as
    buckets). A batch rewrites only the buckets it has keys in. Manifests are numbered and never changed: a new one is
    written beside the others and appears under its number by one rename, so a job that dies leaves the ledger as it was
    and may be run again, and of two jobs at once one fails. A batch id is applied once. Generations that neither the
    newest manifest nor the one before it names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "ledger"), buckets

    SCHEMA = "key string, copies long, keep_id string, first_ord long, first_id string, bucket int"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        """Number of the newest manifest; 0 for none."""
        path, fs = self._fs()
        found = fs.globStatus(path(f"{self.path}/manifest-*.json"))
        return max((int(f.getPath().getName()[9:-5]) for f in found or []), default=0)

    def manifest(self) -> dict:
        path, fs = self._fs()
        newest = self._newest()
        if not newest:
            return {"version": 0, "batches": [], "buckets": {}}
        f = fs.open(path(f"{self.path}/manifest-{newest:08d}.json"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _publish(self, manifest: dict) -> None:
        path, fs = self._fs()
        fs.mkdirs(path(self.path))
        new = path(f"{self.path}/new-{uuid.uuid4().hex}")
        f = fs.create(new, False)
        f.write(bytearray(json.dumps(manifest).encode()))
        f.close()
        name = path(f"{self.path}/manifest-{manifest['version']:08d}.json")
        if fs.exists(name) or not fs.rename(new, name):
            fs.delete(new, False)
            raise RuntimeError("another batch was applied meanwhile: apply this one again")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """key, copies, keep_id (least id), first_ord and first_id (earliest representative), bucket."""
        at: dict[str, list[int]] = {}
        for b, gen in self.manifest()["buckets"].items():
            if buckets is None or int(b) in buckets:
                at.setdefault(gen, []).append(int(b))
        out = self.spark.createDataFrame([], self.SCHEMA)
        for gen, bs in at.items():
            out = out.unionByName(self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{gen}").where(F.col("bucket").isin(bs)))
        return out

    def apply(self, batch: DataFrame, batch_id: str) -> None:
        """Add a batch of (key, id, ord): aggregate it, full-outer-join the buckets it touches, write them anew."""
        manifest = self.manifest()
        if batch_id in manifest["batches"]:
            return
        first = F.min(F.struct(F.coalesce("ord", F.lit(2**63 - 1)).alias("ord"), "id"))
        new = batch.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("keep_id"), first.alias("f"))
        new = new.select("key", "copies", "keep_id", F.col("f.ord").alias("first_ord"), F.col("f.id").alias("first_id"))
        new = new.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        gen = f"gen-{manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        staged = None
        if manifest["buckets"]:
            staged = f"{self.path}/batch-{uuid.uuid4().hex}"
            new.write.parquet(staged)
            new = self.spark.read.schema(self.SCHEMA).parquet(staged)
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most self.buckets rows
        else:
            touched = list(range(self.buckets))
        old = self.read(touched)
        o, n = old.alias("o"), new.alias("n")
        earliest = F.least(F.struct(F.col("o.first_ord").alias("ord"), F.col("o.first_id").alias("id")), F.struct(F.col("n.first_ord").alias("ord"), F.col("n.first_id").alias("id")))
        pick = F.when(F.col("o.key").isNull(), F.struct(F.col("n.first_ord").alias("ord"), F.col("n.first_id").alias("id"))).when(F.col("n.key").isNull(), F.struct(F.col("o.first_ord").alias("ord"), F.col("o.first_id").alias("id"))).otherwise(earliest)
        merged = o.join(n, (F.col("o.key") == F.col("n.key")) & (F.col("o.bucket") == F.col("n.bucket")), "full_outer").select(
            F.coalesce("o.key", "n.key").alias("key"),
            (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
            F.least("o.keep_id", "n.keep_id").alias("keep_id"),
            pick.alias("f"),
            F.coalesce("o.bucket", "n.bucket").alias("bucket"),
        )
        merged = merged.select("key", "copies", "keep_id", F.col("f.ord").alias("first_ord"), F.col("f.id").alias("first_id"), "bucket")
        # Clustered first, so that each bucket is written by one task, not a piece of it by every task.
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{gen}")
        before = set(manifest["buckets"].values())
        buckets = manifest["buckets"] | {str(b): gen for b in touched}
        self._publish({"version": manifest["version"] + 1, "batches": [*manifest["batches"], batch_id], "buckets": buckets, "before": sorted(before)})
        path, fs = self._fs()
        for old in {*manifest.get("before", []), *([staged.rsplit("/", 1)[1]] if staged else [])} - before - set(buckets.values()):
            fs.delete(path(f"{self.path}/{old}"), True)


def keyed(records: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(key, id, ord) of every record with an id; extra columns are ignored. labels: known labels of prompts; those that
    the records themselves show, if not given. (Batches of one ledger need the same.)"""
    labels = learn_labels(records) if labels is None else labels
    return records.where("id is not null").select(canonical_key(F.col("prompt"), F.col("summary"), F.col("payload_type"), labels).alias("key"), F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"))
