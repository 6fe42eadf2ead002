"""Exact duplicate removal with a log-structured merge index over text digests.

Every task holds a memtable (digest -> smallest identifier, count). A full memtable is flushed as a run of
digest-sorted segments, one per digest range. Compaction merges the segments of a range, keeps the smallest
identifier of each digest and gives every range a slice of a Bloom filter over the digests that repeat. Texts probe
the filter; only possible repeats travel, join the compacted index and are compared byte by byte with the text kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import FILE, ROW, all_but_first, arrow_map, table, with_row_keys, without_rows, written

DIGEST = 32
PROBES = 5


def normalised(column: str):
    """Each run of [\\x20\\x09-\\x0D] as one space; null as empty. Lone spaces need no change, so they aren't matched."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")


def _ranges_of(digests: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each digest by its first four bytes; ranges is a power of two."""
    return digests[:, :4].copy().view(">u4").ravel().astype(np.int64) * ranges >> 32


def _bits_of(digests: np.ndarray, slice_bits: int) -> np.ndarray:
    """PROBES positions of each digest in its range's filter slice."""
    words = digests[:, 4:24].copy().view("<u4").reshape(len(digests), PROBES)
    return words.astype(np.int64) % slice_bits


def flush_runs(digests: DataFrame, ranges: int, memtable_rows: int = 200_000) -> DataFrame:
    """Level 0: sorted segments (bucket, digests, ids, counts) of bounded memtables."""

    def make():
        def run(batches):
            memtable: dict[bytes, list] = {}

            def flush():
                keys = sorted(memtable)
                arr = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, DIGEST)
                bucket = _ranges_of(arr, ranges)
                ids = np.array([memtable[k][0] for k in keys], np.int64)
                counts = np.array([memtable[k][1] for k in keys], np.int64)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = ([], [], [], [])
                for lo, hi in zip(at, [*at[1:], len(keys)], strict=True):
                    for column, x in zip(out, (int(bucket[lo]), arr[lo:hi].tobytes(), ids[lo:hi].tobytes(), counts[lo:hi].tobytes()), strict=True):
                        column.append(x)
                memtable.clear()
                return out

            for batch in batches:
                for digest, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ident = NO_ID if ident is None else ident
                    if (seen := memtable.get(digest)) is None:
                        memtable[digest] = [ident, 1]
                        if len(memtable) >= memtable_rows:
                            yield flush()
                    else:
                        seen[0] = min(seen[0], ident)
                        seen[1] += 1
            if memtable:
                yield flush()

        return run

    return arrow_map(digests.select("digest", "ident"), make, "bucket int, digests binary, ids binary, counts binary")


#: Stands for a null identifier, above every other.
NO_ID = np.iinfo(np.int64).max


def compact(runs: DataFrame) -> DataFrame:
    """Level 1: one row per range with the repeated digests, their smallest identifiers and counts."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf.digests), np.uint8).reshape(-1, DIGEST)
        ids, counts = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("ids", "counts"))
        order = np.lexsort(raw.view(">u8").T[::-1])
        raw, ids, counts = raw[order], ids[order], counts[order]
        first = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]).any(axis=1)])
        ids, counts, raw = np.minimum.reduceat(ids, first), np.add.reduceat(counts, first), raw[first]
        again = counts > 1
        return pd.DataFrame({"bucket": [int(pdf.bucket.iloc[0])], "digests": [raw[again].tobytes()], "ids": [ids[again].tobytes()], "counts": [counts[again].tobytes()]})

    return runs.groupBy("bucket").applyInPandas(merge, "bucket int, digests binary, ids binary, counts binary")


def filter_slices(level: DataFrame, slices: int, ranges: int, slice_bits: int) -> DataFrame:
    """The Bloom filter's slices (slice, filter), each over the digests of neighbouring ranges."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(slice_bits, np.uint8)
        for digests in pdf.digests:
            bits[_bits_of(np.frombuffer(digests, np.uint8).reshape(-1, DIGEST), slice_bits).ravel()] = 1
        return pd.DataFrame({"slice": [int(pdf.bucket.iloc[0]) * slices // ranges], "filter": [np.packbits(bits).tobytes()]})

    nth = F.floor(F.col("bucket").cast("long") * slices / ranges)
    return level.select("bucket", "digests").groupBy(nth.alias("nth")).applyInPandas(fill, "slice int, filter binary")


def _entries(level: DataFrame) -> DataFrame:
    def make():
        def run(batches):
            for batch in batches:
                for digests, ids, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if digests:
                        yield [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)], np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)

        return run

    return arrow_map(level.select("digests", "ids", "counts"), make, "digest binary, keep long, n long")


def sha256(text: Column) -> Column:
    """A text's digest of DIGEST bytes."""
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


@dataclass(frozen=True)
class Repeats:
    """What tasks need to tell rows whose digest is alone: a Bloom filter over repeated digests, and the hot ones among these."""

    bits: bytes
    slices: int
    slice_bits: int
    hot: frozenset[bytes]
    salts: int

    def probe(self, digests: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Whether each digest may be repeated, and a salt for its row, which is 0 but for hot digests."""
        flat, filled = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST), np.frombuffer(self.bits, np.uint8)
        at = (_ranges_of(flat, self.slices) * (-(-self.slice_bits // 8) * 8))[:, None] + _bits_of(flat, self.slice_bits)
        return ((filled[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1), [k % self.salts if d in self.hot else 0 for k, d in enumerate(digests)]

    def every_salt(self, digest: str) -> Column:
        """All salts that rows of a digest have, as an array."""
        none = F.array(F.lit(0))
        return F.when(F.col(digest).isin(*map(bytearray, self.hot)), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(none) if self.hot else none


def repeated_digests(digests: DataFrame, range_rows: int = 4096, memtable_rows: int = 200_000, filter_bits: int = 1 << 28, most_slices: int = 4096, hot_share: int = 256, salts: int = 64) -> tuple[DataFrame, Repeats]:
    """The compacted index of the repeated ones of (digest, ident): (digest, keep, n), written, with the smallest identifiers; and its filter.

    The filter has 16 bits a repeated digest, at most filter_bits bits (32 MB) in most_slices slices, whatever the number
    of digests and however many ranges the index has. Hot digests are those that one in hot_share rows has, so there
    are hot_share at most.
    """
    digests = written(digests)
    total = digests.count()
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, total / range_rows)))))
    level = written(compact(flush_runs(digests, ranges, memtable_rows)))
    entries = written(_entries(level))
    repeated, slices = entries.count(), min(ranges, most_slices)
    slice_bits = max(64, min(filter_bits, 1 << int(np.ceil(np.log2(16 * max(1, repeated))))) // slices)
    bits = bytearray(-(-slice_bits // 8) * slices)
    for bucket, part in ((r["slice"], r["filter"]) for r in filter_slices(level, slices, ranges, slice_bits).collect()):
        bits[bucket * len(part) : (bucket + 1) * len(part)] = part
    hot = entries.filter(F.col("n") * hot_share >= max(total, hot_share)).filter(F.col("n") > salts).select("digest").collect()
    return entries, Repeats(bytes(bits), slices, slice_bits, frozenset(bytes(r.digest) for r in hot), salts)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = 4096, memtable_rows: int = 200_000, filter_bits: int = 1 << 28, most_slices: int = 4096, hot_share: int = 256, salts: int = 64, digest: Callable[[Column], Column] = sha256, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256 (hex of the digest), and the long columns carry.

    Texts are equal when identical after each white-space run becomes one space; null counts as empty. The smallest
    key of equal texts stays. A null key is above all others. Rows that repeat the smallest key are all kept.
    Index and filter are those of repeated_digests(); when the filter fills up, more rows are joined and none is lost.
    Rows of hot digests are dealt over salts when their texts are compared. No rows in, no rows out; other columns of
    docs are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("ident"), normalised(text).alias("body"), *carry).withColumn("digest", digest(F.col("body")))
    entries, repeats = repeated_digests(rows.select("digest", "ident"), range_rows, memtable_rows, filter_bits, most_slices, hot_share, salts)
    shared = spark.sparkContext.broadcast(repeats)

    def probe():
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    maybe, salt = shared.value.probe(batch.column(1).to_pylist())
                    body = pa.compute.if_else(pa.array(maybe), batch.column(2), pa.scalar(None, batch.column(2).type))
                    yield batch.column(0), batch.column(1), pa.array(maybe), body, salt, *batch.columns[3:]

        return run

    carried = "".join(f", `{c}` long" for c in carry)
    probed = written(arrow_map(rows.select("ident", "digest", "body", *carry), probe, f"ident long, digest binary, maybe boolean, body string, salt int{carried}"))
    alone = probed.filter(~F.col("maybe")).select("ident", "digest", F.col("ident").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carry)
    maybe = probed.filter("maybe").select("ident", "digest", "body", "salt", *carry)
    keeper = maybe.join(entries.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.coalesce("ident", F.lit(int(NO_ID))) == F.col("keep")))
    keeper = keeper.groupBy("d").agg(F.min("ident").alias("keep"), F.max("n").alias("n"), F.max("body").alias("kept_body"))
    keeper = keeper.select(F.concat(F.lit(b""), "d").alias("d2"), "keep", "n", "kept_body", F.explode(repeats.every_salt("d")).alias("s2"))
    hits = maybe.join(keeper, (F.col("digest") == F.col("d2")) & (F.col("salt") == F.col("s2")), "left")
    same = F.col("d2").isNull() | (F.col("body") == F.col("kept_body"))
    keep_id, size = F.when(F.col("d2").isNull(), F.col("ident")).otherwise(F.col("keep")), F.coalesce("n", F.lit(1)).cast("long")
    # Texts are only kept where they differ from the text that their digest stands for.
    hits = written(hits.select("ident", "digest", keep_id.alias("keep_id"), size.alias("group_size"), same.alias("same"), F.when(~same, F.col("body")).alias("other"), *carry))
    good = hits.filter("same")
    if hits.filter(~F.col("same")).limit(1).count():
        # Equal digests of unequal texts: grouped anew by the texts themselves.
        clash = hits.filter(~F.col("same")).groupBy("digest", "other").agg(F.min("ident").alias("k"), F.count("*").alias("c"))
        clash = written(clash.select(F.col("digest").alias("cd"), F.col("other").alias("cb"), "k", "c"))
        lost = clash.groupBy("cd").agg(F.sum("c").alias("lost")).select(F.concat(F.lit(b""), "cd").alias("ld"), "lost")
        good = good.join(lost, F.col("digest") == F.col("ld"), "left").withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
        split = hits.filter(~F.col("same")).join(clash, (F.col("digest") == F.col("cd")) & (F.col("other") == F.col("cb")))
        alone = alone.unionByName(split.select("ident", "digest", F.col("k").alias("keep_id"), F.col("c").alias("group_size"), *carry))
    out = alone.unionByName(good.select("ident", "digest", "keep_id", "group_size", *carry))
    return out.select(F.col("ident").alias(key), "keep_id", "group_size", F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *carry)


def first_of_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of all that have equal texts: that of the smallest key, the first in its file of several."""
    keyed = with_row_keys(docs)
    groups = written(exact_duplicates(keyed, key, text, carry=(FILE, ROW)).filter("group_size > 1"))
    return without_rows(keyed, all_but_first(groups, ["text_sha256", "keep_id"], key))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
