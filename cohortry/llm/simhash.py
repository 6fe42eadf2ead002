"""SimHash near-duplicates found by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import FILE, LOWER, ROW, all_but_first, arrow_map, table, with_row_keys, without_rows, written
from cohortry.llm.graph import components


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    last = max(0, len(words) - width)
    end = (start + size)[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start[: last + 1].tolist(), end, strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ident, fp) and the long columns carry: fp is the fingerprint as a signed long."""

    def make():
        def run(batches):
            for batch in batches:
                fps = np.fromiter((fingerprint_of(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
                yield batch.column(0), fps.view(np.int64), *batch.columns[2:]

        return run

    return arrow_map(docs.select(F.col(key).cast("long"), text, *carry), make, ", ".join(f"`{c}` long" for c in ("ident", "fp", *carry)))


def _variants(fps: DataFrame, segments: int) -> DataFrame:
    """(slot, fp, side): the fingerprint's segments, each as it is and with one bit deleted, slot holding which.

    side: the deleted bit's value; 2 where none is deleted.
    """
    bits = 64 // segments
    mask = (1 << bits) - 1
    one = []
    for s in range(segments):
        value = F.shiftrightunsigned("fp", bits * s).bitwiseAND(F.lit(mask))
        head = F.lit((s * (bits + 1) + bits) << bits)
        one.append(F.array(F.struct(head.bitwiseOR(value).alias("slot"), F.lit(2).cast("byte").alias("side"))))
        one += [
            F.array(F.struct(F.lit((s * (bits + 1) + i) << bits).bitwiseOR(value.bitwiseAND(F.lit(mask & ~(1 << i)))).alias("slot"), F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1)).cast("byte").alias("side")))
            for i in range(bits)
        ]
    return fps.select("fp", F.explode(F.concat(*one)).alias("v")).select("fp", "v.slot", "v.side")


def links(fps: DataFrame, most: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most `most` bits, from distinct fps.

    With `segments` segments and fewer than 2 * segments differing bits, one segment differs in one bit at most. Two
    fingerprints equal there meet at that segment as it is; differing by one bit they meet where it is deleted, one
    from either side. Each meeting is verified over all 64 bits within the join, so unverified pairs are never rows.
    Spark takes the slots to be as large as their fingerprints, so it is told not to broadcast them.
    """
    if most >= 2 * segments or 64 % segments:
        raise ValueError("segments must divide 64, and be more than half of the differing bits")
    slots = _variants(fps, segments)
    left = slots.filter("side != 1").select(F.col("slot").alias("ls"), F.col("fp").alias("a"), "side")
    right = slots.filter("side != 0").select(F.col("slot").alias("rs"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return left.join(right.hint("merge"), (F.col("ls") == F.col("rs")) & near & ((F.col("side") == 0) | (F.col("a") < F.col("b")))).select("a", "b")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, segments: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: ident, fp, component_id (smallest key reachable), root (a fingerprint that names the component), carry.

    Links are sought between distinct fingerprints, so copies cost one row.
    """
    rows = written(fingerprints(docs, key, text, width, carry))
    nodes = written(rows.groupBy("fp").agg(F.min("ident").alias("least")))
    roots = components(links(nodes.select("fp"), most, segments))
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    low = linked.groupBy("root").agg(F.min("least").alias("low"))
    low = low.select((F.col("root") + F.lit(0)).alias("low_root"), "low")
    better = linked.join(low, F.col("root") == F.col("low_root")).select(F.col("fp").alias("better_fp"), "low", "root")
    named = written(nodes.join(better, F.col("fp") == F.col("better_fp"), "left").select(F.col("fp").alias("named_fp"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return rows.join(named, F.col("fp") == F.col("named_fp")).drop("named_fp")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, segments: int = 2) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (smallest key reachable by links).

    Null and empty texts have fingerprint zero and link like any other. A null key never is a component's smallest,
    unless all are null. Repeated rows share a component. No rows in, no rows out; other columns are left out.
    """
    return simhash_groups(docs, key, text, width, most, segments).select(F.col("ident").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, segments: int = 2) -> DataFrame:
    """docs with one row of every component of near duplicates: that of the smallest key, the first in its file of several."""
    keyed = with_row_keys(docs)
    groups = simhash_groups(keyed, key, text, width, most, segments, (FILE, ROW))
    return without_rows(keyed, all_but_first(groups, ["root"], "ident"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
