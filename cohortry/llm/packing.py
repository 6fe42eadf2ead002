"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, table, written

CHUNKS = re.compile(r"[^ \t\n\r]+")
#: White space by Python's rules, beyond that of CHUNKS.
MORE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII signs but for the apostrophe, which begins endings, and the bracket, which begins special tokens.
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Letters below U+0250 but for U+0130, which lower-cases to a letter and a combining mark: composing and lower-casing leave them letters.
PLAIN = re.compile(r"(?:(?!\u0130)[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F])+")


class IdBytes(dict):
    """Token ids of white-space separated chunks, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its chunks, joined. Of the
    chunks, at most `most` are remembered.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Whether an id ends a word, by id.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for name, k in names.items() if name.endswith("</w>")]] = True

    def __missing__(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Remembers chunks. Words of letters alone are encoded together; if each has one id that ends a word, it is its last.

        Every word has at least one such id, so as many of them as words means one each. Plain letters and the run of
        signs behind them are always apart, so such a chunk is the word's ids and the run's. Any other chunk is encoded
        by itself: composing and lower-casing may leave a mark last, which joins the sign.
        """
        if len(self) + len(chunks) > self.most:
            self.clear()
        words, others, signed, runs = set(), [], [], {}
        for c in chunks:
            if len(c) > 64:
                continue
            if c.isalpha():
                words.add(c)
                continue
            word = c.rstrip(SIGNS)
            if word and len(word) < len(c) and (word.isalpha() if word.isascii() else PLAIN.fullmatch(word)):
                run = c[len(word) :]
                signed.append((c, word, run))
                if run not in runs:
                    runs[run] = self[run]
                if word not in self:
                    words.add(word)
            else:
                others.append(c)
        if words:
            words = list(words)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4
            if len(cut) == len(words):
                data, start = ids.tobytes(), 0
                for word, stop in zip(words, cut.tolist(), strict=True):
                    self[word] = data[start:stop]
                    start = stop
            else:
                others += words
        for chunk in others:
            self[chunk] = self[chunk]
        for chunk, word, run in signed:
            self[chunk] = self[word] + runs[run]

    def of(self, texts: list[str], end_id: int) -> Iterator[bytes]:
        """The ids of each text and end_id."""
        end = end_id.to_bytes(4, "little")
        for at in range(0, len(texts), 64):
            block = [CHUNKS.findall(text) if MORE_SPACE.search(text) else text.split() for text in texts[at : at + 64]]
            found = [list(map(self.get, chunks)) for chunks in block]
            fresh = [[k for k, x in enumerate(ids) if x is None] for ids in found]
            if any(fresh):
                self.learn({chunks[k] for chunks, places in zip(block, fresh, strict=True) for k in places})
            for chunks, ids, places in zip(block, found, fresh, strict=True):
                for k in places:
                    ids[k] = self[chunks[k]]
                yield b"".join(ids) + end


@functools.lru_cache(maxsize=2)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often to take each weight (ascending), each any number of times."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(weights, c, side="right")
        if fit:
            got = best[c - weights[:fit]] + values[:fit]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], chosen[c] = got[k], k
    pattern, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= weights[chosen[c]]
    return float(best[capacity]), pattern


def first_fit_basis(weights: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """As many patterns as weights, and how often each is used, by first fit of falling weights.

    Each pattern uses up one weight, which no later pattern has, so the patterns are a basis.
    """
    left, columns, x = demand.astype(float).copy(), [None] * len(weights), np.zeros(len(weights))
    for _ in weights:
        alive = [k for k in range(len(weights) - 1, -1, -1) if columns[k] is None]
        pattern, room = np.zeros(len(weights), np.int64), capacity
        for k in alive:
            if left[k] > 0 or k == alive[0]:
                pattern[k], room = room // weights[k], room % weights[k]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(ratio.argmin())
        columns[out], x[out] = pattern, ratio[out]
        left = np.maximum(left - x[out] * pattern, 0)
        left[out] = 0
    return columns, x


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. Plain array operations: the driver starts no linear-algebra threads."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = np.flatnonzero(work[:, k])
        others = others[others != k]
        work[others] -= work[others, k, None] * work[k]
    return work[:, n:]


def cutting_patterns(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that together hold exactly demand[k] pieces of weights[k], with few patterns' worth of waste.

    Linear program by the revised simplex method; columns come from the knapsack over its prices, until the bound
    that these prices prove is within gap. The basis is rounded down, and the rest, fewer pieces than the basis
    patterns hold once, is packed first-fit by falling weight.
    """
    m = len(weights)
    if not m:
        return []
    columns, x = first_fit_basis(weights, demand, capacity)
    inverse = inverted(np.array(columns, float).T)
    for turn in range(1, 8 * m + 200):
        value, pattern = knapsack(weights, inverse.sum(axis=0), capacity)
        if value <= 1 + gap:
            break
        step = (inverse * pattern).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = pattern
        if turn % 64:
            row = inverse[out] / step[out]
            inverse -= step[:, None] * row
            inverse[out] = row
        else:  # anew, against drift
            inverse = inverted(np.array(columns, float).T)
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
    left, found = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        uses = columns[k] > 0
        times = int(min(np.floor(x[k] + 1e-6), (left[uses] // columns[k][uses]).min()))
        if times > 0:
            found.append((times, columns[k]))
            left -= times * columns[k]
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            n = min(int(left[k]), room // int(weights[k]))
            pattern[k], room = n, room - n * int(weights[k])
        uses = pattern > 0
        times = int((left[uses] // pattern[uses]).min())
        found.append((times, pattern))
        left -= times * pattern
    return found


def token_pieces(docs: DataFrame, path: str, length: int, end_id: int, key: str, text: str) -> DataFrame:
    """(ident, doc_tokens, crcs): crc32 of each piece of `length` ids, and of the rest."""

    def make():
        ids = id_bytes(path)

        def run(batches):
            for batch in batches:
                n, crcs = [], []
                for data in ids.of([body or "" for body in batch.column(1).to_pylist()], end_id):
                    n.append(len(data) // 4)
                    crcs.append([zlib.crc32(data[at : at + 4 * length]) for at in range(0, len(data), 4 * length)])
                yield batch.column(0), n, crcs

        return run

    return arrow_map(docs.select(F.col(key).cast("long"), text), make, "ident long, doc_tokens long, crcs array<long>")


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = 2048, unit: int = 8, end_id: int = 1, salt_rows: int = 512) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null counts as empty. Pieces of `length` ids fill sequences of their own; the
    rest of each document, rounded up to `unit` ids, is an item of the cutting-stock problem. Its histogram has at
    most length / unit rows, whatever the corpus; so have its patterns, twice over, which are broadcast. Documents are
    ranked within their length class, and the rank names sequence and place. Ranks are counted in groups of about
    salt_rows rows, to which rows, not keys, are dealt, so neither a common length nor a repeated or null key is a hot
    group. Repeated and null keys are separate documents. No rows in, no rows out; other columns are left out.
    """
    spark = docs.sparkSession
    capacity = -(-length // unit)
    pieces = written(token_pieces(docs, path, length, end_id, key, text).withColumn("row", F.monotonically_increasing_id()))
    rest = pieces.withColumn("left", F.col("doc_tokens") % length).filter("left > 0").withColumn("units", F.ceil(F.col("left") / unit).cast("int"))
    histogram = sorted((r.units, r["count"]) for r in rest.groupBy("units").count().collect())
    weights, demand = np.array([k for k, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    patterns = cutting_patterns(weights, demand, capacity)
    base = np.concatenate([[0], np.cumsum([t for t, _ in patterns])]).astype(np.int64)
    plan = {}
    for k, weight in enumerate(weights.tolist()):
        used = [(j, t, int(p[k])) for j, (t, p) in enumerate(patterns) if p[k]]
        plan[weight] = (np.cumsum([0] + [t * n for _, t, n in used])[:-1], np.array([n for *_, n in used]), np.array([base[j] for j, *_ in used]))
    shared = spark.sparkContext.broadcast(plan)
    packed_sequences = int(base[-1])

    salts = F.create_map(*[F.lit(x) for u, n in histogram for x in (u, -(-n // salt_rows))]) if histogram else F.create_map(F.lit(0), F.lit(1))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("row"), F.element_at(salts, F.col("units"))))
    group = Window.partitionBy("units", "salt")
    ranked = salted.withColumn("nth", F.row_number().over(group.orderBy("ident", "doc_tokens", "row")) - 1)
    sizes = salted.groupBy("units", "salt").count()
    below = sizes.select(F.col("units").alias("u"), F.col("salt").alias("s"), (F.sum("count").over(Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("below"))
    ranked = ranked.join(below, (F.col("units") == F.col("u")) & (F.col("salt") == F.col("s")))

    def place():
        plan = shared.value

        def run(batches):
            for batch in batches:
                units, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6))
                sequence = np.zeros(len(units), np.int64)
                for u in np.unique(units):
                    start, per, first = plan[int(u)]
                    mine = units == u
                    j = np.searchsorted(start, rank[mine], side="right") - 1
                    sequence[mine] = first[j] + (rank[mine] - start[j]) // per[j]
                yield *(batch.column(k) for k in range(5)), sequence

        return run

    rows = ranked.select("ident", "doc_tokens", F.col("left").alias("size"), F.element_at("crcs", -1).alias("crc"), "row", "units", (F.col("nth") + F.col("below")).alias("rank"))
    placed = arrow_map(rows, place, "ident long, doc_tokens long, size long, crc long, row long, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "ident", "crc", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("size").over(order) - F.col("size")).withColumn("start", F.col("doc_tokens") - F.col("size"))
    whole = pieces.filter(F.col("doc_tokens") >= length).select("ident", "doc_tokens", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("doc_tokens") / length).cast("int"))).alias("nth", "crc"))
    # One sequence per whole piece: numbered by place in the written table, above the packed sequences.
    whole = whole.select("ident", (F.col("nth").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("size"), "crc", "doc_tokens", (F.monotonically_increasing_id() + packed_sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed.select("ident", "start", "size", "crc", "doc_tokens", "sequence_id", "offset").unionByName(whole)
    return out.select(F.col("ident").alias(key), "start", F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
