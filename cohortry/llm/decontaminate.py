"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark phrases."""

from __future__ import annotations

import functools
import hashlib
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import LOWER, arrow_map, opened, table, written
from cohortry.llm.fm_index import FMIndex

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


class Phrases:
    """Word windows of a block of benchmark items, as numbers of the block's own vocabulary, from 1 on."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1)) if ids else ():
                windows.setdefault(tuple(ids[at : at + width]), set()).add(item)
        self.words = list(vocabulary)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), width), np.int32)
        for k, w in enumerate(windows):
            self.rows[k, : len(w)] = w
        self.owners = [sorted(x) for x in windows.values()]

    def numbered(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """Numbers of the block's words in another vocabulary, 0 for those it lacks, and 0 before them."""
        return np.fromiter((vocabulary.get(w, 0) for w in (b"", *self.words)), np.int64, len(self.words) + 1)


class _Grow(dict):
    """Numbers words as they come, from 1 on."""

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


@functools.lru_cache(maxsize=1)
def _block(path: str) -> Phrases:
    """A block of phrases from the shared folder. A worker keeps the last one, so a benchmark of one block is read once."""
    files, inner = opened(path)
    with files.open_input_file(inner) as f:
        return pickle.loads(pq.read_table(f, columns=["phrases"]).column(0)[0].as_py())


def phrase_blocks(benchmark: DataFrame, item_key: str, item_text: str, width: int, block_bytes: int) -> list[str]:
    """Files of phrases, each of items of about block_bytes of text (or one item); only their names reach the driver.

    A null item key is the empty text. Items are made into phrases on the executors, dealt to blocks by hash.
    """
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")).distinct()
    size = items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "phrases": [pickle.dumps(Phrases(list(zip(pdf.item, pdf.body, strict=True)), width))]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(blocks)))
    return sorted(written(dealt.groupBy("block").applyInPandas(made, "block long, phrases binary"), "block").inputFiles())


def _search(docs: list[np.ndarray], vocabulary: dict[bytes, int], blocks: list[str], sample: int) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each document, given as numbers of vocabulary, its hit spans [start, end) in words, merged, and the items found.

    One index serves all blocks. It covers every run of benchmark words that is as long as the shortest phrase: no
    occurrence can touch another word, so the runs hold all occurrences.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    found: list[set[str]] = [set() for _ in docs]
    known, shortest = np.zeros(len(vocabulary) + 1, bool), 0
    for path in blocks:
        phrases = _block(path)
        known[phrases.numbered(vocabulary)] = True
        shortest = min(shortest or 1 << 30, int(phrases.lengths.min(initial=1 << 30)))
    known[0] = False
    symbol = np.where(known, np.cumsum(known), 0).astype(np.int32)
    flat = symbol[np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))])] if docs else np.zeros(0, np.int32)
    edge = np.diff(np.r_[False, flat != 0, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= shortest
    start, end = start[long], end[long]
    if not len(start):
        return spans, found
    size = end - start + 1  # the 0 behind each run belongs to it
    offset = np.cumsum(size) - size
    origin = np.repeat(start - offset, size) + np.arange(size.sum())
    index = FMIndex(flat[origin], sample)
    begins = np.cumsum([0] + [len(d) + 1 for d in docs])
    hits = []
    for path in blocks:
        phrases = _block(path)
        rows = symbol[phrases.numbered(vocabulary)][phrases.rows]
        whole = np.flatnonzero((rows > 0).sum(axis=1) == phrases.lengths)
        lo, hi = index.ranges(rows[whole], phrases.lengths[whole])
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        many = (hi - lo)[hit]
        window = np.repeat(whole[hit], many)
        at = origin[index.locate(np.repeat(lo[hit] - np.cumsum(many) + many, many) + np.arange(many.sum()))]
        doc = np.searchsorted(begins, at, side="right") - 1
        hits.append((doc, at, at + phrases.lengths[window]))
        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            found[d].update(phrases.owners[w])
    if hits:
        doc, at, end = (np.concatenate(x) for x in zip(*hits, strict=True))
        by = np.lexsort((at, doc))
        doc, at, end = doc[by], at[by], end[by]
        reach = np.maximum.accumulate(end)  # places grow from document to document, with a gap between
        first = np.flatnonzero(np.r_[True, at[1:] > reach[:-1]])
        for d, x, y in zip(doc[first].tolist(), at[first].tolist(), reach[np.r_[first[1:], len(at)] - 1].tolist(), strict=True):
            spans[d].append((x - int(begins[d]), y - int(begins[d])))
    return spans, found


def _judged(batches, nth: int, blocks: list[str], shard_words: int, sample: int):
    """(batch slice, words, spans, items) over shards of about shard_words words; nth: the text's column."""
    slices, docs, vocabulary, held = [], [], _Grow(), 0

    def shard():
        spans, found = _search(docs, vocabulary, blocks, sample)
        at = 0
        for part in slices:
            cut = slice(at, at + part.num_rows)
            at += part.num_rows
            yield part, [len(d) for d in docs[cut]], spans[cut], found[cut]

    for batch in batches:
        begin = 0
        for k, body in enumerate(batch.column(nth)):
            words = words_of(body.as_py())
            docs.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held >= shard_words:
                slices.append(batch.slice(begin, k + 1 - begin))
                begin = k + 1
                yield from shard()
                slices, docs, vocabulary, held = [], [], _Grow(), 0
        if begin < batch.num_rows:
            slices.append(batch.slice(begin))
    if slices:
        yield from shard()


def _is_contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    n_hit = sum(y - x for x, y in spans)
    return n_hit > 0 and 20 * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 13, shard_words: int = 1 << 20, sample: int = 8, block_bytes: int = 1 << 20) -> DataFrame:
    """Every row of docs with its words that lie in occurrences of benchmark windows.

    Columns: key, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word spans to remove).
    A window is width consecutive words of an item; an item of fewer words is one window; an item or text that is
    null or has no words has none. Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Items of one key are one item; a
    null item key is the empty text.
    The benchmark is cut into blocks of about block_bytes of text, which tasks read one at a time from the shared
    folder; each shard of documents is indexed once and searched for all blocks, so every row is judged by itself,
    repeated keys too, and the result is the same for any block size. An empty benchmark hits nothing; empty docs give
    no rows; other columns are left out.
    """
    blocks = phrase_blocks(benchmark, item_key, item_text, width, block_bytes)

    def make():
        def run(batches):
            for part, n_words, spans, found in _judged(batches, 1, blocks, shard_words, sample):
                names = [sorted(x) for x in found]
                yield (
                    part.column(0),
                    n_words,
                    [sum(y - x for x, y in s) for s in spans],
                    [len(x) for x in names],
                    [hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in names],
                    [_is_contaminated(n, s) for n, s in zip(n_words, spans, strict=True)],
                    [[{"start": x, "end": y} for x, y in s] for s in spans],
                )

        return run

    schema = f"`{key}` long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return arrow_map(docs.select(F.col(key).cast("long"), F.col(text)), make, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 13, shard_words: int = 1 << 20, sample: int = 8, block_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs that contamination() doesn't call contaminated, with all columns. Rows don't leave their partition."""
    blocks, nth = phrase_blocks(benchmark, item_key, item_text, width, block_bytes), docs.columns.index(text)

    def make():
        def run(batches):
            for part, n_words, spans, _ in _judged(batches, nth, blocks, shard_words, sample):
                yield part.filter(pa.array([not _is_contaminated(n, s) for n, s in zip(n_words, spans, strict=True)], pa.bool_())).columns

        return run

    return arrow_map(docs, make, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def brute_force(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    """The contract read literally, for tests."""
    out = []
    sets = {}
    for ident, text in items:
        w = words_of(text)
        for at in range(max(1, len(w) - width + 1)) if w else ():
            sets.setdefault(tuple(w[at : at + width]), set()).add("" if ident is None else str(ident))
    sizes = {len(x) for x in sets}
    for ident, text in docs:
        w = words_of(text)
        hit, names = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if owners := sets.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    names |= owners
        joined = ",".join(sorted(names))
        out.append((ident, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ORACLE = {
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, size, place, array_to_string(w[place:place + size - 1], ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM d, (SELECT DISTINCT size FROM g))),
h AS (SELECT doc_id, item_id, place, size FROM p JOIN g USING (size, phrase)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(place, place + size)) AS word FROM h) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)"""
}
