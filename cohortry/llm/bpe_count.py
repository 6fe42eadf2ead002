"""Exact token counts of byte-level pair merging, without making the tokens."""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, table

#: White space as the tokenizer's pattern means it: the Unicode property, without the separators \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Stretches that no pre-token crosses: cheap to find and, being mostly words, mostly seen before.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _byte_letters() -> list[str]:
    """The printable letter by which the vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of a vocabulary file with ranked merges."""

    def __init__(self, path: str, cached: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.byte_symbol = [vocabulary[x] for x in _byte_letters()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a] << 20 | vocabulary[b]] = (rank, vocabulary[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pretokens = regex.compile(pattern).findall
        self.pieces = _Cache(lambda piece: self.merged(piece.encode("utf-8", "surrogatepass")), cached)
        self.chunks = _Cache(lambda chunk: sum(map(self.pieces.__getitem__, self.pretokens(chunk))), cached)

    def merged(self, piece: bytes) -> int:
        """Symbols left of one pre-token when no adjacent pair can be merged: lowest rank first, leftmost of equals."""
        symbols = [self.byte_symbol[b] for b in piece]
        n, get = len(symbols), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], k, symbols[k], symbols[k + 1], m[1]) for k in range(n - 1) if (m := get(symbols[k] << 20 | symbols[k + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, at, a, b, new = heapq.heappop(heap)
            right = after[at]
            if symbols[at] != a or right >= n or symbols[right] != b:
                continue  # one of the two has been merged since
            symbols[at], symbols[right] = new, -1
            left -= 1
            after[at] = following = after[right]
            if following < n:
                before[following] = at
                if m := get(new << 20 | symbols[following]):
                    heapq.heappush(heap, (m[0], at, new, symbols[following], m[1]))
            if (previous := before[at]) >= 0 and (m := get(symbols[previous] << 20 | new)):
                heapq.heappush(heap, (m[0], previous, symbols[previous], new, m[1]))
        return left

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.chunks.__getitem__, CHUNK.findall(part))) for part in parts)


class _Cache(dict):
    """Counts by string; short strings are kept until `most` of them are, and then anew."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        n = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a byte-level vocabulary file, readable on every executor. Special strings inside a text count as one token,
    as the library's default has it. Null counts as empty: 0 bytes, 0 tokens. Repeated rows and keys are counted
    row by row; no rows in, no rows out; other columns are left out. No shuffle; any length of text.
    """

    def make():
        counted = counter(path)

        def run(batches):
            for batch in batches:
                tokens = np.fromiter((counted.count(t.as_py() or "") for t in batch.column(1)), np.int64, batch.num_rows)
                yield batch.column(0), batch.column(2), tokens, tokens > limit

        return run

    rows = docs.select(F.col(key).cast("long"), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return arrow_map(rows, make, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
