"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text, with exception phrases.

Fold: lower case, compatibility forms, look-alike letters of other scripts, digits and signs written for letters.
Lexicon: words and word beginnings of labelled rows, chosen greedily so that each explains toxic rows that at most one
earlier entry does, weighted by smoothed log odds. Exceptions: two-word phrases round an entry that clean rows use.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, crc_mod, table, written

#: Cyrillic and Greek letters by the Latin letter they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
}
#: Digits and signs by the letter they are written for. 1 stands for i and for l, so l is folded to i.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | dict.fromkeys("​‌‍⁠﻿­", ""))
_SIGNS = re.compile(r"[!|$@]+(?!\w)|(?<!\w)[!|$@]+")
_NUMBER = re.compile(r"(?<!\w)[\d.,:%/-]+(?!\w)")
_GAP = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """The words of a text, folded, with one space before and after each. Signs that stand outside words, and numbers, are gaps."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _NUMBER.sub(" ", _SIGNS.sub(" ", text))
    return f" {_GAP.sub(' ', text.translate(_FOLD)).strip()} "


def entries_of(text: str, shortest: int, longest: int) -> set[str]:
    """Lexicon entries that a folded text holds: ' word ' and ' beginning'."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = 0.0
    steps: tuple[tuple[float, float], ...] = ()

    def __post_init__(self):
        self.machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(self.machine):
            self.machine.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, length, weight) of entries in a folded text, by start: the highest weight at each word, none within an exception.

        Exceptions and entries are swept once, so a text takes time in proportion to its matches.
        """
        if not len(self.machine):
            return []
        spared, best = [], {}
        for end, (length, weight) in self.machine.iter(text):
            start = end - length + 1
            if weight == 0.0:
                spared.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (length, weight)
        spared.sort()
        out, k, reach = [], 0, -1  # reach: the end of the exceptions that have begun
        for start in sorted(best):
            while k < len(spared) and spared[k][0] <= start:
                reach = max(reach, spared[k][1])
                k += 1
            length, weight = best[start]
            if start + length - 2 >= reach:
                out.append((start, length, weight))
        return out

    def density(self, text: str) -> float:
        """Summed weights of a folded text over 1 + ln(1 + words): long texts need more, but not in proportion."""
        found = self.matches(text)
        return sum(w for *_, w in found) / (1 + np.log1p(text.count(" ") - 1)) if found else 0.0

    def score(self, text: str | None) -> float:
        """The mean of a logistic curve in the density, which tells all densities apart, and of the step curve, which follows the rows."""
        x = self.density(folded(text))
        p = float(1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -500, 500))))
        return (p + float(np.interp(x, *zip(*self.steps)))) / 2 if self.steps else p


def _greedy(odds: np.ndarray, names: list[str], holders: list[np.ndarray], least: int, times: int = 2) -> list[int]:
    """Entries in the order chosen: each the one of highest odds times toxic rows that hold it and fewer than `times` chosen ones.

    Of equals whole words, then long ones; of nested entries one. An entry that no `least` such rows hold is never chosen.
    """
    held = np.zeros(1 + max((int(h.max()) for h in holders if len(h)), default=0), np.int64)
    order = sorted(range(len(names)), key=lambda k: -odds[k] * len(holders[k]))
    used, chosen = set(), []
    while True:
        best, gain = None, (0.0, False, 0, "")
        for k in order:  # by falling bound of the gain
            if odds[k] * len(holders[k]) < gain[0]:
                break
            if k in used:
                continue
            fresh = int((held[holders[k]] < times).sum())
            if fresh >= least and (now := (float(odds[k] * fresh), names[k].endswith(" "), len(names[k]), names[k])) > gain:
                best, gain = k, now
        if best is None:
            return chosen
        chosen.append(best)
        stem = names[best].rstrip()
        used.update(k for k in range(len(names)) if names[k].startswith(stem) or stem.startswith(names[k].rstrip()))
        held[holders[best]] += 1


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> tuple[float, float]:
    """Slope and bias of a one-feature logistic regression over weighted rows, by damped Newton steps."""
    weight = weight * (len(y) / weight.sum())
    a, b = 0.0, float(np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        r, w = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (r * x).sum() + penalty * a, r.sum() + penalty * b
        haa, hab, hbb = (w * x * x).sum() + penalty, (w * x).sum(), w.sum() + penalty
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a - da / scale, b - db / scale
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.0), b


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], ...]:
    """(x, share) at the ends of the blocks of the rising step curve that fits weighted rows best, shares smoothed by one row.

    Neighbouring blocks are merged while the share falls from one to the next. Between blocks the curve is a line.
    """
    weight = weight * (len(y) / weight.sum())
    points, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []
    for point, n, t in zip(points, np.bincount(at, weight), np.bincount(at, weight * y), strict=True):
        blocks.append([point, point, n, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0], last, blocks[-1][2] + n, blocks[-1][3] + t]
    shares = np.maximum.accumulate([(t + 0.5) / (n + 1) for *_, n, t in blocks])
    return tuple((float(end), float(share)) for (first, last, *_), share in zip(blocks, shares, strict=True) for end in sorted({first, last}))


def learned_lexicon(rows: DataFrame, known: DataFrame, most_rows: int = 12_000, least: int = 2, least_odds: float = 1.5, shortest: int = 3, longest: int = 7) -> Lexicon:
    """A lexicon from rows (ident, text) and their labels (known, toxic 0/1), one for each key.

    Fits on about most_rows rows (documented bound), half of either label or all that there are, by identifier hash;
    the final regression weighs them by how many they stand for. An entry needs `least` toxic rows and smoothed log
    odds of which least_odds are left at 1.64 standard errors below the estimate: the fewer rows, the stronger an entry
    must be, and one rule serves every size. Every entry and exception phrase that the rows support is kept, so the
    model is bounded by the rows it is learned from. Without toxic or without clean rows, the lexicon is empty and scores are the share of toxic rows,
    smoothed.
    """
    spark = rows.sparkSession
    met = F.col("ident") == F.col("known")
    sizes = {r.toxic: r["count"] for r in rows.select("ident").join(known, met).groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon(bias=float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))))
    shares = {k: min(1.0, most_rows / 2 / n) for k, n in sizes.items()}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    # The keys picked are as few as the rows, so they are broadcast and only their texts are read on.
    picks = known.filter(F.abs(F.xxhash64("known") % 1_000_003) / 1_000_003.0 < share)
    picked = written(rows.join(F.broadcast(picks), met).select(F.col("ident").cast("long"), "text", F.col("toxic").cast("int")))
    sizes = {r.toxic: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(bias=float(np.log((n_toxic + 0.5) / (n_clean + 0.5))))

    def count():
        def run(batches):
            toxic, clean = Counter(), Counter()

            def flush():
                keys = list(toxic.keys() | clean.keys())
                out = keys, [toxic[k] for k in keys], [clean[k] for k in keys]
                toxic.clear()
                clean.clear()
                return out

            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    (toxic if label else clean).update(entries_of(folded(text.as_py()), shortest, longest))
                    if len(toxic) + len(clean) > 400_000:
                        yield flush()
            if toxic or clean:
                yield flush()

        return run

    counts = arrow_map(picked.select("text", "toxic"), count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = counts.filter(F.col("toxic") >= least).withColumn("odds", odds).withColumn("sure", F.col("odds") - 1.64 * error).filter(F.col("sure") >= least_odds)
    best = kept.orderBy(F.desc(F.col("sure") * F.col("toxic")), F.desc(F.length("entry")), "entry").select("entry", "odds", "sure").collect()
    names, weights, sure = [r.entry for r in best], [r.odds for r in best], np.array([r.sure for r in best])
    place = spark.sparkContext.broadcast({n: k for k, n in enumerate(names)})

    def hold():
        def run(batches):
            for batch in batches:
                found = [sorted(k for e in entries_of(folded(t.as_py()), shortest, longest) if (k := place.value.get(e)) is not None) for t in batch.column(0)]
                yield (found,)

        return run

    held = arrow_map(picked.filter("toxic = 1").select("text"), hold, "found array<int>").toPandas()
    holders: list[list[int]] = [[] for _ in names]
    for row, found in enumerate(held.found):
        for k in found:
            holders[k].append(row)
    chosen = _greedy(sure, names, [np.array(h, np.int64) for h in holders], least)
    lexicon = Lexicon({names[k]: float(weights[k]) for k in chosen})
    lexicon = Lexicon(lexicon.weights, _exceptions(picked, lexicon))
    seen = picked.select("text", "toxic")
    shared = spark.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def weigh():
        matcher = Lexicon(*shared.value)

        def run(batches):
            for batch in batches:
                yield [matcher.density(folded(t.as_py())) for t in batch.column(0)], batch.column(1)

        return run

    pairs = arrow_map(seen, weigh, "x double, toxic int").toPandas()
    toxic = pairs.toxic.to_numpy(float)
    fit = pairs.x.to_numpy(float), toxic, 1 / np.where(toxic == 1, shares[1], shares[0])
    return Lexicon(lexicon.weights, lexicon.exceptions, *_logistic(*fit), _isotonic(*fit))


def _exceptions(picked: DataFrame, lexicon: Lexicon, least: int = 3) -> tuple[str, ...]:
    """Two-word phrases round a match that at least `least` clean rows use, and ten times as many clean as toxic rows."""
    shared = picked.sparkSession.sparkContext.broadcast(lexicon.weights)

    def make():
        matcher = Lexicon(shared.value)

        def run(batches):
            for batch in batches:
                phrases, labels = [], []
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    line = folded(text.as_py())
                    own = set()
                    for start, *_ in matcher.matches(line):
                        end = line.find(" ", start + 1)
                        before, after = line.rfind(" ", 0, start), line.find(" ", end + 1)
                        if before >= 0 and start > 0:
                            own.add(line[before + 1 : end])
                        if after > 0:
                            own.add(line[start + 1 : after])
                    phrases += own
                    labels += [label] * len(own)
                yield phrases, labels

        return run

    found = arrow_map(picked.select("text", "toxic"), make, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    rows = found.filter((F.col("c") >= least) & (F.col("c") >= 10 * F.col("t"))).orderBy(F.desc("c"), "phrase").collect()
    return tuple(r.phrase for r in rows)


def fitted_lexicon(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 12_000) -> Lexicon:
    """The lexicon of those rows of docs that have labels and whose crc32 of the key, as text, modulo 3 is not 1.

    A document with several labels is toxic if one says so, and null labels count for nothing.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("known")).agg(F.max(F.col(label).cast("int")).alias("toxic")).filter(crc_mod("known", 3) != 1)
    rows = docs.select(F.col(key).alias("ident"), F.col(text).alias("text")).filter(crc_mod("ident", 3) != 1)
    return learned_lexicon(rows, known, most_rows)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, most_rows: int = 12_000) -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The lexicon is that of fitted_lexicon(). Only the text is read for a score. Null and empty texts score as texts
    without a match. Repeated rows score alike; no rows in, no rows out; other columns are left out.
    """
    lexicon = fitted_lexicon(docs, labels, key, text, label, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.slope, lexicon.bias, lexicon.steps))

    def make():
        scorer = Lexicon(*shared.value)

        def run(batches):
            for batch in batches:
                score = np.fromiter((scorer.score(t.as_py()) for t in batch.column(2)), np.float64, batch.num_rows)
                yield batch.column(0), batch.column(1), score, (score >= threshold).astype(np.int32)

        return run

    rows = docs.select(F.col(key).cast("long"), (crc_mod(key, 3) == 1).alias("held_out"), F.col(text))
    return arrow_map(rows, make, f"`{key}` long, held_out boolean, score double, predicted int")


def nontoxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, most_rows: int = 12_000) -> DataFrame:
    """The rows of docs that toxicity() doesn't predict to be toxic, with all columns. Rows don't leave their partition."""
    lexicon, nth = fitted_lexicon(docs, labels, key, text, label, most_rows), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.slope, lexicon.bias, lexicon.steps))

    def make():
        scorer = Lexicon(*shared.value)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(nth)], pa.bool_())).columns

        return run

    return arrow_map(docs, make, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
