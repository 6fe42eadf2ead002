"""Log-likelihood of whole documents under a gated recurrent model and under corpus word counts."""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import LOWER, arrow_map, crc_mod, table, written
from cohortry.llm.gated_lm import END, RARE, GatedLM, score_documents, train_documents


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_counts(docs: DataFrame, most_held: int = 300_000) -> DataFrame:
    """(word, n) over all texts of the column text. Tasks count before they shuffle, at most most_held words at once."""

    def make():
        def run(batches):
            held: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    held.update(words_of(text.as_py()))
                    if len(held) >= most_held:
                        yield list(held), list(held.values())
                        held.clear()
            if held:
                yield list(held), list(held.values())

        return run

    return arrow_map(docs.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, by falling count: those above a count that at most `most` words exceed.

    The count is chosen from a histogram over eighths of octaves, a few hundred rows whatever the corpus, so only the
    words returned reach the driver. Words of one bin are taken together or not at all.
    """
    octave = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(((r.b, r["count"], r.low) for r in counts.groupBy(octave.alias("b")).agg(F.count("*").alias("count"), F.min("n").alias("low")).collect()), reverse=True)
    total, cut = 0, None
    for _, n, low in bins:
        total += n
        if total > most:
            break
        cut = low
    if cut is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in counts.filter(F.col("n") >= cut).collect()), key=lambda x: (-x[1], x[0]))


def trained_model(train: DataFrame, counts: np.ndarray, shards: int, rounds: int, block_words: int, hidden: int, rate: float) -> bytes:
    """Weights after `rounds` of training over rows (shard, nth, numbers as bytes), each round over its own part of the rows.

    In each round every shard trains a copy of the weights, block by block, with truncated backpropagation; copies are
    averaged by words seen. A row's shard, round and place come from its key and words alone, and averages are summed
    in a fixed order, so the weights are the same for any partitioning. Sums are made in groups of about the root of
    the number of shards first and those then; the driver gets one row.
    """
    spark, group = train.sparkSession, max(1, math.isqrt(shards))
    weights = GatedLM(counts, hidden).packed()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def make(shared=shared):
            def run(batches):
                model = memory = own = None
                docs, held, seen = [], 0, 0

                def learn():
                    train_documents(model, docs, memory, rate=rate)
                    docs.clear()

                for batch in batches:
                    for shard, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        if shard != own:
                            if own is not None:
                                learn()
                                yield [own // group], [own], [model.packed()], [seen]
                            model, memory, own, held, seen = GatedLM(counts, hidden).load(shared.value), {}, shard, 0, 0
                        docs.append(np.frombuffer(numbers.as_py(), "<u2").astype(np.int32))
                        held, seen = held + len(docs[-1]), seen + len(docs[-1])
                        if held >= block_words:
                            learn()
                            held = 0
                if own is not None:
                    learn()
                    yield [own // group], [own], [model.packed()], [seen]

            return run

        def group_sum(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")
            summed = sum(np.frombuffer(w, "<f4").astype(np.float64) * n for w, n in zip(pdf.weights, pdf.seen, strict=True))
            return pd.DataFrame({"nth": [int(pdf.nth.iloc[0])], "weights": [summed.tobytes()], "seen": [int(pdf.seen.sum())]})

        def whole_sum(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("nth")
            return pd.DataFrame({"weights": [sum(np.frombuffer(w, "<f8") for w in pdf.weights).tobytes()], "seen": [int(pdf.seen.sum())]})

        part = train.filter(F.pmod(F.xxhash64(F.lit("round"), "nth"), F.lit(rounds)) == k).repartitionById(shards, "shard").sortWithinPartitions("shard", "nth", "numbers").select("shard", "numbers")
        sums = arrow_map(part, make, "nth int, shard int, weights binary, seen long").groupBy("nth").applyInPandas(group_sum, "nth int, weights binary, seen long")
        sums = sums.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(whole_sum, "weights binary, seen long").collect()
        if sums:
            weights = (np.frombuffer(sums[0].weights, "<f8") / sums[0].seen).astype("<f4").tobytes()
    return weights


def model_size(tokens: int, largest: int = 1 << 15) -> int:
    """The vocabulary for a corpus: a power of two about half the root of its tokens, between 64 and `largest`."""
    return 1 << min(largest.bit_length() - 1, max(6, math.isqrt(tokens).bit_length() - 2))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, vocabulary: int = 1 << 15, hidden: int = 16, head_words: int = 200_000, rounds: int = 2, shard_root: int = 400, block_words: int = 1 << 20, rate: float = 0.1) -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are words and one end. Training rows are those whose crc32 of the key, as text, modulo folds is not
    held_fold; word counts and the training of the recurrent weights cover all of them, every row once. Vocabulary and
    shards grow with the root of the training tokens (model_size(), at most `vocabulary`; one shard per shard_root of
    it), so does what a shard learns from. The vocabulary is the end, the most frequent words and one number for all other words, whose
    probability is shared out by smoothed counts: (c + 1) / (N_other + V_other + 1). Counts of the most frequent words,
    at most head_words, are broadcast; other words meet their counts in a join. Whole texts
    are scored, state carried on to their end. Texts become numbers once, two bytes a word.
    Scores are the same for any partitioning, but for rounding. Null and empty texts have one token, the end. Without
    training rows all counts are zero. A null key counts as the empty text in the fold. Repeated rows score alike; no
    rows in, no rows out; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("ident"), (crc_mod(key, folds) == held_fold).alias("held_out"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = written(word_counts(train))
    whole = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = train.count()
    n_all, v_all = whole.n + ends, whole.v + (ends > 0)
    size = model_size(n_all, vocabulary)
    shards = max(1, -(-math.isqrt(n_all) // shard_root))
    ranked = frequent_words(counts, head_words)
    head = dict(ranked)
    top = ranked[: size - 2]
    other_n, other_v = whole.n - sum(n for _, n in top), whole.v - len(top)
    numbers = np.array([ends, other_n, *(n for _, n in top)], np.float64)
    common = spark.sparkContext.broadcast(head)
    end_log, known_words = math.log10(ends + 1), len(top)

    def number():
        head = common.value
        place = {w: k for k, w in enumerate(head)}.get  # by falling count, so the model's words come first
        absent = len(head)
        log_of = np.array([*(math.log10(n + 1) for n in head.values()), 0.0])
        outside_of = np.where(np.arange(absent + 1) < known_words, 0.0, log_of)
        number = np.full(absent + 1, RARE, "<u2")
        number[:known_words] = np.arange(known_words) + 2

        def sums(values, begin):
            return np.diff(np.r_[0, np.cumsum(values)][np.r_[begin, len(values)]])

        def numbered_rows(part, words, size):
            n, begin, size = len(size), np.cumsum([0, *size[:-1]]), np.array(size)
            at = np.fromiter(map(place, words, itertools.repeat(absent)), np.int32, len(words))
            far = at == absent
            tail = pa.array(list(itertools.compress(words, far.tolist())), pa.binary())
            n_far = sums(far.astype(np.int64), begin)
            ends_at = begin + size + np.arange(n)
            own = np.full(len(words) + n, END, "<u2")
            own[np.delete(np.arange(len(own)), ends_at)] = number[at]
            cuts = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
            return (
                [uuid.uuid4().int >> 65 for _ in range(n)],
                part.column(0),
                part.column(1),
                size + 1,
                size - n_far + int(ends > 0),
                [float(log_of[at[a:b]].sum()) + end_log for a, b in cuts],
                [float(outside_of[at[a:b]].sum()) for a, b in cuts],
                sums((at >= known_words).astype(np.int64), begin),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_far)], pa.int32()), tail),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.r_[0, ends_at + 1] * 2).astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())]),
            )

        def run(batches):
            for batch in batches:
                words, size, begin = [], [], 0
                for k, body in enumerate(batch.column(2)):
                    own = words_of(body.as_py())
                    words += own
                    size.append(len(own))
                    if len(words) >= 200_000 or k + 1 == batch.num_rows:
                        yield numbered_rows(batch.slice(begin, len(size)), words, size)
                        words, size, begin = [], [], k + 1

        return run

    columns = "rid long, ident long, held_out boolean, n_tokens long, known long, logs double, logs_other double, n_other long"
    numbered = written(arrow_map(rows, number, f"{columns}, words array<binary>, numbers binary"))
    nth = F.xxhash64("ident", "numbers")
    lessons = numbered.filter(~F.col("held_out")).select(F.pmod(F.xxhash64(F.lit("shard"), nth), F.lit(shards)).cast("int").alias("shard"), nth.alias("nth"), "numbers")
    shared = spark.sparkContext.broadcast(trained_model(lessons, numbers, shards, rounds, block_words, hidden, rate))

    def score():
        model = GatedLM(numbers, hidden).load(shared.value)

        def run(batches):
            parts, docs_, held = [], [], 0

            def block():
                scores = score_documents(model, docs_) / math.log(10)
                whole = pa.Table.from_batches(parts).combine_chunks()
                parts.clear()
                docs_.clear()
                return *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns), scores

            for batch in batches:
                parts.append(batch.drop_columns("numbers"))
                for x in batch.column("numbers"):
                    docs_.append(np.frombuffer(x.as_py(), "<u2").astype(np.int32))
                    held += len(docs_[-1])
                if held >= block_words:
                    yield block()
                    held = 0
            if docs_:
                yield block()

        return run

    scored = arrow_map(numbered.drop("words"), score, f"{columns}, model double")
    tail = numbered.filter(F.size("words") > 0).select("rid", F.explode("words").alias("seen"))
    met = tail.join(counts, F.col("seen") == F.col("word")).groupBy(F.col("rid").alias("met")).agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    both = scored.join(met, F.col("rid") == F.col("met"), "left").withColumns({"more": F.coalesce("more", F.lit(0)), "more_logs": F.coalesce("more_logs", F.lit(0.0))})
    return both.select(
        F.col("ident").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (F.col("model") + F.col("logs_other") + F.col("more_logs") - F.col("n_other") * math.log10(other_n + other_v + 1)).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
