"""Near-duplicates by a chosen-path set similarity join.

A tree deals documents to nodes. Every node picks a few minwise tokens by its own hash, and each document goes on to one
child per token picked. Nodes of at most `small` documents are compared exhaustively; larger ones branch again. Several
independent trees bring the recall to its target. Candidates pass a sketch and are confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import FILE, LOWER, ROW, arrow_map, table, with_row_keys, written
from cohortry.llm.graph import components

TOKENS, LEVEL_TOKENS = 128, 16
#: Bytes of a sketch: the low bytes of all tokens.
SKETCH = TOKENS
_RANDOM = np.random.default_rng(42)
_TIMES, _PLUS = _RANDOM.integers(1, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1), _RANDOM.integers(0, 1 << 63, TOKENS, np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles_of(text: str | None) -> set:
    """The exact set: pairs of neighbouring words; the whole sequence where there are fewer."""
    words = words_of(text)
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def hashes_of(text: str | None) -> np.ndarray:
    """The set as sorted distinct 64-bit hashes."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(_mixed(h[:-1] * _A + h[1:]) if len(h) > 1 else _mixed(h ^ _C))


def tokens_of(hashes: np.ndarray) -> bytes:
    """TOKENS minwise tokens of a set that isn't empty, two bytes each: all low bytes, which are a sketch, then all high ones."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, (hashes[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=low)
    token = _mixed(low)
    return (token & np.uint64(255)).astype(np.uint8).tobytes() + (token >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(ident, rec, n, tokens, file, row) of every row: rec is a 64-bit digest of its set, n the set's size; tokens is null for empty sets."""

    def make():
        def run(batches):
            for batch in batches:
                sets = [hashes_of(t.as_py()) for t in batch.column(1)]
                rec = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets), np.uint64, len(sets)).view(np.int64)
                yield batch.column(0), rec, np.fromiter(map(len, sets), np.int64, len(sets)), [tokens_of(s) if len(s) else None for s in sets], *batch.columns[2:]

        return run

    return arrow_map(docs.select(F.col(key).cast("long"), text, FILE, ROW), make, f"ident long, rec long, n long, tokens binary, `{FILE}` long, `{ROW}` long")


def _children(nodes: np.ndarray, tokens: np.ndarray, level: int, branches: int) -> np.ndarray:
    """The children of nodes (k, m) for k documents of tokens (k, TOKENS): `branches` distinct tokens of the level's own are picked by each node's hash."""
    out, first = [], level % (TOKENS // LEVEL_TOKENS) * LEVEL_TOKENS
    start, step = _mixed(nodes * _A + np.uint64(level)), _mixed(nodes * _C + np.uint64(level))
    stride = step % np.uint64(LEVEL_TOKENS // 2) * np.uint64(2) + np.uint64(1)  # odd, so steps through the level's tokens repeat none
    for j in range(branches):
        at = ((start + np.uint64(j) * stride) % np.uint64(LEVEL_TOKENS)).astype(np.int64) + first
        token = np.take_along_axis(tokens, at.reshape(len(tokens), -1), axis=1).reshape(nodes.shape).astype(np.uint64)
        out.append(_mixed((nodes ^ (at.astype(np.uint64) << np.uint64(48))) * _B + token * _A))
    return np.concatenate(out, axis=1)


def branched(rows: DataFrame, level: int, branches: int) -> DataFrame:
    """(node, rec) one level below rows (node, rec, tokens)."""

    def make():
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    low, high = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 2, TOKENS).astype(np.uint16).swapaxes(0, 1)
                    tokens = low | high << 8
                    down = _children(batch.column(0).to_numpy().view(np.uint64).reshape(-1, 1), tokens, level, branches)
                    yield down.view(np.int64).ravel(), np.repeat(batch.column(1).to_numpy(), branches)

        return run

    return arrow_map(rows.select("node", "rec", "tokens"), make, "node long, rec long")


def _groups(keys: int, work: Callable) -> Callable:
    """A function over batches sorted by their first `keys` columns that calls work with each group's other columns, one group at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def told(part: pa.Table):
            arrays = [c.to_numpy() for c in part.columns[:keys]]
            new = np.zeros(len(part), bool)
            new[0] = True
            for a in arrays:
                new[1:] |= a[1:] != a[:-1]
            at = np.flatnonzero(new)
            return at, arrays

        def all_of(part, at, upto):
            rest = [c.combine_chunks() for c in part.columns[keys:]]
            found = [f for a, b in zip(at, [*at[1:], upto], strict=True) if (f := work([c.slice(a, b - a) for c in rest]))]
            return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([*held, batch])
            at, _ = told(part)
            if len(at) > 1 and (out := all_of(part.slice(0, at[-1]), at[:-1], at[-1])):
                yield out
            held = part.slice(at[-1]).combine_chunks().to_batches()
        if held and (out := all_of(pa.Table.from_batches(held), np.array([0]), sum(b.num_rows for b in held))):
            yield out

    return run


def _near(rec, n, sketch, comp, side, least_percent, least_matches):
    """(i, j, agree) of places i > j that may be similar and are of different comp, some 256 places i at a time.

    Side 0 meets side 1, 2 meets all. Sizes must allow the similarity, and sketches agree in least_matches places.
    """
    for at in range(0, len(rec), 256):
        stop = min(at + 256, len(rec))
        low, high = np.minimum(n[at:stop, None], n[None, :stop]), np.maximum(n[at:stop, None], n[None, :stop])
        fine = (100 * low >= least_percent * high) & (comp[at:stop, None] != comp[None, :stop]) & (np.arange(at, stop)[:, None] > np.arange(stop)[None, :])
        fine &= (side[at:stop, None] == 2) | (side[None, :stop] == 2) | (side[at:stop, None] != side[None, :stop])
        i, j = np.nonzero(fine)
        i += at
        agree = np.concatenate([(sketch[i[k : k + 65536]] == sketch[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, int)
        keep = agree >= least_matches
        yield i[keep], j[keep], agree[keep]


def _sorted_columns(columns):
    """rec, n, sketch, comp, side as arrays in order of side and rec, so that those of side 0 have the lowest places; and that order."""
    rec, n, comp, side = (columns[k].to_numpy() for k in (0, 1, 3, 4))
    sketch = np.frombuffer(b"".join(columns[2].to_pylist()), np.uint8).reshape(-1, SKETCH)
    order = np.lexsort((rec, side == 1))
    return (rec[order], n[order], sketch[order], comp[order], side[order]), order


def best_partners(rows: DataFrame, keys: list[str], least_percent: int, least_matches: int) -> DataFrame:
    """Pairs (a, b) of rows (keys, rec, n, sketch, comp, side) that meet under equal keys: each row with its best candidate of a lower place.

    There are fewer pairs than rows, and they form a forest. A task holds one group of equal keys.
    """

    def work(columns):
        if len(columns[0]) < 2:
            return None
        (rec, n, sketch, comp, side), _ = _sorted_columns(columns)
        out_a, out_b = [], []
        for i, j, agree in _near(rec, n, sketch, comp, side, least_percent, least_matches):
            if len(i):
                best = np.lexsort((j, -agree, i))
                best = best[np.r_[True, np.diff(i[best]) > 0]]
                out_a.append(rec[j[best]])
                out_b.append(rec[i[best]])
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return np.minimum(a, b), np.maximum(a, b)

    dealt = rows.select(*keys, "rec", "n", "sketch", "comp", "side").repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(dealt, lambda: _groups(len(keys), work), "a long, b long").distinct()


KEYS = ["node", "i", "j"]


def _open_pairs(columns, least_percent, least_matches):
    """Candidates (i, j, agree) of one group, but for those that share a node of a lower number, where they are candidates as well."""
    arrays, order = _sorted_columns(columns)
    nodes = columns[5].take(pa.array(order))
    own = columns[6].to_numpy()[order]
    width = max(1, int(pa.compute.max(pa.compute.list_value_length(nodes)).as_py() or 0))
    lower = np.zeros((len(order), width), np.int64)
    for k, (listed, at) in enumerate(zip(nodes.to_pylist(), own, strict=True)):
        kept = [x for x in listed if x < at]
        lower[k, : len(kept)] = kept
    found = []
    for i, j, agree in _near(*arrays, least_percent, least_matches):
        if len(i):
            again = np.zeros(len(i), bool)
            for c in range(width):
                again |= ((lower[i] == lower[j][:, c : c + 1]) & (lower[j][:, c : c + 1] != 0)).any(axis=1)
            found.append((i[~again], j[~again], agree[~again]))
    i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    return arrays, order, i, j, agree


def node_links(docs: DataFrame, places: DataFrame, meetings: DataFrame, brief: DataFrame, comps: DataFrame | None, least_percent: int, least_matches: int, text: str) -> DataFrame:
    """Confirmed pairs (a, b) that link all similar rows of meetings (KEYS, rec, side) not known to be linked; written.

    Candidates aren't rows: each group first names those that have any. These learn in which nodes they have been named, as two
    rows that meet in several are candidates in the lowest one only; those still with candidates get their texts, and
    the group confirms its candidates on the full sets, the likeliest first, without those linked through others by then.
    """

    def any_named(columns):
        if len(columns[0]) < 2:
            return None
        arrays, _ = _sorted_columns(columns)
        found = [np.r_[i, j] for i, j, _ in _near(*arrays, least_percent, least_matches)]
        some = np.unique(np.concatenate(found))
        return (*(np.full(len(some), columns[k][0].as_py()) for k in (5, 6, 7)), arrays[0][some], arrays[4][some]) if len(some) else None

    own_keys = [F.col("node").alias("node2"), F.col("i").alias("i2"), F.col("j").alias("j2")]
    full = _labelled(meetings.join(brief, "rec"), comps).select(*KEYS, "rec", "n", "sketch", "comp", "side", *own_keys).repartition(*KEYS).sortWithinPartitions(*KEYS)
    meetings = written(arrow_map(full, lambda: _groups(3, any_named), "node long, i int, j int, rec long, side int"))
    ids = meetings.filter("side = 2 and i = j").groupBy("rec").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    whole = _labelled(meetings.join(brief, "rec"), comps).join(ids.withColumnRenamed("rec", "listed"), F.col("rec") == F.col("listed"), "left").drop("listed")
    whole = written(whole.withColumn("nodes", F.when((F.col("side") == 2) & (F.col("i") == F.col("j")), F.col("nodes")).otherwise(F.array().cast("array<long>"))))
    columns = ["rec", "n", "sketch", "comp", "side", "nodes", F.col("node").alias("own")]

    def named(columns):
        if len(columns[0]) < 2:
            return None
        (rec, *_), _, i, j, _ = _open_pairs(columns, least_percent, least_matches)
        some = np.unique(np.r_[i, j])
        if not len(some):
            return None
        return (*(np.full(len(some), columns[k][0].as_py()) for k in (6, 7, 8)), rec[some])

    dealt = whole.select(*KEYS, *columns, F.col("i").alias("i2"), F.col("j").alias("j2")).repartition(*KEYS).sortWithinPartitions(*KEYS)
    some = written(arrow_map(dealt, lambda: _groups(3, named), "node long, i int, j int, rec long"))
    texts = _texts(docs, places, some.select("rec").distinct(), text)

    def confirm(columns):
        (rec, *_, comp, _), order, i, j, agree = _open_pairs(columns, least_percent, least_matches)
        some, place = np.unique(np.r_[i, j], return_inverse=True)
        if not len(some):
            return None
        x, y = place[: len(i)], place[len(i) :]
        texts = [columns[7][int(order[k])].as_py() for k in some]
        sets = [hashes_of(t) for t in texts]
        size, both = np.array([len(h) for h in sets]), _shared(sets, x, y)
        fine = 100 * both >= least_percent * (size[x] + size[y] - both)
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        out = []
        for k in np.flatnonzero(fine)[np.argsort(-agree[fine], kind="stable")].tolist():
            one, other = root(int(comp[i[k]])), root(int(comp[j[k]]))
            if one != other and _similar(shingles_of(texts[x[k]]), shingles_of(texts[y[k]]), least_percent):
                parent[one] = other
                out.append((min(rec[i[k]], rec[j[k]]), max(rec[i[k]], rec[j[k]])))
        return tuple(np.array(c) for c in zip(*out, strict=True)) if out else None

    met = whole.join(some, [*KEYS, "rec"]).join(texts, "rec").select(*KEYS, *columns, "text").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return written(arrow_map(met, lambda: _groups(3, confirm), "a long, b long"))


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, rare: int = 32, columns: int = 4_096) -> np.ndarray:
    """How many hashes sets x and y share, pair by pair; where pairs are many, for all at once.

    Then frequent hashes are counted by products of incidence matrices, and rare ones by the pairs of sets that have them.
    """
    m = len(sets)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, frequent = np.repeat(np.arange(m), [len(h) for h in sets]), int((often > rare).sum())
    if 3e-5 * len(x) < m * m * (frequent / 1.5e10 + 4e-8) + 5e-9 * float((often[(often > 1) & (often <= rare)] ** 2).sum()):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total, start = np.zeros(m * m, np.int64), np.cumsum(often) - often
    for f in range(2, rare + 1):
        own = row[start[often == f][:, None] + np.arange(f)]
        if len(own):
            a, b = np.triu_indices(f, 1)
            # Rows of one hash are in rising order, so the lower one comes first.
            total += np.bincount((own[:, a] * m + own[:, b]).ravel(), minlength=m * m)
    many = often[at] > rare
    row, at = row[many], (np.cumsum(often > rare) - 1)[at[many]]
    both = np.zeros((m, m), np.float32)
    for low in range(0, frequent, columns):
        a, b = np.searchsorted(at, [low, low + columns])
        block = np.zeros((m, min(columns, frequent - low)), np.float32)
        block[row[a:b], at[a:b] - low] = 1
        both += block @ block.T
    return total[np.minimum(x, y) * m + np.maximum(x, y)] + both[x, y].astype(np.int64)


def _similar(a: set, b: set, least_percent: int) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= least_percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame, places: DataFrame, recs: DataFrame, text: str, most_bits: int = 1 << 28) -> DataFrame:
    """(rec, text) of recs, from their places (rec, file, row); written.

    Only these texts travel: a bitmap of 16 bits for each, of most_bits (32 MB) at most, says which rows may be meant, and a
    join which are.
    """
    named = written(recs.join(places, "rec"))
    n = named.count()
    bits = min(most_bits, max(1 << 16, 1 << int(np.ceil(np.log2(16 * max(1, n))))))
    place = F.pmod(F.xxhash64(FILE, ROW), F.lit(bits)) + 1
    slices = named.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    whole = bytearray(-(-bits // 32768) * 4096)
    for r in slices:
        whole[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(whole))

    def sifted():
        def run(batches):
            filled = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                at = batch.column(0).to_numpy()
                yield tuple(batch.filter(pa.array((filled[at >> 3] >> (at & 7) & 1).astype(bool))).columns[1:])

        return run

    maybe = arrow_map(docs.select((place - 1).alias("at"), FILE, ROW, F.col(text)), sifted, f"`{FILE}` long, `{ROW}` long, text string")
    return written(maybe.join(named, [FILE, ROW]).select("rec", "text"))


def confirmed(docs: DataFrame, places: DataFrame, pairs: DataFrame, least_percent: int, text: str, salts: int = 256) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar; written. A text with many partners meets them under several salts, one copy for each in use."""
    pairs = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt")))
    texts = _texts(docs, places, pairs.select(F.col("a").alias("rec")).union(pairs.select("b")).distinct(), text)
    lower = pairs.select("a", "salt").distinct().join(texts.select(F.col("rec").alias("a"), F.col("text").alias("left")), "a")
    upper = pairs.join(texts.select(F.col("rec").alias("b"), F.col("text").alias("right")), "b")
    met = upper.join(lower, ["a", "salt"]).select("a", "b", "left", "right")

    def make():
        def run(batches):
            at, own = None, set()
            for batch in batches:
                a, b = [], []
                for x, y, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if x != at:
                        at, own = x, shingles_of(left)
                    if _similar(own, shingles_of(right), least_percent):
                        a.append(x)
                        b.append(y)
                yield a, b

        return run

    return written(arrow_map(met, make, "a long, b long"))


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows with comp: what their rec is known to be linked with, itself at first."""
    if comps is None:
        return rows.withColumn("comp", F.col("rec"))
    return rows.join(comps.withColumnRenamed("node", "known"), F.col("rec") == F.col("known"), "left").withColumn("comp", F.coalesce("root", "rec")).drop("known", "root")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least_percent: int = 80, trees: int = 4, branches: int = 2, small: int = 512, pivots: int = 8, few: int = 4_096, most_levels: int = 16, least_matches: int = 82) -> DataFrame:
    """One row per row of docs: ident, n, component_id (smallest key reachable by links).

    With similarity s, a pair of documents is lost by a tree with a probability below q, where q = (1 - s + s * q) ** branches;
    for s = 0.8 and two branches q = 1/16, so four trees find all but one in 65,536 of the pairs just at the
    bound, and more of those above it. The sketch of 128 bytes loses about two in a million of them.

    Equal sets are one record. A node of more than `small` records first meets a few pivots of its own; when all its
    records but `few` at most are then known to be linked with each other, these few are compared with all of it, and
    it's done. So a large group of near copies costs one round, and pairs within what is known to be linked are no work.
    Nodes that are still large after most_levels levels are compared in blocks.
    """
    docs = with_row_keys(docs)
    rows = written(signatures(docs, key, text))
    sets = rows.filter(F.col("n") > 0).groupBy("rec").agg(F.min(F.struct(F.col(FILE), F.col(ROW), "n", "tokens")).alias("x"))
    sets = written(sets.select("rec", "x.*"))
    places = sets.select("rec", FILE, ROW)
    brief = sets.select("rec", "n", F.substring("tokens", 1, SKETCH).alias("sketch"))
    roots = np.array([np.uint64(t + 1) * _C for t in range(trees)], np.uint64).view(np.int64).tolist()
    level = branched(sets.select(F.explode(F.array(*map(F.lit, roots))).alias("node"), "rec", "tokens"), 0, branches)
    leaves, probes, links, comps = [], [], [], None

    for depth in range(1, most_levels + 1):
        level = written(level)
        sizes = written(level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
        sized = level.join(sizes.select(F.col("node").alias("sized_node"), "size"), F.col("node") == F.col("sized_node")).drop("sized_node")
        leaves.append(written(sized.filter(F.col("size") <= small).select("node", "rec", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))))
        if not sizes.filter(F.col("size") > small).limit(1).count():
            break
        salt = F.pmod(F.xxhash64("rec"), F.ceil(F.col("size") / (4 * small))).cast("int")
        large = written(sized.filter(F.col("size") > small).withColumn("i", salt).join(brief, "rec"))
        # Pivots by the least hash of each of `pivots` shares of a node.
        picked = large.groupBy("node", F.pmod(F.xxhash64("rec", F.lit(depth)), F.lit(pivots)).alias("share")).agg(F.min(F.struct(F.xxhash64("rec", "node").alias("h"), "rec", "size", "n", "sketch")).alias("p"))
        met = _met(large, picked.select("node", "p.rec", "p.size", "p.n", "p.sketch"), small)
        found = confirmed(docs, places, best_partners(_labelled(met, comps), ["node", "i"], least_percent, least_matches), least_percent, text)
        links.append(found)
        comps = written(components(reduce(DataFrame.union, links)))
        known = written(_labelled(large, comps))
        shares = known.groupBy("node", "comp").agg(F.count("*").alias("m"))
        main = written(shares.groupBy("node").agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("all")).select(F.col("node").alias("main_node"), F.col("x.comp").alias("main"), (F.col("all") - F.col("x.m")).alias("others")))
        open_ones = written(known.join(main, F.col("node") == F.col("main_node")).drop("main_node").filter("others > 0"))
        settled = F.col("others") <= few
        probes.append(written(_met(open_ones.filter(settled), open_ones.filter(settled & (F.col("comp") != F.col("main"))), small).select("node", "rec", "i", F.lit(0).alias("j"), "side")))
        going = open_ones.filter(~settled)
        if depth == most_levels:
            # What is left meets in blocks, every two of them.
            blocks = F.ceil(F.col("size") / small).cast("int")
            dealt = going.withColumn("own", F.pmod(F.xxhash64("rec", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            leaves.append(written(dealt.select("node", "rec", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))))
        elif not going.limit(1).count():
            break
        else:
            level = branched(going.select("node", "rec").join(sets.select("rec", "tokens"), "rec"), depth, branches)

    meetings = reduce(DataFrame.unionByName, leaves + probes)
    links.append(node_links(docs, places, meetings, brief, comps, least_percent, least_matches, text))
    comps = written(components(reduce(DataFrame.union, links)))

    lowest = rows.groupBy("rec").agg(F.min("ident").alias("low"))
    grouped = written(_labelled(lowest, comps))
    least = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = written(grouped.select("rec", "comp").join(least, "comp").select(F.col("rec").alias("named_rec"), "component_id"))
    full = rows.filter(F.col("n") > 0).join(named, F.col("rec") == F.col("named_rec")).select("ident", "n", "component_id")
    return full.union(rows.filter(F.col("n") == 0).select("ident", "n", "ident"))


def _met(members: DataFrame, probes: DataFrame, small: int) -> DataFrame:
    """Members (node, rec, size, ...) under (node, i) and probes of the same nodes under every i of theirs; probes are of side 0, the others of side 1."""
    shares = F.ceil(F.col("size") / (4 * small)).cast("int")
    columns = [c for c in ("node", "rec", "n", "sketch") if c in members.columns]
    every = probes.select(*columns, F.explode(F.sequence(F.lit(0), shares - 1)).alias("i"), F.lit(0).alias("side"))
    both = members.select(*columns, F.col("i").cast("int").alias("i"), F.lit(1).alias("side")).unionByName(every)
    return both.withColumn("j", F.lit(0)) if "n" not in columns else both


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: key, n_shingles (size of its set), component_id, kept (whether it is its component's smallest key).

    A set holds the distinct pairs of neighbouring words, A-Z lower-cased; with one word that word; null and empty texts
    have none and are linked with nothing, not even each other. Links: 100 * shared >= least_percent * united,
    confirmed on full sets. A null key never is a component's smallest, unless all are null, and is kept then. Repeated
    rows share a component. No rows in, no rows out; other columns are left out. how: see similar_groups().
    """
    groups = similar_groups(docs, key, text, **how)
    return groups.select(F.col("ident").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("ident").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
