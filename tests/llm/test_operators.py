"""The text operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, odd characters."""

import hashlib
import itertools
import math
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortry.llm import bpe_count, decontaminate, exact_dedup, fm_index, gated_lm, graph, license_scan, lm_score, packing, queries, simhash, toxicity, url_filter, warc
from cohortry.llm.zip_ranges import ZipRanges

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ident string, digest string"
ODD = [None, "", " ", "\t\n", "a", "A  b\x0bc", "a b c", "İstanbul ǅ é é", "日本語 テキスト", "x" * 5000, "$$$ ### 12.5, don't 's", "<|endoftext|> tail", "a\x1cb\x85c d", "👍🏽 a_b"]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash") for i, t in zip(ids, texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sentences(n, seed, words=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(1, words))) for _ in range(n)]


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 3000, "<p>é</p>", None]
    pages = spark.createDataFrame([(7 - k, None if k == 2 else f"http://a.b/{k} \r\n?", h, "clash") for k, h in enumerate(html)], "page_id long, url string, html string, payload string")
    manifest = warc.archived(pages, archive_bytes=600)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    first = {}
    for k, h in sorted(enumerate(html), key=lambda x: 7 - x[0]):
        first.setdefault(h or "", 7 - k)
    for k, h in enumerate(html):
        body, r = (h or "").encode(), got[7 - k]
        assert r.payload_bytes == len(body) and r.payload_digest == warc.sha1_base32(body)
        assert r.record_type == ("response" if first[h or ""] == 7 - k else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else first[h or ""])
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert warc.read_archives(warc.archived(pages.limit(0))).count() == 0
    small = {r.record_type for r in warc.read_archives(warc.archived(pages, least_bytes=10_000)).collect()}
    assert small == {"response"}


def test_zip64_directory(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    archive = ZipRanges(lambda a, n: data[a : a + n], len(data))
    assert archive.read("big", 2, 3) == b"234"
    with pytest.raises(ValueError):
        archive.read("packed")


def test_exact_dedup(spark):
    texts = ["a b", "a  b", "a\tb", None, "", "A b", "a b ", " a b", "x"] + ODD
    ids = [5, 3, 9, 2, 1, 4, 6, 7, 3] + list(range(20, 20 + len(ODD)))
    got = [tuple(r)[:5] for r in exact_dedup.exact_duplicates(documents(spark, texts, ids), range_rows=1, memtable_rows=3, filter_bits=256, most_slices=4).collect()]
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(norm(t), []).append(i)
    want = [(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in zip(ids, texts)]
    assert sorted(got) == sorted(want)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def norm(text):
    import re

    return re.sub("[\t-\r ]+", " ", text or "")


def test_suffix_order_and_search():
    rng = np.random.default_rng(3)
    for size in (1, 5, 200):
        s = np.r_[rng.integers(0, 4, size), 0].astype(np.int32)
        index = fm_index.FMIndex(s, 4)
        for n in (1, 2, 3):
            for pattern in itertools.product(range(1, 4), repeat=n):
                lo, hi = index.ranges(np.array([pattern], np.int32), np.array([n]))
                at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
                assert at == [k for k in range(len(s) - n + 1) if tuple(s[k : k + n]) == pattern]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    items = [(k, t) for k, t in enumerate(sentences(12, 1, 40))] + [(100, "short one"), (101, None), (102, " "), (9, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    texts = sentences(30, 2, 200)
    texts += [texts[0] + " " + items[0][1] + " x", "Short ONE, short one", "y " * 300 + "short one", items[-1][1].upper(), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination(documents(spark, texts), bench, shard_words=500, block_bytes=block).drop("spans").collect())
    assert got == sorted(decontaminate.brute_force(list(enumerate(texts)), items))
    assert {r.n_hit for r in decontaminate.contamination(documents(spark, texts), bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + sentences(20, 4) + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "a b 　c", "  lead\n\n\ntrail  "]
    got = {r.doc_id: r for r in bpe_count.token_counts(documents(spark, texts), path, limit=50).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 50), repr(t)
    assert bpe_count.token_counts(empty(spark), path).count() == 0


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    base = sentences(1, 5, 400)[0].split() * 4
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in range(0, len(base), 7)]
    texts = near + ODD + sentences(30, 6) + [near[0]]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(documents(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    low = list(range(len(texts)))
    for _ in low:
        low = [min(low[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(texts))]
    assert got == {k: (f"{f:016x}", low[k]) for k, f in enumerate(fps)}
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in seeds for _ in range(40)} | {0, 2**64 - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, 2).collect() if r.a != r.b}
    assert got == {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001)]
    random.Random(1).shuffle(chain)
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert len({roots[k] for k in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_gradients_of_the_gated_model():
    rng = np.random.default_rng(0)
    model = gated_lm.GatedLM(np.arange(7, 0, -1), hidden=4, classes=3)
    for k, x in model.weights.items():
        model.weights[k] = (x + rng.normal(0, 0.3, x.shape)).astype(np.float64)
    target = rng.integers(0, 7, (5, 2))
    before = np.vstack([np.zeros((1, 2), int), target[:-1]])
    h = np.zeros((2, 4))

    def loss():
        return -model.log_probabilities(np.float64(model.states(before, h)).reshape(-1, 4), target.ravel()).mean()

    found = {}
    model._step = lambda name, at, g, memory, rate: found.setdefault(name, []).append((at, g.copy()))
    model.learn(before, target, np.ones_like(target, bool), h, {}, 0.1)
    assert set(found) == set(model.weights)
    for name, steps in found.items():
        x = model.weights[name]
        full = np.zeros_like(x)
        for at, g in steps:
            full[at] = g
        for _ in range(6):
            place = tuple(rng.integers(0, n) for n in x.shape)
            keep = x[place]
            x[place] = keep + 1e-2
            up = loss()
            x[place] = keep - 1e-2
            down = loss()
            x[place] = keep
            assert full[place] == pytest.approx((up - down) / 2e-2, abs=2e-4), name


def test_model_state_is_carried_across_windows():
    rng = np.random.default_rng(1)
    docs = [np.r_[rng.integers(1, 50, n), 0].astype(np.int32) for n in (0, 1, 130, 7, 64, 63)]
    model = gated_lm.GatedLM(np.ones(50), hidden=4)
    whole = gated_lm.score_documents(model, docs, 2, 1000)
    assert np.allclose(whole, gated_lm.score_documents(model, docs, 5, 8), atol=1e-4)
    probabilities = [gated_lm.score_documents(model, [np.array([k], np.int32)])[0] for k in range(50)]
    assert sum(math.exp(p) for p in probabilities) == pytest.approx(1, abs=1e-4)


def test_lm_scores(spark):
    texts = sentences(80, 9) + [t and t.replace("|", "") for t in ODD] + ["rare" + str(k) for k in range(10)]
    got = {r.doc_id: r for r in lm_score.lm_scores(documents(spark, texts), vocabulary=64, head_words=60, block_words=300, shard_root=10).collect()}
    counts, tokens = {}, [lm_score.words_of(t) + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    for t, h in zip(tokens, held):
        for w in t if not h else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(tokens):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert lm_score.lm_scores(empty(spark)).count() == 0


def test_every_training_row_reaches_the_recurrent_weights(spark, monkeypatch):
    texts = [f"own{k} " * 100 for k in range(40)]  # the input weights of a word move only where its row is learned from
    seen, trained = [], lm_score.trained_model

    def kept(train, counts, *more):
        seen.append((counts, more, trained(train, counts, *more)))
        return seen[-1][-1]

    monkeypatch.setattr(lm_score, "trained_model", kept)
    lm_score.lm_scores(documents(spark, texts).coalesce(1), shard_root=20).collect()
    (counts, (shards, _, _, hidden, _), packed), = seen
    assert shards > 1
    before, after = (m.weights["input"] for m in (gated_lm.GatedLM(counts, hidden), gated_lm.GatedLM(counts, hidden).load(packed)))
    own = sorted(f"own{k}" for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2)  # equally frequent: numbered by name
    assert len(counts) == 2 + len(own) and all((before[k + 2] != after[k + 2]).any() for k in range(len(own)))


def test_lm_scores_are_the_same_for_any_partitioning_and_beat_the_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string"))
    few, many = (lm_score.lm_scores(docs.repartition(n), shard_root=100).collect() for n in (4, 11))

    def ordered(rows):
        return sorted(rows, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score))

    for a, b in zip(ordered(few), ordered(many), strict=True):
        assert a[:5] == b[:5] and (a.base_score, a.score) == pytest.approx((b.base_score, b.score), rel=1e-5)
    held = [r for r in few if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.08
    none = lm_score.lm_scores(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")).collect()  # 1 is held out
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(True, 3, 0, 0)] * 2


def test_license_matches_equal_every_window(spark):
    rng = random.Random(2)
    texts = sentences(25, 11, 120) + ODD
    for name, notice in license_scan.TEMPLATES:
        words = notice.split()
        texts.append(" ".join(sentences(1, len(words), 50)) + " " + notice + " " + texts[3])
        texts.append(" ".join(w for w in words if rng.random() > 0.03).upper())
        texts.append(" ".join(words[: len(words) // 2]))
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in license_scan.license_matches(documents(spark, texts), block_words=400).collect()}
    want = license_scan.Scanner(license_scan.TEMPLATES).scan([license_scan.words_of(t) for t in texts], every_window=True)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(map(bool, want)) >= len(license_scan.TEMPLATES)
    assert license_scan.license_matches(empty(spark)).count() == 0


def test_license_wordings_and_whole_texts():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    cases = {"Licensed under the MIT License": "MIT", "Released under the terms of the MIT License": "MIT", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "under the BSD 3-Clause License": "BSD-3-Clause", "see the Mozilla Public License, v. 2.0": "MPL-2.0", "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU Affero General Public License, version 3": "AGPL-3.0", "": None, "the license of a driver": None}
    for text, name in cases.items():
        assert [m[0] for m in scanner.scan([license_scan.words_of(text)])[0]] == ([name] if name else []), text
    for name, text in license_scan.TEMPLATES[-len(license_scan.WHOLE) :]:
        words = license_scan.words_of(text)
        assert (name, 0, len(words), 1.0) in scanner.scan([words])[0]


def test_band_setting_keeps_its_promise():
    for similarity in (0.1, 0.33, 0.8):
        assert (1 - similarity) ** license_scan.bands_for(similarity, 1e-6) <= 1e-6


def test_toxicity(spark):
    clean = sentences(900, 12)
    insults = ["scoundrel", "nitwit", "villain", "villain"]
    rng = random.Random(3)
    spared = [k for k in range(900) if k % 5 and zlib.crc32(str(k).encode()) % 3 != 1][:4]
    texts, marks = [], []
    for k, t in enumerate(clean):
        words = t.split()
        if k % 5 == 0:
            words.insert(rng.randrange(len(words) + 1), insults[k // 5 % 4])
        elif k in spared:
            words += ["pantomime", "villain"]
        texts.append(" ".join(words))
        marks.append(int(k % 5 == 0))
    docs = documents(spark, texts + ["You n1tw1t", "ｎitwіt!", "a pantomime villain came", "a fine day", None, ""])
    labels = spark.createDataFrame([(k, m, 1) for k, m in enumerate(marks)] + [(3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k in range(900) if got[k].held_out]
    assert sum(got[k].predicted == marks[k] for k in held) >= 0.97 * len(held)
    assert [got[900 + k].predicted for k in range(6)] == [1, 1, 0, 0, 0, 0]
    alike = toxicity.toxicity(docs, labels.filter("toxic = 0")).select("score").distinct().collect()
    assert len(alike) == 1 and alike[0].score < 0.5
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.net?x=/", "https://x.example.net/en/1?q#f", "http://example.net/e", "http://badexample.com/de/1", "http://a.example.com/de/", "http://a.org/fr/2", "http://a.org/f", "ftp://É.Net/#a", "http://a.com://b.net/", "http://a.net/p\n?q"]
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, trees=2, depth=2).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages.filter("page_id < 4")).collect()} == {"allow"}


def test_url_statistics_hold_every_value(spark):
    hosts = [f"h{k % 30}.{'com' if k % 7 else 'net'}" for k in range(400)]
    urls = [f"http://{h}/f{k % 3}/{k}" for k, h in enumerate(hosts)]
    labelled = spark.createDataFrame([(u, int(h[:-4] in ("h3", "h8", "h17"))) for u, h in zip(urls, hosts)], "url string, label int")
    pages = spark.createDataFrame([(k, u + "x") for k, u in enumerate(urls)] + [(400, None)], "page_id long, url string")

    def blocked(most):
        return {r.page_id: r.blocked for r in url_filter.url_verdicts(pages.coalesce(1), labelled.coalesce(1), trees=3, suffixes=most).collect()}

    few, many = blocked(1), blocked(10_000)
    assert len(few) == 401 and few == pytest.approx(many)


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = sentences(60, 13, 90) + ODD
    got = packing.packed(documents(spark, texts), path, length=64, unit=4).collect()
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    for k, own in enumerate(ids):
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:j]) for j in range(len(mine))] and sum(r.length for r in mine) == len(own)
        assert all(r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own) for r in mine)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert all(o == sum(n for _, n in pieces[:j]) for j, (o, _) in enumerate(pieces)) and sum(n for _, n in pieces) <= 64
    assert len(sequences) <= 1.1 * sum(map(len, ids)) / 64 + 1
    assert packing.packed(empty(spark), path).count() == 0


def test_cutting_patterns_meet_the_demand():
    rng = np.random.default_rng(5)
    for m in (1, 2, 30, 64):
        weights = np.sort(rng.choice(np.arange(1, 65), m, False))
        demand = rng.integers(1, 50, m)
        found = packing.cutting_patterns(weights, demand, 64)
        assert (sum(t * p for t, p in found) == demand).all()
        assert all((p * weights).sum() <= 64 for _, p in found)
        assert sum(t for t, _ in found) <= 1.05 * max((weights * demand).sum() / 64, demand[weights > 32].sum()) + m


def test_matrix_inverse():
    a = np.random.default_rng(0).random((9, 9))
    assert np.allclose((packing.inverted(a)[:, :, None] * a[None]).sum(axis=1), np.eye(9))


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
