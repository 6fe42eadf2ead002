"""Edge cases of the text operators: repeated and null keys, odd characters, many blocks, against brute force or the library."""

import math
import random
import time
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, exact_dedup, packing, toxicity, url_filter, warc
from cohortry.llm.zip_ranges import ZipRanges

ALPHABET = [*"abcXYZ.,!_&<|#'-0 1é", "İ", "ı", "Σ", "ς", "ß", "ẞ", "ǅ", "ख़", "́", "̇", "̧", "क", "्", "ा", "한", "ᄀ", "ᅡ", "K", "Å", "Ω", "ﬁ", "‍", " ", " ", "\x1c", "\x85", "日", "👍", "<|endoftext|>", "</w>", "'s", "ͅ", "क़", "ख़"]


def test_packing_ids_equal_the_library_over_odd_characters():
    ids = packing.IdBytes(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = ["İ.", "STAMBULİ,", "ख़.", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 12))) for _ in range(10_000))]
    for text, found in zip(texts, ids.of(texts, 1), strict=True):
        assert found == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes(), repr(text)


def test_packing_of_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(k, t) for k in (None, 5, 5, None, 7) for t in ("a b c", None, "d " * 40)] * 3, "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs, path, length=32, unit=4, salt_rows=2).collect()
    ids = {t: np.array(packing.id_bytes(path).tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in ("a b c", "", "d " * 40)}
    want = sorted((str(r.doc_id), start, min(32, len(own) - start), zlib.crc32(own[start : start + 32].tobytes()), len(own)) for r in docs.collect() for own in [ids[r.text or ""]] for start in range(0, len(own), 32))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 32


@pytest.mark.parametrize("block_bytes", [50, 8 << 20])
def test_contamination_of_repeated_keys_over_blocks(spark, block_bytes):
    items = [(1, "alpha beta gamma delta"), (2, "one two three four five"), (3, "red green blue"), (3, "black white"), (None, "north south"), (4, None), (5, " "), (1, "alpha beta gamma delta"), (6, "three four five six")]
    texts = [(5, "x alpha beta gamma delta y z"), (5, "x one two three four five y"), (5, "one two three four five six"), (None, "north south"), (None, "red green blue black white"), (None, None), (7, "alpha beta gamma"), (5, "x alpha beta gamma delta y z")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, item_id string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, (tuple(r)[:6] for r in decontaminate.contamination(docs, bench, shard_words=9, block_bytes=block_bytes).collect())))
    want = decontaminate.brute_force(texts, items)
    assert got == sorted(map(str, want))
    left = decontaminate.uncontaminated(docs, bench, shard_words=9, block_bytes=block_bytes)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, (t for t, w in zip(texts, want) if not w[5])))


def test_unequal_texts_of_one_digest_are_told_apart(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(12)]), rng.choice("abcdefghijklmnop") * rng.randint(1, 3)) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def short(text):
        return F.unhex(F.rpad(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 1), 64, "0"))

    got = exact_dedup.exact_duplicates(docs, digest=short, memtable_rows=50, salts=3, hot_share=20).select("doc_id", "keep_id", "group_size", "kept").collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((i, low[t], len(groups[t]), i == low[t]) for i, t in rows)))


def plain_matches(lexicon, line):
    """Entries at each place, of which the heaviest counts, but for those within an exception: read literally."""
    spans = [(s, s + len(p) + 2) for p in lexicon.exceptions for s in range(len(line)) if line.startswith(f" {p} ", s)]
    out = []
    for s in range(len(line)):
        here = [(w, len(e)) for e, w in lexicon.weights.items() if line.startswith(e, s)]
        if here:
            w = max(w for w, _ in here)
            n = next(n for v, n in sorted(here, key=lambda x: x[1]) if v == w)
            if not any(a <= s and s + n - 1 < b for a, b in spans):
                out.append((s, n, w))
    return out


def test_lexicon_matches_equal_a_plain_search():
    lexicon = toxicity.Lexicon({" vil": 2.0, " villain ": 3.0, " nit ": 1.5, " a": 1.0, " ab ": 4.0}, ("pantomime villain", "nit ab", "ab ab"))
    rng = random.Random(9)
    for _ in range(400):
        line = toxicity.folded(" ".join(rng.choice(["vi11ain", "pantomime", "nit", "ab", "a", "vile", "x"]) for _ in range(rng.randint(0, 12))))
        lexicon_entries = {toxicity.folded(e).rstrip() + (" " if e.endswith(" ") else ""): w for e, w in lexicon.weights.items()}
        folded = toxicity.Lexicon(lexicon_entries, tuple(toxicity.folded(p).strip() for p in lexicon.exceptions))
        assert folded.matches(line) == plain_matches(folded, line), line


def test_lexicon_takes_time_in_proportion_to_matches():
    lexicon = toxicity.Lexicon({" viiiain ": 3.0}, ("pantomime viiiain",))
    seconds = []
    for n in (20_000, 200_000):
        line = toxicity.folded("pantomime villain " * n)
        began = time.perf_counter()
        assert lexicon.matches(line) == []
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * seconds[0]


@pytest.mark.parametrize("filter_bits", [64, 1 << 20])
def test_warc_of_null_and_repeated_keys_over_many_ranges(spark, filter_bits):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), f"http://a/{k}", rng.choice([None, "", "é" * 50, "ab", "x" * 4000, f"own {k} " * rng.randint(1, 400)])) for k in range(120)] + [(None, "u", "null keys only")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.read_archives(warc.archived(pages, archive_bytes=3000, filter_bits=filter_bits), window=500).collect()
    low: dict = {}
    for i, _, h in rows:
        low.setdefault(h or "", []).append(i)
    low = {h: min((i for i in ids if i is not None), default=None) for h, ids in low.items()}

    def told(i, h):
        body = (h or "").encode()
        again = low[h or ""] is not None and i != low[h or ""]
        return i, len(body), warc.sha1_base32(body), "revisit" if again else "response", low[h or ""] if again else None

    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(str(told(i, h)) for i, _, h in rows)


def test_zip64_end_records_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"0123456789" * 5)
        z.writestr("second", b"abc" * 20)
    data = path.read_bytes()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data  # the ZIP64 end record and its locator
    archive = ZipRanges(lambda a, n: data[a : a + n], len(data))
    assert archive.read("first", 8, 4) == b"8901" and archive.read("second") == b"abc" * 20
    full = bytearray(data)
    end = data.rindex(b"PK\x05\x06")
    full[end + 8 : end + 20] = b"\xff" * 12  # all fields of the end record say: look in the ZIP64 record
    assert ZipRanges(lambda a, n: bytes(full[a : a + n]), len(full)).read("second", 1, 2) == b"bc"


def plain_features(url):
    """The lexical features read literally; host and path as the contract says."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    shares = [url.count(c) / len(url) for c in set(url)]
    return {
        "url_length": len(url),
        "host_length": len(host),
        "path_length": len(path),
        "depth": sum(1 for x in path.split("/") if x),
        "labels": len(host.split(".")) if host else 0,
        "digit_ratio": sum(c in "0123456789" for c in url) / len(url) if url else 0,
        "entropy": -sum(s * math.log2(s) for s in shares),
        "parameters": sum(1 for x in query.split("&") if x),
        "hyphens": host.count("-"),
        "secure": url.startswith("https://"),
    }


def test_url_features_equal_a_plain_reading(spark):
    urls = [None, "", "no scheme", "http://A-b.c.org/x/yy//z?a=1&b=2&&#f", "https://1.2.net", "https://h/é/日?q", "http://a?x&y", "http://a-b-c.d/%20/9/8?=#?z=1"]
    host, path = url_filter.parts("url")
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id int, url string").withColumns({"host": host, "path": path})
    for r in url_filter.lexical(rows, "url", "host", "path").collect():
        for name, want in plain_features(urls[r.id]).items():
            assert float(r[name]) == pytest.approx(float(want)), (urls[r.id], name)


def test_url_verdicts_learn_from_labels_however_often_a_url_repeats(spark):
    good, bad = ([f"https://{h}.org/{p}/{k}" for k in range(60)] for h, p in (("good", "read"), ("bad-77-88", "x1/y2/z3")))
    labelled = spark.createDataFrame([(u, 0) for u in good] + [(u, 5) for u in bad] + [(bad[0], 5)] * 500 + [("http://null", None)], "url string, label int")
    pages = spark.createDataFrame([(0, "https://good.org/read/1000"), (1, "https://bad-77-88.org/x1/y2/z3/1000")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, labelled, trees=3, depth=2, most_rows=100).collect()}
    assert (got[0].verdict, got[1].verdict) == ("allow", "block") and got[0].rule is None and got[0].blocked < 0.5 < got[1].blocked


def test_slots_of_fingerprints_are_not_broadcast(spark, tmp_path):
    from cohortry.llm import simhash

    spark.range(5_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    near = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
