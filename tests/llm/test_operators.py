"""The corpus operators against brute force on small and awkward tables."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from vertebra.llm import bpe, hmm, langid, maxscore, mixing, neardup, quality, queries, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size long"
#: Nulls in every column, empty and white texts, a long text, ties, repeated rows, clashing names.
AWKWARD = [
    (1, None, "en", "a", 0, "x", 7), (2, "", None, "a", 0, None, None), (3, " \n\t ", "en", None, 3, "x", 1),
    (4, "One two three", "en", "a", 1, "x", 1), (5, "one two three", "de", "b", 1, "x", 1),
    (6, "a b c d e f g h i j k", "en", "a", 1, "x", 1), (6, "a b c d e f g h i j k", "en", "a", 1, "x", 1),
    (None, "a b c d e f g h i j k", "en", "a", 1, "x", 1), (7, "A b c d e f g h i j k l", "fr", "b", 1, "x", 1),
    (8, "word " * 30_000, "en", "b", 1, "x", 1), (9, "ß漢字 ' 'll !!! 123", "de", "b", 1, "x", 1), (10, "12 34 ... !!", "en", "a", 1, "x", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return queries.read(spark, SF, "documents")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_shards_balance_and_keep_equal_texts(spark, docs, awkward, empty):
    for table, n in ((docs, docs.count()), (awkward, len(AWKWARD))):
        out = sharding.op1(table).collect()
        assert len(out) == n
        slots = collections.defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 24 for s in slots)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    of, load = collections.defaultdict(set), collections.Counter()
    for r in sharding.op1(docs).collect():
        of[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert all(len(s) == 1 for s in of.values())
    mean = sum(load.values()) / 24
    largest = max(sum(len(t.encode()) + 8 for t in text.values() if t == x) for x in of)
    assert max(load.values()) <= max(1.05 * mean, largest)
    assert rows(sharding.op1(empty)) == []


def test_differencing_beats_its_largest_item():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 10_000) for _ in range(500)), reverse=True)
    load = np.bincount(sharding.difference(sizes, 8), weights=sizes, minlength=8)
    assert np.ptp(load) <= 20 and load.sum() == sum(sizes)
    base = [0, 90_000, 0, 5_000]
    load = np.bincount(sharding.difference(sizes, 4, base), weights=sizes, minlength=4) + base
    assert np.ptp(load) <= 20


def test_mix_follows_weights(spark, docs, awkward, empty):
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"),
                                    F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("copy"))
    out = collections.Counter(r["source"] for r in mixing.poisson_mix(many, weights).select("source").collect())
    assert 2800 < out["a"] < 3200 and 900 < out["b"] < 1100
    got = mixing.poisson_mix(docs).select("doc_id", "copy", "shuffle_key").collect()
    assert len(set(got)) == len(got) and got == mixing.poisson_mix(docs).select("doc_id", "copy", "shuffle_key").collect()
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert {r["source"] for r in mixing.poisson_mix(awkward, epochs=20.0).collect()} <= {"a", "b", None}
    assert rows(mixing.poisson_mix(empty)) == []


def test_mix_takes_any_column_names(spark):
    names = ["cdf", "parts", "_source", "_salt", "_salt_of", "_times", "_cdf", "PARTS_", "mean", "bytes", "weight"]
    plain = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    more = plain.select("*", *[F.lit(c).alias(c) for c in names])
    want = collections.Counter(rows(mixing.poisson_mix(plain, epochs=2.0).select("doc_id", "copy", "rate", "shuffle_key")))
    got = mixing.poisson_mix(more, epochs=2.0)
    assert got.columns == ["doc_id", "text", "source", *names, "rate", "copy", "shuffle_key"]
    assert collections.Counter(rows(got.select("doc_id", "copy", "rate", "shuffle_key"))) == want and len(want) > 400
    assert rows(got.select(*names).distinct()) == [tuple(names)]


def test_salted_mix_equals_the_broadcast_one(spark, docs, monkeypatch):
    columns = ["doc_id", "source", "copy", "rate", "shuffle_key"]
    want = rows(mixing.poisson_mix(docs).select(*columns))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows(mixing.poisson_mix(docs).select(*columns)) == want  # in the same order


def test_top_k_keeps_every_row_of_a_repeated_id(spark):
    data = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 9.0]), (50, [0.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(maxscore.op3(df).orderBy("query_id", "rank"))
    pairs = sorted((-int(65536 * (np.array(q) @ np.array(v))), i) for j, q in data for i, v in data if j == 50 and i != 50)[:5]
    assert got == [(50, n + 1, i, -s) for n, (s, i) in enumerate(pairs)]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    rng = np.random.default_rng(9)
    many = data + [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 150, 400), rng.normal(0, 0.4, (400, 2)))]
    many += [(7, [3.0, 3.0])] * 300 + [(100, [0.25, 0.5])] * 3  # a hot id, a query that is there three times
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", many)
    want = con.execute(maxscore.SQL_OP3).fetchall()
    df = spark.createDataFrame(many, "vec_id long, embedding array<float>")
    got = rows(maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=40, block_rows=3))
    assert sorted(got) == sorted(want)


def test_heaviest_thins_the_last_step(spark):
    from vertebra.llm.common import heaviest

    flat = spark.range(10_000).select(F.col("id").alias("w"), F.when(F.col("id") < 100, 7).otherwise(3).alias("p"))
    got = [r["w"] for r in heaviest(flat, "p", 1100, "w").collect()]
    assert set(range(100)) <= set(got) and 1000 < len(got) < 1200
    assert sorted(got) == sorted(r["w"] for r in heaviest(flat.repartition(3), "p", 1100, "w").collect())
    assert heaviest(flat, "p", 10_000, "w").count() == 10_000 and heaviest(flat.limit(0), "p", 5, "w").count() == 0
    assert 20 < heaviest(flat, "p", 50, "w").count() < 80


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (700, 16)))]
    data += [(1000 + i, data[50][1]) for i in range(8)]  # ties
    data += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 16), (2150, [float("inf")] * 16), (2200, [0.5]), (50, data[50][1]), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(rows(maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=5)))
    ints = [(i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (0, 16 - len(v)))) for i, v in data
            if i is not None and v and None not in v and np.isfinite(v).all()]  # row by row: 50 is there twice
    want = []
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        best = sorted((-int(mine @ v), i) for j, mine in ints if j == q for i, v in ints if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert rows(maxscore.op3(df.limit(0))) == []


def brute_components(data):
    sets, parent = {}, {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates_equal_brute_force(spark, docs, awkward, empty, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    data = [(i, " ".join(w if rng.random() > 0.02 * (i % 4) else f"x{rng.randint(0, 99)}" for w in base)) for i in range(90)]
    data += [(100 + i, " ".join(f"y{rng.randint(0, 5)}" for _ in range(rng.randint(1, 30)))) for i in range(60)]
    data += [(r["doc_id"] + 1000, r["text"]) for r in docs.collect()]
    for name in ("STAR", "BLOCK", "OUTSIDE", "SIDE"):  # small blocks take every path
        monkeypatch.setattr(neardup, name, 7)
    monkeypatch.setattr(neardup, "MORE", 2)
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).drop("row", "component")
    assert sorted(rows(got)) == brute_components(data)
    out = rows(neardup.near_duplicates(awkward).drop("row", "component"))
    assert len(out) == len(AWKWARD) and (None, 7, None, True) in out and out.count((6, 7, 6, True)) == 2
    assert (7, 8, 6, False) in out and (5, 1, 4, False) in out and (1, 0, 1, True) in out
    assert rows(neardup.near_duplicates(empty)) == []


def test_crowded_buckets_leave_no_pair_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(neardup, "OUTSIDE", 7)
    sigs = rng.integers(0, neardup.CIRCLE, (40, neardup.COORDS)).astype(np.uint32)
    sigs[1] = sigs[0]
    sigs[1, 7::4] += 1  # 97 coordinates of 128 agree, but of all bands only the first
    sigs[3] = sigs[2]
    sigs[3, 4::8] += 1  # twos and bands are hit differently: 112 agree
    sigs[5] = sigs[4]
    sigs[5, 74:] += 1  # 74 agree, one after the other
    sigs[:, :4] = 9
    nodes = spark.createDataFrame([(i, 100, neardup.band_keys(s).tolist(), bytearray(s.astype(np.uint8).tobytes())) for i, s in enumerate(sigs)],
                                  "node long, n long, keys array<long>, sig binary")
    members = nodes.select(F.col("keys")[0].alias("bkey"), "node", F.col("node").alias("comp"), F.col("node").alias("cur"), "n", F.lit(None).cast("int").alias("band"), F.lit(-1).alias("last"))
    assert sorted(rows(neardup._asks(members, nodes, 2, 1, None))) == [(0, 1, False), (2, 3, False), (4, 5, False)]
    asked = spark.createDataFrame([(0, [1]), (2, [7])], "node long, asked array<long>")
    assert sorted(rows(neardup._asks(members, nodes, 2, 1, asked))) == [(2, 3, False)]  # 4 has asked all, 0 its only one


def test_asks_grow_with_members_not_with_pairs():
    """All near copies of one text, each a component of its own: a member asks as many as the limit."""
    import pandas as pd
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 255, neardup.COORDS).astype(np.uint8)
    for n in (50, 200, 800):
        own = [np.where(rng.random(neardup.COORDS) < 0.1, 255, sig).astype(np.uint8).tobytes() for _ in range(n)]
        pdf = pd.DataFrame({"node": range(n), "comp": range(n), "cur": range(n), "n": 100, "asks": True, "outside": True, "sig": own, "asked": [None] * n})
        out = neardup._matches(1)(pdf)
        assert len(out) == n - 1 and out["more"].sum() == n - 2
        # what was asked before is not asked again, and without a limit every pair has its turn
        pdf["asked"] = [out["comp"][out["b"] == i].tolist() or None for i in range(n)]
        rest = neardup._matches(n)(pdf)
        assert len(rest) == n * (n - 1) // 2 - (n - 1) and not rest["more"].any()


def test_steps_give_out_members_not_pairs(spark, monkeypatch):
    """Near copies that share buckets, hardly any of them linked: what is looked at and what is
    given out are rows of members of the 32 buckets, twice at most, and no link is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    data = [(i, " ".join(w if rng.random() > 0.035 else f"x{rng.randint(0, 10**6)}" for w in base)) for i in range(120)]
    data += [(500 + i, data[i][1] + " end") for i in range(0, 40, 3)]
    counts: dict[str, list[int]] = {}

    def counting(df, name, stash=neardup.stash):
        out = stash(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "stash", counting)
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).drop("row", "component")
    assert sorted(rows(got)) == brute_components(data)
    assert len(counts["dedup-open"]) <= 2 and sum(counts["dedup-open"]) <= 2 * neardup.BANDS * len(data)
    assert len(counts["dedup-asks"]) == 1 and counts["dedup-asks"][0] <= neardup.BANDS * len(data)
    assert counts["dedup-met"][0] > 0


def test_crowded_buckets_are_compared_whole_and_pairs_once(spark, monkeypatch):
    """Near copies of one text, few of them linked, in buckets beyond the bound of a block: rows
    do not multiply, no link is lost, and two that share several buckets meet in the first."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    data = [(i, " ".join(w if rng.random() > 0.035 else f"x{rng.randint(0, 10**6)}" for w in base)) for i in range(60)]
    data += [(500 + i, data[i][1] + " end") for i in range(0, 40, 3)]
    for name in ("OUTSIDE", "BLOCK"):
        monkeypatch.setattr(neardup, name, 7)
    counts: list[int] = []

    def counting(df, name, stash=neardup.stash):
        out = stash(df, name)
        if name == "dedup-open":
            counts.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stash", counting)
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).drop("row", "component")
    assert sorted(rows(got)) == brute_components(data)
    assert len(counts) <= 2 and sum(counts) <= 2 * neardup.BANDS * len(data)


def test_a_pair_meets_in_its_first_common_bucket():
    import pandas as pd
    sig = np.arange(neardup.COORDS, dtype=np.uint32)
    sigs = np.stack([sig, sig, sig])
    sigs[1, [1, 5]] += 1  # bands 0 and 1 differ, 126 coordinates agree
    sigs[2, 60:] += 1  # too few agree
    keys = neardup.band_keys(sigs)
    assert (keys == np.stack([neardup.band_keys(s) for s in sigs])).all()
    pdf = pd.DataFrame({"node": range(3), "comp": range(3), "cur": range(3), "n": 100, "asks": True, "outside": True,
                        "sig": [s.astype(np.uint8).tobytes() for s in sigs], "asked": [None] * 3, "keys": list(keys), "g": 0, "s": 0, "cell": 0})
    buckets = pd.concat([pdf.assign(bkey=keys[0, band]) for band in (2, 3, 9)])
    out = neardup._each(neardup._matches(1))(buckets)
    assert out[["b", "comp"]].to_numpy().tolist() == [[0, 1]]


def test_sets_of_texts_hashed_together_are_those_of_each():
    texts = ["a b c d e f g", None, "", "a", "A  b\tc\nd", "É é ü a b", "x " * 40, "a\x00b c\x1cd \x0be f g h"] * 3
    many = neardup.shingle_sets(texts)
    assert [len(s) for s in many[:8]] == [3, 0, 0, 1, 1, 1, 1, 2]
    assert all((a == neardup.shingle_set(t)).all() and (a[1:] > a[:-1]).all() for t, a in zip(texts, many))


def test_members_that_meet_give_out_a_forest():
    import pandas as pd
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    for n in (20, 60):
        texts = [" ".join(w if rng.random() > 0.012 else f"x{rng.randint(0, 10**6)}" for w in base) for _ in range(n)]
        texts.append(" ".join(base[:40]))  # a candidate of nobody
        sets = [neardup.shingle_set(t) for t in texts]
        sigs = [neardup.signature(s, neardup._windows()).astype(np.uint8).tobytes() for s in sets]
        pdf = pd.DataFrame({"node": range(n + 1), "comp": range(n + 1), "cur": range(n + 1), "n": [len(s) for s in sets], "asks": True, "outside": True,
                            "sig": sigs, "asked": [None] * (n + 1), "text": texts})
        met = neardup._partners(pd.concat([pdf, pdf.assign(asks=False)]))
        assert met["node"].is_unique and n not in set(met["node"])
        links = neardup._settle(met)
        pairs = [(a, b) for a in range(n + 1) for b in range(a) if neardup._linked(sets[a], sets[b])]
        together = pd.Series(range(n + 1))
        for a, b in pairs:
            together[together == together[a]] = together[b]
        assert len(links) == n + 1 - together.nunique() < len(pairs) and all(neardup._linked(sets[a], sets[b]) for a, b in links.to_numpy())


def test_one_of_each_equals_brute_force(spark, docs):
    """A stage that loses one clean row, or leaves one copy, fails."""
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(i for i, _, _, kept in brute_components(table) if kept)
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs).collect()) == want


def test_rows_of_one_id_are_judged_by_their_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    data = [(3, base), (5, base + " end"), (5, "something else altogether with words of its own")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(rows(got.drop("row", "component"))) == [(3, 56, 3, True), (5, 4, 5, True), (5, 57, 3, False)]
    more = data + [(6, base)] * 3 + [(None, base)] * 2 + [(8, ""), (8, ""), (9, None), (5, "something else altogether with words of its own"), (2, "short"), (2, "other"), (1, "Short")]
    kept = sorted(rows(neardup.one_of_each(spark.createDataFrame(more, "doc_id long, text string"))), key=str)
    assert kept == sorted([(3, base), (5, data[2][1]), (None, base), (8, ""), (9, None), (2, "other"), (1, "Short")], key=str)


def test_a_worker_lets_go_what_another_operator_kept():
    """A worker that went from bpe to near-dedup kept the ids of 250 000 pre-tokens for good."""
    import gc
    import weakref

    import public_tokenizers
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoder(path, pattern)
    assert bpe.encoder(path, pattern) is enc  # kept from task to task
    ids, gone = enc.encode("some words, and some more"), weakref.ref(enc)
    del enc
    assert bpe.decode_ids(ids, path) == b"some words, and some more" and gone() is not None
    assert len(neardup.shingle_set("one two three four five six")) == 2
    gc.collect()
    assert gone() is None
    kept = neardup._fingerprints()
    assert neardup._fingerprints() is kept and len(kept) == 6
    assert bpe.encoder(path, pattern).encode("some words, and some more") == ids


def test_archives_round_trip(spark, tmp):
    body = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    data = [(3, "http://a.b/c d", body), (1, "http://a.b/\n", body), (2, None, "short"), (4, "u", "short"), (5, "u", None),
            (None, "u", body), (6, "u", "ß漢" * 100), (6, "u", "ß漢" * 100)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = sorted(rows(warc.op5(pages)), key=str)
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), *(("revisit", 1) if i in (3, None) else ("response", None))) for i, _, h in data]
    assert out == sorted(want, key=str)
    warc.write_archives(pages, tmp + "/w")
    captures = warc.assemble(warc.read_archives(spark, tmp + "/w")).collect()
    assert len(captures) == len(data) and all(c["request"] and c["response"] and c["metadata"] for c in captures)
    assert sorted(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["payload"] is not None) == sorted(
        h or "" for i, _, h in data if i not in (3, None))
    assert rows(warc.op5(pages.limit(0))) == []


def test_small_evidence_makes_nothing_toxic(spark):
    """Few positives, no telling word: the prior alone condemns no text."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert all(r["score"] < toxicity.THRESHOLD for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())


@pytest.mark.parametrize("n_words", [10, 1000, 12_000])
def test_long_positives_do_not_turn_the_order_round(spark, n_words):
    """Three positives that share many words: plain texts stay under the threshold."""
    shared = " ".join(f"w{i}" for i in range(n_words))
    docs = spark.createDataFrame([(i, shared) for i in range(3)] + [(3 + i, f"a plain text of its own p{i} q{i % 7}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(0, 63)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(out[i] < toxicity.THRESHOLD for i in range(3, 63))
    assert min(out[i] for i in range(3)) > max(out[i] for i in range(3, 63))


def test_risk_and_gradient_against_finite_differences(monkeypatch):
    """train_nnpu ends where the non-negative risk, written out plainly, is no larger than at the start,
    and the gradient it follows is that of the written-out risk."""
    rng = np.random.default_rng(0)
    pos = [np.unique(rng.integers(0, 6, 4)) for _ in range(30)]
    unl = [np.unique(rng.integers(0, 12, 4)) for _ in range(120)]
    values, prior = np.ones(12), 0.2

    def risk(w):
        fp, fu = (np.array([w[d].sum() + w[-1] for d in docs]) for docs in (pos, unl))
        clean = np.mean(np.log1p(np.exp(fu))) - prior * np.mean(np.log1p(np.exp(fp)))
        return prior * np.mean(np.log1p(np.exp(-fp))) + max(0.0, clean)

    start = np.append(np.zeros(12), np.log(prior / (1 - prior)))
    one = toxicity.train_nnpu(pos, unl, values, prior, steps=1, l1=0.0)
    moved = np.sign(one[:-1])  # the first step of Adam goes against the gradient's sign
    for i in range(12):
        at = [start.copy(), start.copy()]
        at[0][i] -= 1e-5
        at[1][i] += 1e-5
        slope = (risk(at[1]) - risk(at[0])) / 2e-5
        if abs(slope) > 1e-4:
            assert moved[i] == -np.sign(slope)
    end = toxicity.train_nnpu(pos, unl, values, prior)
    end[-1] = min((risk(np.append(end[:-1], b)), b) for b in np.linspace(-6, 6, 200))[1]
    assert risk(end) < risk(start)
    assert end[:6].mean() > end[6:12].mean()


def test_toxicity_learns_and_scores_all(spark, awkward, empty):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    data = [(i, " ".join(rng.choices(plain, k=40) + (["awful"] if i % 8 == 0 else []))) for i in range(1600)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1600, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.op6(docs, labels).collect()}
    wrong = sum(r["predicted"] != int(i % 8 == 0) for i, r in out.items())
    assert len(out) == 1600 and wrong <= 16
    assert len(rows(toxicity.op6(awkward, labels))) == len(AWKWARD) and rows(toxicity.op6(empty, labels)) == []
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in toxicity.op6(awkward, labels.limit(0)).collect())


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_bpe_equals_the_library_and_round_trips(spark, docs, awkward, empty, enc):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    for table in (docs, awkward):
        out = collections.Counter(rows(bpe.op7(table)))
        want = collections.Counter()
        for r in table.collect():
            text = r["text"] or ""
            ids = library.encode_ordinary(text)
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert out == want
    assert rows(bpe.op7(empty)) == []
    assert base64.b64encode(bpe.decode_ids(enc.encode("ab c"), P.path("byte_bpe_50k.tiktoken"))) == base64.b64encode(b"ab c")


def test_stitched_chunks_equal_one_pass(enc):
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice(["'", "s", "'re", "ll", " ", "  ", "\n", "a", "ß", "1", "22", "!", "漢"]) for _ in range(rng.randint(1, 120)))
        size, overlap = rng.randint(1, 30), rng.randint(0, 12)
        cut = [(s, text[s:s + size + overlap]) for s in range(0, len(text), size)]
        assert bpe.stitch(enc, [(s, len(t), t, *enc.chunk(t)) for s, t in cut]) == enc.encode(text)


def test_chunks_go_without_their_text_where_an_overlap_is_sure(spark, enc):
    """Small chunks of texts with and without white space, with and without the pattern of sure places."""
    rng = random.Random(2)
    parts = ["'", "s", "'re", "ll", " ", "  ", "\n", "a", "ß", "1", "22", "!", "漢", "word", "word "]
    data = [(i, "".join(rng.choices(parts[: rng.choice([4, 9, 15])] + ["x"] * rng.randint(0, 9), k=rng.randint(1, 90)))) for i in range(400)]
    data += [(500, "x" * 300), (501, " " * 300), (502, "a b" * 100 + "y" * 100 + " z" * 50), (500, "x" * 299), (None, "a b c " * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    path, want = P.path("byte_bpe_50k.tiktoken"), sorted((str(i), enc.encode(t)) for i, t in data)
    for chunk, overlap, sure in ((20, 8, bpe.SURE), (7, 5, bpe.SURE), (20, 8, None)):
        got = bpe.encode(df, path, P.PATTERN, chunk, overlap, sure).collect()
        assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want


def test_forgotten_pre_tokens_change_nothing(enc, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 16)
    small = bpe.Encoder(enc.ranks, P.PATTERN)
    rng = random.Random(4)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcdeß1", k=rng.randint(1, 6))) for _ in range(40))
        assert small.encode(text) == enc.encode(text)
    assert len(small) <= 16


def test_language_code_lengths_equal_a_tree_walk():
    langs, data = ["a", "b"], [[b"abcabcabd", b"xyz"], [b"bcbcbc zz", b"q"]]
    code = [langid._codes(d) for d in data]
    lang = np.repeat([0, 1], [len(c) for c in code])
    keys, where = np.unique(np.stack([np.concatenate(code), lang]), axis=1, return_inverse=True)
    model = langid.Model(langs, keys[0], keys[1], np.bincount(where.ravel()).astype(float))

    def bits(seen, text):
        counts = collections.defaultdict(collections.Counter)
        for t in seen:
            padded = [256] * langid.ORDER + list(t)
            for i, x in enumerate(t):
                for k in range(langid.ORDER + 1):
                    counts[tuple(padded[i + langid.ORDER - k:i + langid.ORDER])][x] += 1
        total, padded = 0.0, [256] * langid.ORDER + list(text)
        for i, x in enumerate(text):
            # a context never crosses the start more than once: one pad ends it
            context = tuple(padded[i:i + langid.ORDER])
            cost, done = 0.0, False
            for k in range(langid.ORDER, -1, -1):
                c = counts.get(context[langid.ORDER - k:])
                if c is None:
                    continue
                n, d = sum(c.values()), len(c)
                if x in c:
                    cost, done = cost - np.log2(c[x] / (n + d)), True
                    break
                cost -= np.log2(d / (n + d))
            total += cost + (0 if done else 8.0)
        return total

    for text in (b"abcabd", b"zzbc q", b"?", b"xyzabc"):
        got = model.bits([text, b"", text])
        assert np.allclose(got[0], [bits(d, text) for d in data], atol=1e-3) and np.allclose(got[0], got[2], atol=1e-6) and not got[1].any()


def test_language_of_awkward_rows(spark, docs, awkward, empty):
    out = {r["doc_id"]: r for r in langid.op8(docs.withColumn("score", F.lit(1))).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in out.items() if r["held_out"]]
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    odd = langid.op8(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (1, 2, 3, 10))
    assert rows(langid.op8(empty)) == []
    assert {r["lang_pred"] for r in langid.op8(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    rng = random.Random(4)
    words = {x: ["".join(rng.choices(x, k=rng.randint(3, 6))) for _ in range(40)] for x in ("abcd", "efgh", "ijkl")}
    say = lambda x: " ".join(rng.choices(words[x], k=30))
    data = [(i, say("abcd" if i % 2 else "efgh"), "x" if i % 2 else "y") for i in range(6000)] + [(9000 + i, say("ijkl"), "rare") for i in range(3)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=200)
    assert model.langs == ["rare", "x", "y"]
    assert model.bits([say(x).encode() for x in words]).argmin(axis=1).tolist() == [1, 2, 0]
    monkeypatch.setattr(langid, "GRAMS", 300)  # the commonest n-grams of all are those of x and y
    monkeypatch.setattr(langid, "LEAST_GRAMS", 100)
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.langs == ["rare", "x", "y"]
    assert model.bits([say(x).encode() for x in words]).argmin(axis=1).tolist() == [1, 2, 0]
    same = [(None, "abc abd", "x")] * 900 + [(None, "zzz yyy", "z")] * 900 + [(7, "", "w")]  # one draw for all rows of a language
    assert langid.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"), sample=2).langs == ["x", "z"]
    many = [(i, f"text {i}", f"l{i:03}") for i in range(300)]
    assert len(langid.fit(spark.createDataFrame(many, "doc_id long, text string, lang string")).langs) == 300
    assert langid.level([1, 5, 1000, 1000], 100, 10) == 47 and langid.level([5, 5, 5], 6, 3) == 3 and langid.level([4, 5], 90, 3) == 5


def test_forward_and_backward_equal_enumeration():
    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    data = [np.array(x, np.uint16) for x in ([0, 1, 2, 1], [2], [1, 1, 0], [0, 2, 2, 2])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for r, got in zip(data, hmm.log_likelihood(m, data)):
        total, parts = 0.0, []
        for path in np.ndindex(*[2] * len(r)):
            p = m.start[path[0]] * m.emit[path[0], r[0]]
            for a, b, x in zip(path, path[1:], r[1:]):
                p *= m.move[a, b] * m.emit[b, x]
            total += p
            parts.append((path, p))
        assert np.isclose(got, np.log10(total))
        for path, p in parts:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for a, x in zip(path, r):
                emit[a, x] += p / total
    for got, want in zip(hmm.expected(m, data), (start, move, emit)):
        assert np.allclose(got, want)


def test_model_scores(spark, docs, awkward, empty):
    out = {r["doc_id"]: r for r in hmm.op9(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in out}
    tokens = {r["doc_id"]: r["text"].encode().lower().split() + [hmm.END] for r in docs.collect()}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert np.isclose(r["base_score"], sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r["score"] for i, r in out.items() if held[i]) > sum(r["base_score"] for i, r in out.items() if held[i])
    odd = hmm.op9(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in odd)
    assert rows(hmm.op9(empty)) == []


def test_quality_measures_equal_brute_force(spark, docs, awkward, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def brute(text):
        w, where, hit, seen, dup = word.findall(text or ""), collections.defaultdict(list), set(), set(), 0
        for i in range(len(w) - 4):
            where[tuple(w[i:i + 5])].append(i)
        for at in where.values():
            if len(at) > 1:
                hit.update(j for i in at for j in range(i, i + 5))
        for line in (text or "").split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)

    for table in (docs, awkward):
        got = collections.Counter(tuple(r)[:7] for r in quality.op10(table).collect())
        want = collections.Counter()
        for r in table.collect():
            m = brute(r["text"])
            want[r["doc_id"], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]] += 1
        assert got == want
    assert all(not (r["base_failed"] and r["kept"]) for r in quality.op10(docs).collect())
    assert rows(quality.op10(empty)) == []


def test_estimate_trusts_precise_rules():
    good, one, two = "2" * 7, "0" + "2" * 6, "2200022"
    post = quality.estimate({good: 800, one: 60, two: 60})
    assert post[good] > 0.9 and post[one] < 0.5 and post[two] < 0.5 and quality.estimate({}) == {}


def test_estimate_follows_the_documents():
    good, few, symbols, repeats, shouts = "2222222", "2222220", "0222222", "2202222", "2200022"
    # shares of bad documents from 1 in 200 to two thirds, rules that fire together, any size
    for times in (0.05, 1, 5, 20):
        for size in (0.1, 1, 1000):
            counts = {good: 8000 * size, few: 136 * size} | {k: v * times * size for k, v in ((symbols, 650), (repeats, 240), (shouts, 330))}
            post = quality.estimate(counts)
            assert post[good] > 0.8 and post[few] > 0.5 and max(post[symbols], post[repeats], post[shouts]) < 0.2, (times, size)
    # the documents overrule the start: what only ever fires with a precise rule is found without it
    alone = quality.estimate({good: 8000, "2222202": 30})["2222202"]
    assert quality.estimate({good: 8000, "2222202": 30, "0222202": 3000})["2222202"] < alone - 0.1


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs, seen = queries.read(spark, sf, "documents"), []
    for name, stage in c.STAGES[:3]:
        docs = c.stash(stage(spark, docs, sf), "test-" + name)
        assert docs.columns == list(c.COLUMNS)
        seen.append(docs.count())
    assert 1000 > seen[0] >= seen[1] > seen[2] > 700
    left = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(kept for *_, kept in left)
    final = c.run(spark, sf)
    assert set(final.columns) >= {"doc_id", "n_tokens", "ids", "ids_sha256"} and final.count() > 500
    assert os.path.basename(c.__file__) == "corpus_pipeline.py"


def test_pipeline_tokens_take_one_python_worker_a_task(spark, awkward, enc):
    """Encoding and decoding in one task held two workers, and all of them stayed for the session."""
    import corpus_pipeline as c

    got = c.tokens(spark, awkward, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|MapInPandas|GroupsInPandas|EvalPython", plan)) == 1
    want = [(r[0], enc.encode(r[1] or "")) for r in AWKWARD]
    assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == collections.Counter(
        (i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for (i, ids), r in zip(want, AWKWARD))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    assert len(want) and collections.Counter(rows(queries.QUERIES[name](spark, SF).select(*columns))) == collections.Counter(want)
