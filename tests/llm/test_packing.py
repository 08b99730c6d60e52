"""Best-fit packing against the tokenizer library and an item-by-item packer."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vertebra.llm import packing, queries

from .test_operators import AWKWARD, DOCS, SF, rows

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def one_by_one(lengths, capacity):
    """Gap left in each sequence, by the same rules on single items."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        partner = next((i for i, m in enumerate(large) if m <= capacity - n), None)
        gaps.append(capacity - n - (large.pop(partner) if partner is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return gaps


def places(counts, capacity):
    """{(length, rank): (sequence, offset)} of a plan."""
    plan, n = packing.plan(counts, capacity)
    found = {}
    for length, first, sequences, copies, sequence, offset in plan.tolist():
        for i in range(sequences * copies):
            assert (length, first + i) not in found
            found[length, first + i] = (sequence + i // copies, offset + i % copies * length)
    return found, n


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_item_by_item_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 31, 64, 100])
    top = rng.choice([capacity, capacity // 3, capacity // 2])
    lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 120))]
    counts = collections.Counter(lengths)
    found, n = places(counts, capacity)
    assert collections.Counter(k for k, _ in found) == counts
    filled = collections.defaultdict(list)
    for (length, _), (sequence, offset) in found.items():
        filled[sequence].append((offset, length))
    assert sorted(filled) == list(range(n))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2
    gaps = one_by_one(lengths, capacity)
    assert sorted(capacity - sum(x for _, x in p) for p in filled.values()) == sorted(gaps)


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(0)
    base = {int(n): int(c) for n, c in zip(range(1, 4097), rng.integers(0, 50, 4096))}
    small, n = packing.plan(base)
    large, m = packing.plan({k: 10**6 * c for k, c in base.items()})
    assert len(large) < 2 * len(small) + 4096 and m <= 10**6 * n
    assert m >= -(-sum(10**6 * k * c for k, c in base.items()) // 4096)


def test_matching_pairs_the_large_items():
    # 60 + 40, 55 + 45, 50 + 50: a partner too long for the first is left for the next
    assert packing.plan({60: 1, 55: 1, 50: 2, 45: 1, 40: 1}, 100)[1] == 3


def test_ids_equal_the_library(library):
    enc = packing.Encoder(PATH)
    rng = random.Random(2)
    texts = ["", " ", "It's DON'T we'll", "ÄÖ é  x y\x1cz\x85w", "a\x0bb\x0cc", "<|endoftext|> <|x|>", "漢字 123 😀!!! ΣΑΣ",
             "".join(rng.choices("ab'stl \n\t　é́ß1!Σ", k=4000))]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x300, 0x2100), 32, 10))) for _ in range(300)) for _ in range(50)]
    usual = [chr(c) for c in range(1, 0x180)] + [" ", "'", "s", "T", "\n"] * 20
    texts += ["".join(rng.choices(usual, k=300)) for _ in range(200)] + ["".join(chr(c) + "a " for c in range(1, 0x250))]
    texts += ["".join(rng.choices([c for c in usual if c >= " "], k=40)) for _ in range(500)]
    for t, ids in zip(texts, enc.encode(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert np.frombuffer(b"".join(enc.slices(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_slices_and_forgotten_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "_SLICE", 50)
    monkeypatch.setattr(packing, "_TOKENS", 40)
    monkeypatch.setattr(packing, "_WORDS", 30)
    rng = random.Random(3)
    for letters in ("abcdé", "abcΣ"):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(800))
        enc = packing.Encoder(PATH)
        assert np.frombuffer(b"".join(enc.slices(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(enc.tokens) <= 40 and len(enc.words) <= 30


def check(df, table, library):
    """Every piece of every row, cut from the library's ids, in gapless sequences of 4096 at most."""
    want = collections.Counter()
    for row in table:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k: k + 4096], "<u4")
            want[row[0], k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = rows(df)
    assert collections.Counter(r[:5] for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r[5]].append((r[6], r[3]))
    lengths = [r[3] for r in got]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) == len(one_by_one(lengths, 4096))
    return filled


def test_whole_tables(spark, library):
    docs = queries.read(spark, SF, "documents")
    check(queries.QUERIES["op12_large_item_matching"](spark, SF), rows(docs.select("doc_id", "text")), library)
    check(packing.op12(spark.createDataFrame(AWKWARD, DOCS).repartition(3)), AWKWARD, library)
    assert rows(packing.op12(spark.createDataFrame([], DOCS))) == []


def test_sequences_hold_their_documents_ids(spark, library):
    docs = queries.read(spark, SF, "documents").select("doc_id", "text")
    packed = packing.pack(packing.stash(packing.tokenise(docs, PATH), "test-pieces"))
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert held[r["sequence_id"]][r["offset"]: r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    assert sum(map(len, held.values())) == packed.agg({"length": "sum"}).first()[0]
