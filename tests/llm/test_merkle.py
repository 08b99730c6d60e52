"""The Merkle manifest against plain Python and DuckDB."""

import hashlib
import random
import zlib

import duckdb
import pytest

from vertebra.llm import merkle, queries

from .test_operators import AWKWARD, DOCS, SF, rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(hashes):
    """Root, and each node's siblings from the bottom up as (left, right)."""
    paths = [[] for _ in hashes]
    at, level = list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            left, right = (level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else "")
            paths[leaf].append((left, right))
        level = [H(*level[i: i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def brute(table):
    """The contract on (doc_id, text, lang, source, n_chars, ...) rows."""
    found, langs = [], {}
    for row in table:
        doc_id, text, lang, source, n_chars = row[:5]
        hash_of = lambda n: H(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        more = n_chars + 1 if hit and n_chars is not None else n_chars
        langs.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), hash_of(n_chars), hash_of(more), doc_id))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([leaf[1] for leaf in sorted(langs[x])]) for x in order}
    root, high = grow([trees[x][0] for x in order])
    for x, above in zip(order, high):
        for leaf, path in zip(sorted(langs[x]), trees[x][1]):
            acc = leaf[2]
            for left, right in path + above:
                acc = H(left, acc, right)
            found.append((leaf[3], leaf[1], trees[x][0], root, H(*(a + b for a, b in path + above)), acc, acc == root))
    return found


def key(row):
    return tuple((v is not None, v) for v in row)


def same(df, table):
    got = rows(df)
    assert sorted(got, key=key) == sorted(brute(table), key=key)
    return got


def test_awkward_tables(spark):
    table = AWKWARD + [(50, "six times the same", "en", "a", 5, "x", 1)] * 6 + [(51, "é", None, None, None, None, None)] * 3
    got = same(merkle.op13(spark.createDataFrame(table, DOCS).repartition(3)), table)
    assert len({r[3] for r in got}) == 1
    assert rows(merkle.op13(spark.createDataFrame([], DOCS))) == []
    one = [(3, "only", None, "s", 4, "x", 1)]
    got = same(merkle.op13(spark.createDataFrame(one, DOCS)), one)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()


def test_trees_of_many_sizes(spark):
    """Sizes about the powers of the fanout, and of the span that one pivot spreads."""
    rng = random.Random(4)
    table, doc_id = [], 0
    for size in (1, 2, 3, 5, 15, 16, 17, 31, 33, 256, 257, 300):
        for _ in range(size):
            doc_id += rng.randint(1, 3)
            table.append((doc_id, f"text {doc_id}", f"l{size}", "s", rng.choice([None, doc_id]), "x", 1))
    rng.shuffle(table)
    got = same(merkle.op13(spark.createDataFrame(table, DOCS)), table)
    bad = {r[0] for r in got if not r[6]}
    assert bad == {r[0] for r in table if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}


def test_largest_count_can_be_tampered_with(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0][:2]
    table = [(i, "t", "en", "s", (1 << 63) - 1, "x", 1) for i in ids]
    same(merkle.op13(spark.createDataFrame(table, DOCS)), table)


def test_manifest_keeps_columns_and_proves_every_leaf(spark):
    docs = queries.read(spark, SF, "documents")
    from pyspark.sql import functions as F
    found = merkle.manifest(merkle.leaves(docs).withColumn("extra", F.lit(1)))
    assert found.columns == ["doc_id", "lang", "leaf", "tampered", "extra", "subroot", "root", "proof"]
    assert found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.count() == docs.count()


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES["op13_slot_pivot_manifest"](spark, SF)
    assert sorted(rows(df)) == sorted(con.execute(queries.SQL["op13_slot_pivot_manifest"]).fetchall())
    assert df.columns == [c[0] for c in con.description]


@pytest.mark.parametrize("doc_id", [None, 0, -7, 123456789])
def test_fields_are_unambiguous(spark, doc_id):
    df = spark.createDataFrame([(doc_id, "a-", "b", None, 3, "x", 1)], DOCS)
    assert df.select(merkle.leaf()).first()[0] == H(field(doc_id), "-", "1:b", "1:3", "2:a-")
