"""Fill-in-middle against plain Python, DuckDB and a round trip."""

import hashlib
import random

import duckdb
import pytest

from vertebra.llm import fim, queries

from .test_operators import AWKWARD, DOCS, SF, rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """The contract, on one whole text."""
    text = text or ""
    n = len(text)
    x = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(x[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, b - a, sha(out), sha(text)), out


def key(row):
    return tuple((v is not None, v) for v in row)


LONG = "".join(random.Random(5).choices("ab <>PSM\nß漢😀", k=150_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
MORE = [(20 + i, LONG[i:], "en", "a", 1, "x", 1) for i in range(6)] + [
    (40, "text with <P> inside", "en", "a", 1, "x", 1), (41, "<S>", "en", "a", 1, "x", 1), (42, "x", "en", "a", 1, "x", 1),
    (43, "first of two", "en", "a", 1, "x", 1), (43, "second of two", "en", "a", 1, "x", 1)] + [(44, "five times the same", "en", "a", 1, "x", 1)] * 5


def test_equals_plain_python(spark, empty):
    table = AWKWARD + MORE
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    want = [brute(r[0], r[1]) for r in table]
    assert sorted(rows(fim.op11(docs)), key=key) == sorted((w for w, _ in want), key=key)
    got = sorted(rows(fim.transform(docs)), key=key)
    assert got == sorted(((w[0], w[2], out) for w, out in want), key=key)
    assert {w[2] for w, _ in want} == {"plain", "psm", "spm"}
    assert rows(fim.op11(empty)) == [] and rows(fim.transform(empty)) == []


def test_outputs_travel_in_chunks(spark):
    docs = spark.createDataFrame(MORE, DOCS)
    got = rows(fim.output_pieces(docs).select("doc_id", "copy", "at", "piece"))
    assert max(len(r[3]) for r in got) <= fim.CHUNK + 3
    for doc_id in range(20, 26):
        mine = [(r[2], r[3]) for r in got if r[0] == doc_id]
        assert len(mine) > 5 and mine == sorted(mine)  # one partition, in order


def test_marks_are_found_across_pieces():
    rng = random.Random(1)
    for form in ("psm", "spm"):
        for _ in range(300):
            parts = ["".join(rng.choices("<PSM>x", k=rng.randint(0, 12))) for _ in range(3)]
            text = "".join(parts)
            if any(m in text or m in p for m in ("<P>", "<S>", "<M>") for p in parts):
                continue
            p, m, s = parts
            out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
            cut = sorted(rng.choices(range(len(out) + 1), k=4))
            split, found = fim.Splitter(form), []
            for a, b in zip([0, *cut], [*cut, len(out)]):
                found += split.feed(out[a:b])
            found += split.feed("", last=True)
            assert "".join(t for _, _, t in sorted(found)) == text


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES["op11_fill_in_middle"](spark, SF)
    assert sorted(rows(df)) == sorted(con.execute(queries.SQL["op11_fill_in_middle"]).fetchall())
    assert df.columns == [c[0] for c in con.description]
