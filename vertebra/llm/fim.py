"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut by its id's hash into prefix, middle and suffix.  Each of the three is emitted
as chunks of ``CHUNK`` code points, keyed by the document and the chunk's position in the
*output*.  One hash shuffle by document and a sort by (document, position) within its
partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``) bring every output
together in order, so it is streamed: into an incremental digest, into files, or on to the
restoration.  That reads marks and form of the output only, keys every chunk by its position
in the *text* and sorts once more within the partitions the chunks already are in; no second
shuffle.  No step holds more of a document than a chunk, but for the scanned row itself.

Rows that repeat a doc_id are told apart by a hash of their text and of the partition they
come from; equal rows of one partition travel as copies of one key, which the streams count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

CHUNK = 16_384
#: Marks, salt of the hash, per cent of texts that are cut, and of those put suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT, CUT, SPM = "1:", 90, 20
#: Fixed values: (mark, place in the text) by place in the output.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": (("", 0),)}
#: Rows and characters of an Arrow batch that a stream gives out.
BATCH_ROWS, BATCH_CHARS = 4096, 2_000_000

KEY = ["doc_id", "copy"]
PIECE = "doc_id long, copy long, part int, at long, piece string, n long, form string, prefix_chars long, middle_chars long"


def cuts(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form of a document, and where its prefix and its middle end (0, 0 if plain).  A null id counts as an empty one."""
    h = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < SPM else "psm"), a, b


class _Out:
    """Rows on their way out, given out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= BATCH_ROWS or self.chars >= BATCH_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.chars = [], 0


def _fields(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


_LONG, _TEXT = pa.int64(), pa.string()
_PIECE = _fields(doc_id=_LONG, copy=_LONG, part=pa.int32(), at=_LONG, piece=_TEXT, n=_LONG, form=_TEXT, prefix_chars=_LONG, middle_chars=_LONG)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_PIECE)
    seed = TaskContext.get().partitionId()
    for batch, texts in pieces(batches):
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for doc_id, text in zip(ids, texts):
            text = text or ""
            copy = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed=seed) - (1 << 63)
            form, a, b = cuts(doc_id, text)
            ends = ((0, a), (a, b), (b, len(text))) if form != "plain" else ((0, len(text)),)
            head = (len(text), form, *((a, b - a) if form != "plain" else (None, None)))
            at = 0
            for part, (mark, place) in enumerate(ORDERS[form]):
                start, end = ends[place]
                for i in range(start, max(end, start + 1), CHUNK):
                    piece = (mark if i == start else "") + text[i: min(i + CHUNK, end)]
                    yield from out.add((doc_id, copy, part, at, piece, *(head if not at else (None,) * 4)), len(piece))
                    at += len(piece)
    yield from out.flush()


def output_pieces(docs: DataFrame) -> DataFrame:
    """The transformed texts of ``docs`` (doc_id, text; others are not read), one row per chunk
    of output: doc_id, copy (tells rows of one doc_id apart), part, at (code points of output
    before it), piece; the first also has n, form, prefix_chars, middle_chars.

    The rows lie sorted by (doc_id, copy, at) in partitions that hold whole documents, so a
    stream over a partition can write outputs of any length.  A null text counts as empty, a
    null doc_id is a document as any other; an empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_emit, PIECE)
    return keyed.repartition(*KEY).sortWithinPartitions(*KEY, "at")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, dict]]:
    """(starts a document, copies of it, row) for each sorted row; a copy's rows are given once.
    Copies of a row lie next to it, so the first row of a document is held until they are counted."""
    last = held = None
    copies = 0
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["doc_id"], row["copy"])
            here = (key, row["at"])
            if here == last:
                copies += held is not None
                continue
            if held is not None:
                yield True, copies, held
                held = None
            if last is None or last[0] != key:
                held, copies = row, 1
            else:
                yield False, 0, row
            last = here
    if held is not None:
        yield True, copies, held


class Splitter:
    """Finds the parts of an output that comes in pieces: (place in the text, code points of that part before, text)."""

    def __init__(self, form: str):
        self.order, self.part, self.kept, self.at = ORDERS[form], -1 if form != "plain" else 0, "", 0

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, int, str]]:
        rest = self.kept + piece
        while self.part + 1 < len(self.order):
            mark = self.order[self.part + 1][0]
            i = rest.find(mark)
            if i < 0:
                keep = 0 if last else min(len(rest), len(mark) - 1)  # a mark may go on in the next piece
                yield from self._give(rest[: len(rest) - keep])
                self.kept = rest[len(rest) - keep:]
                return
            yield from self._give(rest[:i])
            rest, self.part, self.at = rest[i + len(mark):], self.part + 1, 0
        yield from self._give(rest)
        self.kept = ""

    def _give(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            yield self.order[self.part][1], self.at, text
            self.at += len(text)


_RESTORE = _fields(doc_id=_LONG, copy=_LONG, place=pa.int32(), at=_LONG, piece=_TEXT, copies=_LONG, n=_LONG, form=_TEXT,
                   prefix_chars=_LONG, middle_chars=_LONG, output_sha256=_TEXT)
RESTORE = "doc_id long, copy long, place int, at long, piece string, copies long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
_END = 9


def _digest_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Output digest of each document (a row at place ``_END``), and its chunks keyed by their place in the text."""
    out = _Out(_RESTORE)
    head = digest = split = None
    none = (None,) * 6

    def close() -> Iterator[pa.RecordBatch]:
        if head is not None:
            for place, at, text in split.feed("", last=True):
                yield from out.add((head[0], head[1], place, at, text, *none), len(text))
            yield from out.add((head[0], head[1], _END, 0, None, *head[2:], digest.hexdigest()))

    for first, copies, row in _documents(batches):
        if first:
            yield from close()
            head = (row["doc_id"], row["copy"], copies, row["n"], row["form"], row["prefix_chars"], row["middle_chars"])
            digest, split = hashlib.sha256(), Splitter(row["form"])
        digest.update(row["piece"].encode("utf-8", "replace"))
        for place, at, text in split.feed(row["piece"]):
            yield from out.add((head[0], head[1], place, at, text, *none), len(text))
    yield from close()
    yield from out.flush()


_RESULT = _fields(doc_id=_LONG, n=_LONG, form=_TEXT, prefix_chars=_LONG, middle_chars=_LONG, output_sha256=_TEXT, restored_sha256=_TEXT)
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _digest_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_RESULT)
    digest = hashlib.sha256()
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] < _END:
                digest.update(row["piece"].encode("utf-8", "replace"))
                continue
            done = (row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output_sha256"], digest.hexdigest())
            for _ in range(row["copies"]):
                yield from out.add(done)
            digest = hashlib.sha256()
    yield from out.flush()


def restored_pieces(output: DataFrame) -> DataFrame:
    """The texts back from ``output_pieces``, from outputs and forms alone: doc_id, copy, place,
    at and piece in the order of the text, a document's end being a row at place 9 with copies
    (equal rows of the table), n, form, prefix_chars, middle_chars and output_sha256."""
    return output.mapInArrow(_digest_output, RESTORE).sortWithinPartitions(*KEY, "place", "at")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row
    of ``docs`` (doc_id, text; others are not read).

    A null or empty text is plain, with n 0 and the digest of nothing; a null doc_id is hashed as
    an empty one; repeated rows have a row each; texts of any length are streamed in chunks.  An
    empty table gives no rows.
    """
    return restored_pieces(output_pieces(docs)).mapInArrow(_digest_text, RESULT)


_OUTPUT = _fields(doc_id=_LONG, form=_TEXT, output=_TEXT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_OUTPUT)
    head, copies, parts = None, 0, []

    def close() -> Iterator[pa.RecordBatch]:
        text = "".join(parts)
        for _ in range(copies):
            yield from out.add((*head, text), len(text))

    for first, n, row in _documents(batches):
        if first:
            yield from close()
            head, copies, parts = (row["doc_id"], row["form"]), n, []
        parts.append(row["piece"])
    yield from close()
    yield from out.flush()


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, form and the whole output text of every row of ``docs``, for outputs that fit a
    row as their texts did (``output_pieces`` has them in chunks)."""
    return output_pieces(docs).mapInArrow(_whole, "doc_id long, form string, output string")


def op11(docs: DataFrame) -> DataFrame:
    """The registered query: ``digests`` of the whole table."""
    return digests(docs)


SQL_OP11 = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
k AS (
  SELECT doc_id, t, n,
    CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM o
"""
