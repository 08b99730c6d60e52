"""Byte-level BPE encoding and decoding.

A text is pre-tokenised by the vocabulary's pattern and each pre-token is merged by rank.
Texts over ``CHUNK`` characters are cut into overlapping chunks that are pre-tokenised in
parallel, each from its own start.  The pattern never looks back, so two chunks that share
one boundary share all that follow: the chunks are stitched at the first boundary of the
overlap that both have, and the pieces between such points are what one pass over the
whole text gives.  Where no boundary is shared the two chunks are tokenised as one.
Decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, pieces, spread

CHUNK, OVERLAP = 16_384, 512
#: A boundary so near to a window's end may move once more text is seen (contractions
#: need two more letters, a run of white space one more character).
MARGIN = 3
_KEPT = 250_000
#: A place in a text that is a boundary whatever came before, as a pattern of one character
#: before it and one after.  No pre-token of ``public_tokenizers.PATTERN`` goes on from a
#: character that is no white space to one that is.
SURE = r"\S\s"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, computed when missing."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)

    def __missing__(self, token: str) -> bytes:
        out = np.array(self.merge(token.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(token) <= 64:
            if len(self) >= _KEPT:
                for old in list(itertools.islice(self, _KEPT // 8)):
                    del self[old]
            self[token] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        none = len(ranks) + 256
        pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over linked parts, for pre-tokens of any length."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        return [ranks[p] for p in part if p is not None]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def chunk(self, text: str) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Ends of the pre-tokens of a chunk, all their ids, and where each one's ids end."""
        tokens = self.pattern.findall(text)
        ids = [self[t] for t in tokens]
        return (np.cumsum([len(t) for t in tokens], dtype=np.int64), b"".join(ids), np.cumsum([len(x) for x in ids], dtype=np.int64))


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    loaded = held("bpe")
    if (path, pattern) not in loaded:
        loaded[path, pattern] = Encoder(load_ranks(path), pattern)
    return loaded[path, pattern]


def decode_ids(ids: bytes, path: str) -> bytes:
    """The raw bytes of ids, concatenated."""
    tokens = held("bpe")
    if path not in tokens:
        tokens[path] = {v: k for k, v in load_ranks(path).items()}
    return b"".join(map(tokens[path].__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def stitch(enc: Encoder, chunks: list[tuple[int, int, str | None, np.ndarray, bytes, np.ndarray]]) -> bytes:
    """Ids of a text from its chunks (start, length, text, ends, ids, id ends), in order of start.
    Of the ends, those within an overlap and the last are enough; the text is needed only of
    chunks that share no boundary with a neighbour."""
    out: list[bytes] = []
    at = 0  # all before this character is encoded; it is a boundary of the current chunk
    start, length, text, ends, ids, id_ends = chunks[0]
    for nxt in [*chunks[1:], None]:
        stops = np.concatenate([[0], ends]) + start
        offsets = np.concatenate([[0], id_ends])
        first = np.searchsorted(stops, at)
        if nxt is None:
            out.append(ids[offsets[first]:])
            break
        n_start, n_length, n_text, n_ends, n_ids, n_id_ends = nxt
        sure = stops[(stops >= max(n_start, at)) & (stops <= start + length - MARGIN)]
        shared = np.intersect1d(sure, np.concatenate([[0], n_ends]) + n_start, assume_unique=True)
        if len(shared):
            last = np.searchsorted(stops, shared[0])
            out.append(ids[offsets[first]:offsets[last]])
            at = int(shared[0])
            start, length, text, ends, ids, id_ends = nxt
        else:  # go on from the last boundary that is sure, over both chunks' text
            joined = text[at - start:] + n_text[max(0, start + length - n_start):]
            start, text, length = at, joined, len(joined)
            ends, ids, id_ends = enc.chunk(joined)
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, sure: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every text of ``docs``.

    ``path``: the rank file, at the same place on every machine.  A null text is empty and
    has no ids; null and repeated doc_ids are rows like others; other columns are not
    read; an empty table gives no rows.  Texts of any length are encoded in chunks.

    ``sure``: a pattern as ``SURE`` that holds for ``pattern``.  Two chunks with such a place in
    their overlap share a boundary there, which both see from the overlap alone, so they go to
    the stitching without their text; without ``sure`` every chunk takes its text along.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk)
    long = rows.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    starts = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)))
    cut = (long.select("uid", "doc_id", "text", starts.alias("start"), (F.length("text") - chunk).alias("to"))
           .select("uid", "doc_id", "start", "to", F.col("text").substr(F.col("start") + 1, F.lit(chunk + overlap)).alias("text"))
           .repartition(spread(docs), "uid", "start"))
    place = regex.compile(sure) if sure else None

    def needed(text: str, start: int, to: int) -> bool:
        """Whether an overlap of the chunk may hold no shared boundary (``to``: start of the text's last chunk at the utmost)."""
        meets = [text[:overlap]] if start else []
        meets += [text[chunk: chunk + overlap]] if start < to else []
        # the overlap of two chunks is the same text in both; a boundary near its end might move
        return place is None or not all(place.search(t, 0, max(len(t) - MARGIN, 0)) for t in meets)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.encode(t) for t in texts], pa.binary())], names=["doc_id", "ids"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        ints = lambda rows: pa.array([x.astype("<i4").tobytes() for x in rows], pa.binary())
        for batch, texts in pieces(batches):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            done = [enc.chunk(t) for t in texts]
            kept = [(d[0] <= overlap) | (d[0] >= chunk) | (d[0] == len(t)) for d, t in zip(done, texts)]
            taken = [t if needed(t, s, to) else None for t, s, to in zip(texts, column("start").to_pylist(), column("to").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [column("uid"), column("doc_id"), column("start"), pa.array([len(t) for t in texts], pa.int32()), pa.array(taken, pa.string()),
                 ints(d[0][k] for d, k in zip(done, kept)), pa.array([d[1] for d in done], pa.binary()), ints(d[2][k] for d, k in zip(done, kept))],
                names=["uid", "doc_id", "start", "length", "text", "ends", "ids", "id_ends"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        ints = lambda c: [np.frombuffer(x, "<i4").astype(np.int64) for x in pdf[c]]
        ids = stitch(encoder(path, pattern), list(zip(pdf["start"].tolist(), pdf["length"].tolist(), pdf["text"], ints("ends"), pdf["ids"], ints("id_ends"))))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "ids": [ids]})

    stitched = (cut.mapInArrow(parts, "uid long, doc_id long, start int, length int, text string, ends binary, ids binary, id_ends binary")
                .groupBy("uid").applyInPandas(join, "doc_id long, ids binary"))
    return short.mapInArrow(whole, "doc_id long, ids binary").unionByName(stitched)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and decoded, the raw bytes of its ids."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode_ids(x, path) for x in part.column(at).to_pylist()], pa.binary())],
                                                 names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(docs, path, pattern, sure=SURE), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
