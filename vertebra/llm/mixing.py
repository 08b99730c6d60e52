"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson-distributed number of times.  The mean is its source's
target rate: target weight times the bytes wanted, over the source's bytes.  The draw
inverts the distribution at a uniform number hashed from a seed and the doc_id, so it
needs no state and a lost task draws the same again.  The copies are then shuffled
globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stash

SEED = "mix-1"
#: Above this mean a draw is the sum of several draws of smaller mean (exp(-mean) stays normal).
PART = 32.0
#: Sources are broadcast up to this many; beyond, their table is joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64


def unit_hash(*parts: Column | str) -> Column:
    """48 bits of the MD5 of the parts joined by ':', as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column)
                              else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def rates(docs: DataFrame, weights: DataFrame | None, epochs: float, alpha: float) -> DataFrame:
    """source, rate, parts, cdf: the mean repetitions and the cumulative distribution of one part."""
    size = docs.groupBy("source").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"))
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double"))
        size = (size.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    size = stash(size, "mix-sources")
    total, of = size.agg(F.sum("bytes").cast("double"), F.sum("weight")).first()
    goal = float(epochs) * (total or 0.0)
    rate = F.round(F.col("weight") / F.lit(of or 1.0) * F.lit(goal) / F.col("bytes"), 9)
    out = size.select("source", rate.alias("rate")).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn(
        "mean", F.col("rate") / F.col("parts"))
    # up to 12 deviations above the mean of a part: less than 2^-48 lies beyond
    top = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    first = F.exp(-F.col("mean"))
    step = lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.array_append(
        a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), top),
                      F.struct(first.alias("p"), F.array(first).alias("cdf")), step)["cdf"]
    return stash(out.select("source", "rate", "parts", cdf.alias("cdf")), "mix-rates")


def _free(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that no column of ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0,
                alpha: float = 0.7, seed: str = SEED) -> DataFrame:
    """Repeat the rows of ``docs`` (doc_id, text, source, any other columns) so that the
    sources' bytes approach the target weights, and shuffle them globally.

    ``weights``: (source, weight); a source it lacks gets none.  Without it a source of b
    bytes weighs b ** alpha.  ``epochs``: bytes wanted, as a multiple of the input's.
    Adds rate, copy (from 0) and shuffle_key (ascending in the new order).  Null sources
    are one source, a null text has one byte as every empty text, a very long one is a row as
    any other (texts are never gathered), rows of equal doc_id draw alike, an empty table gives
    no rows.  Input columns named rate, copy or shuffle_key give way; all others pass, whatever
    their names.
    """
    keep = [c for c in docs.columns if c.lower() not in ("rate", "copy", "shuffle_key")]
    docs = docs.select(*keep)
    source, parts, cdf, times, salt, other = (_free(c, keep) for c in ("_source", "_parts", "_cdf", "_times", "_salt", "_salt_of"))
    by = rates(docs, weights, epochs, alpha).select(F.col("source").alias(source), "rate", F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    same = F.col("source").eqNullSafe(F.col(source))
    if by.count() <= BROADCAST_SOURCES:
        drawn = docs.join(F.broadcast(by), same)
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        drawn = (docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
                 .join(by.withColumn(other, every), same & (F.col(salt) == F.col(other))))
    one = lambda i: F.size(F.filter(cdf, lambda c: c <= (
        unit_hash(seed, i, F.col("doc_id")) / F.lit(float(2 ** 48)))))
    drawn_times = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, i: a + one(i))
    copies = (drawn.withColumn(times, drawn_times).where(F.col(times) > 0)
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
              .withColumn("shuffle_key", unit_hash(f"{seed}-order", F.col("doc_id"), F.col("copy"))))
    # the keys are uniform in 48 bits, so equal ranges hold equal shares: the range is computed
    # from the key, and the draw runs once (a range partitioner would sample it first)
    n = spread(docs)
    return (copies.select(*keep, "rate", "copy", "shuffle_key")
            .repartitionById(n, F.shiftright(F.col("shuffle_key") * F.lit(n), 48).cast("int"))
            .sortWithinPartitions("shuffle_key", "doc_id", "copy"))


def op2(docs: DataFrame) -> DataFrame:
    """The documents at rates of bytes ** 0.7; awkward rows as stated in ``poisson_mix``."""
    return poisson_mix(docs).select("doc_id", "source", "rate", "copy", "shuffle_key", "text")


#: The same rows in DuckDB.
SQL_OP2 = f"""
WITH RECURSIVE size AS (
  SELECT source, CAST(sum(coalesce(octet_length(CAST(encode(text) AS BLOB)), 0) + 1) AS BIGINT) AS bytes
  FROM documents GROUP BY source),
weighed AS (SELECT *, pow(CAST(bytes AS DOUBLE), 0.7) AS weight FROM size),
rated AS (
  SELECT source, round(weight / (SELECT sum(weight) FROM weighed)
         * (SELECT CAST(sum(bytes) AS DOUBLE) FROM weighed) / bytes, 9) AS rate FROM weighed),
parted AS (SELECT *, CAST(greatest(1, ceil(rate / {PART})) AS INT) AS parts FROM rated),
cdf AS (
  SELECT source, rate, parts, rate / parts AS mean, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c
  FROM parted
  UNION ALL
  SELECT source, rate, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
  FROM cdf WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 24)),
curve AS (SELECT source, rate, parts, list(c) AS cs FROM cdf GROUP BY source, rate, parts),
drawn AS (
  SELECT d.doc_id, d.source, d.text, curve.rate,
    list_sum([len([c FOR c IN cs IF c <= CAST('0x' || substr(md5('{SEED}:' || i || ':' || doc_id), 1, 12) AS BIGINT)
             / 281474976710656.0]) FOR i IN range(1, parts + 1)]) AS times
  FROM documents d JOIN curve ON d.source IS NOT DISTINCT FROM curve.source),
copies AS (SELECT * EXCLUDE (times), unnest(range(CAST(times AS BIGINT))) AS copy FROM drawn)
SELECT doc_id, source, rate, CAST(copy AS INT) AS copy,
  CAST('0x' || substr(md5('{SEED}-order:' || doc_id || ':' || copy), 1, 12) AS BIGINT) AS shuffle_key, text
FROM copies
"""
