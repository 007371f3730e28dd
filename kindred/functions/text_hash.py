"""SimHash of a text (Charikar 2002), as a fingerprint for the same joins and groups as images.

Tokens stand between spaces, tabs and line ends; every ``shingle`` neighbours
make one shingle, a shorter text is one shingle.  Bit ``p`` (0 is the most
significant) is set where at least half of the shingle hashes have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.key_schemes import any_bit, signed
from kindred.plans.thresholds import HASH_BITS

SHINGLE = 3
HALF = HASH_BITS // 2
# One bit in either half of a long, so one sum counts two bits of the hash.
TWO_LANES = (1 << HALF) | 1


def hash_texts(df: DataFrame, text: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of every row, with ``phash`` and ``error`` for the text.

    A null text gets an error and no hash.  Rows are told apart by their place,
    so rows that repeat each other stay apart.

    Shingles are formed and hashed one by one inside the stage that adds them
    up, so no list of them is ever held.  32 sums count all 64 bits, two to a
    long; a text may have 2**31 shingles.  Sums are partial per task, so what is
    shuffled is one row of 33 numbers per text.
    """
    rows = df.select(*keep, F.monotonically_increasing_id().alias("_row"), F.expr(
        f"filter(split(lower(`{text}`), '[ \\n\\t]+'), x -> x <> '')"
    ).alias("_tokens"))
    at = F.expr(f"explode_outer(sequence(0, greatest(0, size(_tokens) - {shingle})))").alias("_at")
    shingles = rows.select(*keep, "_row", "_tokens", at)
    gram = f"concat_ws(' ', {', '.join(f'get(_tokens, _at + {k})' for k in range(shingle))})"
    hashed = f"cast(conv(substr(md5({gram}), 1, 16), 16, -10) as bigint)"
    values = shingles.select(*keep, "_row", F.when(F.col("_tokens").isNotNull(), F.expr(hashed)).alias("_h"))
    sums = [F.expr(f"sum(shiftrightunsigned(_h, {k}) & {TWO_LANES}L)").alias(f"_s{k}") for k in range(HALF)]
    counted = values.groupBy("_row", *keep).agg(F.count("_h").alias("_n"), *sums)
    bits = []
    for k in range(HALF):
        bits.append(f"if(2 * (_s{k} & {(1 << HALF) - 1}L) >= _n, {1 << k}L, 0L)")
        bits.append(f"if(2 * shiftrightunsigned(_s{k}, {HALF}) >= _n, {signed(1 << (HALF + k))}L, 0L)")
    found = F.col("_n") > 0
    # Two steps, since one would exceed the size of a method that the JVM compiles.
    low = counted.withColumn("_half", F.when(found, F.expr(any_bit(bits[:HALF]))))
    return low.select(
        *keep,
        F.when(F.col("_half").isNotNull(), F.col("_half").bitwiseOR(F.expr(any_bit(bits[HALF:])))).alias("phash"),
        F.when(~found, "no text").alias("error"),
    )
