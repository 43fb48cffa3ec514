"""Similarity joins inside blocks, without comparing all pairs of a block.

Texts of equal length L within Hamming distance k agree in at least one of
k + 1 fixed segments, so the join is exact on (block, segment, letters) and only
those pairs are verified. Each pair is kept once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X


def _segment(text: str, i: str) -> str:
    """SQL of the ``i``-th of __n segments of a text of __len letters."""
    return f"substring({text}, cast(floor({i} * __len / __n) as int) + 1, cast(floor(({i} + 1) * __len / __n) - floor({i} * __len / __n) as int))"


def hamming_pairs(df: DataFrame, block: list[str], text: str, key: str, limit: Column, extra: Column | None = None, together: int = 1) -> DataFrame:
    """``a, b, text_a, text_b, distance``: pairs of keys a < b of one block whose equally long texts differ in at most ``limit`` places.

    ``limit`` is an expression on the column ``text``. ``extra`` is a further
    condition on the columns of both sides (named ``<column>_a``, ``<column>_b``).
    With ``together`` = 2 a text has k + 2 segments, of which two must agree, and the
    join is on every two of them: more rows, but far fewer chance meetings where
    segments are short (wide limits, small alphabets). Rows whose block, text or
    key is null take no part.
    """
    if together not in (1, 2):
        raise ValueError("together is 1 or 2")
    cols = [c for c in df.columns if c not in block]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, text, key])).withColumn("__k", limit.cast("int")).withColumn("__len", F.length(text))
    rows = rows.withColumn("__n", F.col("__k") + together)
    one = f"transform(sequence(0, __n - 1), i -> struct(i as i, i as j, {_segment(f'`{text}`', 'i')} as s))"
    two = (
        f"flatten(transform(sequence(0, __n - 2), i -> transform(sequence(i + 1, __n - 1), j ->"
        f" struct(i as i, j as j, concat({_segment(f'`{text}`', 'i')}, '|', {_segment(f'`{text}`', 'j')}) as s))))"
    )
    rows = rows.withColumn("__seg", F.explode(F.expr(one if together == 1 else two)))
    on = [*block, "__len", "__seg"]
    a = rows.select(*on, "__k", "__n", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = rows.select(*on, *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b, on).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    if extra is not None:
        pairs = pairs.where(extra)
    # a pair meets once for each segment (or two of them) it shares: keep the first of those
    agree = F.expr(f"filter(sequence(0, __seg.j), i -> {_segment(f'{text}_a', 'i')} = {_segment(f'{text}_b', 'i')})")
    first = pairs.withColumn("distance", X.hamming(F.col(f"{text}_a"), F.col(f"{text}_b"))).where(F.col("distance") <= F.col("__k")).where(F.size(agree) == together)
    return first.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), *[c for c in pairs.columns if c not in ("__len", "__seg", "__k", "__n", f"{key}_a", f"{key}_b")], "distance")


def edit_pairs(df: DataFrame, block: list[str], text: str, key: str, edits: int) -> DataFrame:
    """``a, b, distance``: pairs a < b of one block within ``edits`` plain edits."""
    return block_edit_pairs(df, block, text, key, edits).select("a", "b", "distance")


def block_edit_pairs(df: DataFrame, block: list[str], text: str, key: str, edits: int) -> DataFrame:
    """``block..., a, b, distance``: pairs a < b of one block within ``edits`` plain edits.

    Of ``edits`` + 1 segments of the longer-or-equal text one occurs unchanged in the
    other, and at least one such has at most as many edits before it as segments, and
    at most as many after it; that leaves few places for it. The join is exact on (block, length,
    segment, letters) by one hash; what it meets is verified before repeated pairs are dropped, and
    keys and blocks, which stay behind as hashes, are joined to the pairs that are left.
    """
    n = edits + 1
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, text, key])).select(F.xxhash64(*block, F.col(key)).alias("h"), F.xxhash64(F.lit(0), *block).alias("g"), F.col(text).alias("t"), F.length(text).alias("n"), *block, F.col(key).alias("k"))
    cut = f"cast(floor(s * n / {n}) as int)"
    size = f"cast(floor((s + 1) * n / {n}) - floor(s * n / {n}) as int)"
    seg = rows.select(F.col("t").alias("ta"), F.col("h").alias("ha"), F.explode(F.expr(f"transform(sequence(0, {edits}), s -> xxhash64(g, n, s, substring(t, {cut} + 1, {size})))")).alias("seg"))
    probe = rows.select("g", "t", "h", F.explode(F.expr(f"sequence(n, n + {edits})")).alias("m"), "n").withColumn("gap", F.col("n") - F.col("m")).select(
        F.col("t").alias("tb"),
        F.col("h").alias("hb"),
        F.explode(
            F.expr(
                f"array_distinct(flatten(transform(sequence(0, {edits}), s -> transform(filter(transform(filter(sequence(-{edits}, {edits}), o -> abs(o) <= s and abs(o - gap) <= {edits} - s),"
                f" o -> cast(floor(s * m / {n}) as int) + o), p -> p >= 0), p -> xxhash64(g, m, s, substring(t, p + 1, cast(floor((s + 1) * m / {n}) - floor(s * m / {n}) as int)))))))"
            )
        ).alias("seg"),
    )
    met = seg.join(probe, "seg").where("ha <> hb").withColumn("distance", F.levenshtein("ta", "tb", edits)).where("distance >= 0")
    pairs = met.select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"), "distance").distinct()
    names = rows.groupBy("h").agg(*[F.first(c).alias(c) for c in [*block, "k"]])
    one, two = (names.select(F.col("h").alias(f"h{x}"), F.col("k").alias(f"k{x}"), *[F.col(c).alias(f"{c}_{x}") for c in block]) for x in "ab")
    whole = pairs.join(one, "ha").join(two, "hb").where(F.lit(True) if not block else " and ".join(f"`{c}_a` = `{c}_b`" for c in block)).where("ka <> kb")
    return whole.select(*[F.col(f"{c}_a").alias(c) for c in block], F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "distance")
