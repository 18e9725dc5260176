"""Token sequences of levels: <bos>, a condition, 100 tiles, <eos>.

Fixed values: ids 0 to 6 are the tiles `# @$.*+`, then <pad> 7, <bos> 8, <eos> 9, <uncond> 10, <d0> to <d9> 11 to 20.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.grid import SIDE, TILES

BOS, EOS, UNCOND, FIRST_BUCKET = 8, 9, 10, 11


def condition(bucket: Column) -> Column:
    """FN-8: the condition token; a bucket beyond 0 to 9 gives null."""
    return F.when(bucket.isNull(), F.lit(UNCOND)).when(bucket.between(0, 9), F.lit(FIRST_BUCKET) + bucket)


def encode(text: Column, bucket: Column) -> Column:
    """FN-9: 103 ids, or null for a text that is not ten rows of ten known tiles or a bad bucket."""
    rows = F.split(text, "\n", -1)
    flat = F.translate(text, "\n", "")
    good = (F.size(rows) == SIDE) & F.forall(rows, lambda r: F.length(r) == SIDE) & (F.length(F.translate(flat, TILES, "")) == 0) & condition(bucket).isNotNull()
    tiles = F.transform(F.split(F.translate(flat, TILES, "0123456"), ""), lambda c: c.try_cast("int"))
    return F.when(good, F.concat(F.array(F.lit(BOS), condition(bucket).cast("int")), tiles, F.array(F.lit(EOS))).cast("array<tinyint>"))


def decode(ids: Column) -> Column:
    """FN-10: the text of a sequence with or without its prefix; null unless exactly 100 tiles stand before <eos>."""
    body = F.when(F.get(ids, F.lit(0)) == BOS, F.slice(ids, 3, F.greatest(F.size(ids), F.lit(1)))).otherwise(ids)
    end = F.array_position(body, F.lit(EOS).cast("tinyint")).cast("int")
    tiles = F.when(end > 0, F.slice(body, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(body)
    good = (F.size(tiles) == SIDE * SIDE) & F.forall(tiles, lambda t: t.between(0, len(TILES) - 1))
    names = F.array(*map(F.lit, TILES))
    flat = F.array_join(F.transform(tiles, lambda t: F.get(names, t.cast("int"))), "")
    return F.when(good, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.substring(flat, r * SIDE + 1, F.lit(SIDE))), "\n"))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from an md5 of the seed and the keys: the same on every run and engine."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def pick(n: int, seed: str, *keys: Column) -> Column:
    """A whole number from 0 to n - 1, uniform by hash."""
    return F.floor(uniform(seed, *keys) * n).cast("int")


def dropped(bucket: Column, p: float, seed: str, *keys: Column) -> Column:
    """SMP-4: the bucket, or null with probability p."""
    return F.when(uniform(seed, *keys) >= p, bucket)
