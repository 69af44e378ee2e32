"""A Bloom filter as an aggregate of a column, tested inside a scan.

The filter is a literal in the plan of the scan: a bit for each place, and at most 2^23 of
them (1 MB) whatever the number of keys. Spark writes plans out as text on the driver, a literal
once for each use, so its bytes count many times. With more keys than places allow for, more
rows pass; none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES_PER_KEY = 10
LEAST, MOST = 10, 23  # powers of two
#: bits of a key's hash where its three places begin
SHIFTS = (0, 20, 40)


class Bloom:
    """Which keys may be there."""

    def __init__(self, power: int, places: bytes):
        self.power, self.places = power, places

    def test(self, key: Column) -> Column:
        table = F.lit(self.places)

        def there(shift: int) -> Column:
            place = F.shiftrightunsigned(F.xxhash64(key), shift).bitwiseAND((1 << self.power) - 1).cast("int")
            byte = F.ascii(F.decode(F.substr(table, F.shiftright(place, 3) + 1, F.lit(1)), "ISO-8859-1"))
            # the bit of the place in its byte
            return byte.bitwiseAND(F.element_at(F.lit([1 << i for i in range(8)]), place.bitwiseAND(7) + 1)) != 0

        return there(SHIFTS[0]) & there(SHIFTS[1]) & there(SHIFTS[2])


def build(keys: DataFrame, key: Column) -> Bloom:
    """The filter of a column: the places are set by an aggregate over its keys, 64 in a word,
    and come to the driver as at most 2^17 words."""
    n = keys.count()
    power = min(MOST, max(LEAST, (PLACES_PER_KEY * max(n, 1) - 1).bit_length()))
    hashed = keys.select(F.xxhash64(key).alias("h")).select(F.explode(F.array(*[
        F.shiftrightunsigned("h", s).bitwiseAND((1 << power) - 1) for s in SHIFTS])).alias("p"))
    set_ = hashed.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    words = np.zeros(1 << (power - 6), np.int64)
    for r in set_.collect():
        words[r["word"]] = r["bits"]
    return Bloom(power, words.astype("<i8").tobytes())
