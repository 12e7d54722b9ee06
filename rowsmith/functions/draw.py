"""Random-looking values that depend only on the row, never on partitioning.

Every draw is a hash of (seed, table, column, label, row id). The same row gets
the same value on any cluster, after any retry and in any order, and any other
row's value can be computed in place without a join. Expressions are SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from rowsmith.functions.text import lit

LONG_LIMIT = 2**62
WIDE_BITS = 60


@dataclass(frozen=True)
class Draws:
    """Draws for one column of one table."""

    seed: int
    table: str
    column: str
    method: str = "xxhash64"

    def below(self, n: int | str, row: str, label: str = "value") -> str:
        """An integer in [0, n) for each row."""
        stream = lit(f"{self.seed}|{self.table}|{self.column}|{label}")
        limit = n if isinstance(n, str) else lit(n)
        if self.method == "md5":
            digest = f"md5(concat_ws('|', {stream}, CAST({row} AS STRING)))"
            number = f"CAST(conv(substring({digest}, 1, 15), 16, 10) AS BIGINT)"
        else:
            number = f"xxhash64({stream}, CAST({row} AS BIGINT))"
        return f"pmod({number}, {limit})"

    def slices(self, row: str) -> Callable[[str, int], str]:
        """Many small draws for one value, cut from as few wide ones as hold them.

        Returns `pick(label, n)`: an integer in [0, n) for each row, the same
        for the same label. A wide draw is a number of 60 bits, and each slice
        leaves at least ten of them to the last one, so that no value of a
        slice is favoured.
        """
        cut: dict[str, str] = {}
        place = {"wide": 0, "used": 1}

        def pick(label: str, n: int) -> str:
            if label not in cut:
                if place["used"] * n > 1 << (WIDE_BITS - 10) and place["used"] > 1:
                    place["wide"], place["used"] = place["wide"] + 1, 1
                wide, used = self.wide(row, place["wide"]), place["used"]
                cut[label] = f"({wide if used == 1 else f'{wide} div {used}L'}) % {lit(n)}"
                place["used"] = used * n
            return f"({cut[label]})"

        return pick

    def wide(self, row: str, k: int) -> str:
        """The k-th wide draw of a value; a digest holds two."""
        if self.method == "md5":
            stream = lit(f"{self.seed}|{self.table}|{self.column}|text{k // 2}")
            digest = f"md5(concat_ws('|', {stream}, CAST({row} AS STRING)))"
            return f"CAST(conv(substring({digest}, {1 + 15 * (k % 2)}, 15), 16, 10) AS BIGINT)"
        stream = lit(f"{self.seed}|{self.table}|{self.column}|text{k}")
        return f"(xxhash64({stream}, CAST({row} AS BIGINT)) & {(1 << WIDE_BITS) - 1}L)"

    def chance(self, probability: float, row: str, label: str) -> str:
        """True for about this share of rows, in steps of one millionth."""
        return f"{self.below(1_000_000, row, label)} < {lit(round(probability * 1_000_000))}"


def permute(row: str, capacity: int, rows: int, salt: int) -> str:
    """A different number in [0, capacity) for every row id in [0, rows).

    The multiplier is coprime to the capacity, so no two ids meet, and small
    enough that the product stays inside 63 bits.
    """
    multiplier, offset = permutation(capacity, rows, salt)
    return f"pmod({row} * {lit(multiplier)} + {lit(offset)}, {lit(capacity)})"


def permutation(capacity: int, rows: int, salt: int) -> tuple[int, int]:
    """Multiplier and offset of `permute`."""
    if not 0 < rows <= capacity <= LONG_LIMIT:
        raise ValueError(f"cannot place {rows} rows in {capacity} slots")
    largest = max(1, min(capacity - 1, (LONG_LIMIT - capacity) // rows))
    # Near the golden section of the range, neighbouring ids land far apart.
    multiplier = max(1, min(largest, int(largest * 0.6180339887498949) + salt % 97))
    while gcd(multiplier, capacity) != 1:
        multiplier -= 1
    return multiplier, salt % capacity


def digits36(rows: int) -> int:
    """Base-36 digits needed to write every row id below `rows`."""
    width, reach = 1, 36
    while reach < rows:
        width, reach = width + 1, reach * 36
    return width


def suffix36(row: str, width: int) -> str:
    return f"lpad(conv(CAST({row} AS STRING), 10, 36), {width}, '0')"
