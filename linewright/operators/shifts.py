"""A set of lines that can be compared with itself at a distance."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

#: Sums are taken modulo this prime; two ranges with one sum are held equal.
PRIME = (1 << 61) - 1
BASE = 1_000_000_007 * 998_244_353 % PRIME


class Shifted:
    """Sorted distinct lines with running sums of ``BASE ** line``.

    The sum over a range, times ``BASE ** d``, is the sum over the same range ``d`` lines further down. So
    one comparison of two numbers tells whether a range looks as the one ``d`` lines above it, and the
    last place where it does not is found by halving.
    """

    def __init__(self, lines: list[int]):
        self.lines = lines
        self._sums = [0]
        power, at = 1, 0
        for line in lines:
            power = power * pow(BASE, line - at, PRIME) % PRIME
            at = line
            self._sums.append((self._sums[-1] + power) % PRIME)

    def _sum(self, above: int, upto: int) -> int:
        """Over the lines behind ``above`` up to ``upto``."""
        return self._sums[bisect_right(self.lines, upto)] - self._sums[bisect_right(self.lines, above)]

    def last_miss(self, distance: int, floor: int) -> int | None:
        """The last line behind ``floor`` that is in the set while the one ``distance`` above it is not.

        From the end on, ranges that look alike are passed at once. Where they differ, either the line is the
        miss, or only the place above is in the set, which is none; then the search goes on from
        the next line of the set. There are no more such steps than places that are added from
        one stretch of ``distance`` lines to the one above it.
        """
        scale = pow(BASE, distance, PRIME)

        def alike(above: int, upto: int) -> bool:
            return (self._sum(above, upto) - scale * self._sum(above - distance, upto - distance)) % PRIME == 0

        i = len(self.lines) - 1
        while i >= 0 and self.lines[i] > floor:
            upto = self.lines[i]
            if alike(floor, upto):
                return None
            same, other = upto, floor
            while same - other > 1:
                middle = (same + other) // 2
                if alike(middle, upto):
                    same = middle
                else:
                    other = middle
            j = bisect_left(self.lines, same)
            if j < len(self.lines) and self.lines[j] == same:
                return same
            i = j - 1
        return None
