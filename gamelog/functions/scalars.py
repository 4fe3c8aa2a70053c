"""Row-level expressions with explicit null, division and cast rules.

Spark runs with ANSI mode on, so a bare division by zero or a bad cast fails the
job. Casts stay strict on purpose (bad text should be seen); divisions go through
:func:`ratio`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes that mean "did not play", and what they count as.
BLANK_CLOCKS = ("", "DNP")
ZERO_CLOCK = "0:00"


def ratio(numerator: Column, denominator: Column) -> Column:
    """True division; NULL where the denominator is zero or either side is NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def floor_at(value: Column, low: float = 1, keep_null: bool = False) -> Column:
    """Clip from below. A NULL becomes ``low``, or stays NULL with ``keep_null``."""
    clipped = F.greatest(value, F.lit(low))
    return F.when(value.isNotNull(), clipped) if keep_null else clipped


def clock_minutes(clock: Column, blanks: Sequence[str] = BLANK_CLOCKS, strict: bool = True) -> Column:
    """``"mm:ss"`` as fractional minutes; NULL and blank clocks are 0, no seconds is NULL.

    Text that is no number fails the job; without ``strict`` the result is NULL.
    """
    number = (lambda part: part.cast("double")) if strict else (lambda part: part.try_cast("double"))
    cleaned = F.when(clock.isNull() | clock.isin(*blanks), F.lit(ZERO_CLOCK)).otherwise(clock)
    parts = F.split(cleaned, ":")
    minutes = number(F.try_element_at(parts, F.lit(1)))
    seconds = number(F.try_element_at(parts, F.lit(2)))
    return minutes + seconds / F.lit(60.0)


def distance_from_origin(x: Column, y: Column) -> Column:
    return F.hypot(x.cast("double"), y.cast("double"))


def angle_from_origin(x: Column, y: Column) -> Column:
    """Radians, measured from the x axis."""
    return F.atan2(y.cast("double"), x.cast("double"))


def mentions(text: Column, tokens: Iterable[str]) -> Column:
    """True where the text contains any token. Plain substring tests, so no regex engine."""
    return reduce(or_, [text.contains(token) for token in tokens])


def round_half_up(value: Column, digits: int) -> Column:
    """``F.round`` of a double, bit for bit, without the decimal text it rounds by.

    Scaled by the power of ten, a double below 1e12 is off by less than 0.0002. More than 0.001
    from a tie the nearest whole number is therefore the one that ``F.round`` finds, and its
    quotient by the power is the double nearest to the decimal. Ties, larger values, NaN and
    infinity go through ``F.round``, in a lambda: Spark fuses no projection that holds one, so
    many rounded columns become many small methods. Fused, they are one method over 8000 bytes,
    which HotSpot leaves to its interpreter.
    """
    power = F.lit(10.0**digits)
    scaled = value * power
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499)
    exact = F.element_at(F.transform(F.array(value), lambda x: F.round(x, digits)), 1)
    # adding 0.0 makes a negative zero a plain one
    return F.when(plain, whole / power + F.lit(0.0)).otherwise(exact)


def first_match(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first true condition; a NULL condition does not match."""
    chain = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, value in cases[1:]:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))
