"""Month arithmetic, seasons and right-closed bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(time) -> Column:
    """Months since year 0: differences of it are whole calendar months."""
    return F.year(time) * 12 + F.month(time)


def target_month(time) -> Column:
    """The calendar month after a step's."""
    return F.month(F.add_months(time, 1))


def cyclic_month(time) -> dict[str, Column]:
    angle = 2 * F.pi() * target_month(time) / 12
    return {"target_month_sin": F.sin(angle), "target_month_cos": F.cos(angle)}


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin (edge, next edge] that holds x; NULL outside."""
    out = F.when(x <= edges[0], None)
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(x <= edge, label)
    return out


def climate_zone(lat) -> Column:
    return right_closed(F.abs(lat), [-0.01, 23.5, 66.5, 90.0], ["tropical", "temperate", "polar"])


def latitude_band(lat, width: int = 20) -> Column:
    edges = list(range(-90, 91, width))
    return right_closed(F.col(lat) if isinstance(lat, str) else lat, edges, [f"({a}, {b}]" for a, b in zip(edges, edges[1:], strict=False)])


def season(time, lat) -> Column:
    """Meteorological season; south of the equator the opposite one."""
    m = F.month(time)
    north = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    south = F.when(m.isin(12, 1, 2), "summer").when(m.isin(3, 4, 5), "autumn").when(m.isin(6, 7, 8), "winter").otherwise("spring")
    return F.when(F.col(lat) >= 0, north).otherwise(south)


def two_decimals(x) -> Column:
    """Text with two decimals of the double's exact value, ties to even, as C's printf gives it; NULL for NULL. NaN, infinity and what reaches 2**53 stop the job.

    The fraction is parted at 26 bits, so that a hundred times either part, and each difference, is exact.
    """
    x = F.col(x) if isinstance(x, str) else x
    sound = ~F.isnan(x) & (F.abs(x) < 2.0**53)
    x = F.when(x.isNull() | sound, x).otherwise(F.raise_error(F.concat(F.lit("no number of two decimals: "), x.cast("string"))).cast("double"))
    size = F.abs(x)
    part = size - F.floor(size)
    high = F.floor(part * 2.0**26) / 2.0**26
    cents, low = F.floor(high * 100), (part - high) * 100
    left = F.lit(0.5) - (high * 100 - cents)
    cents = cents + F.when(low > left, 1).when(low < left, 0).otherwise(cents % 2)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(x.isNotNull(), F.concat(sign, (F.floor(size) + F.when(cents == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
