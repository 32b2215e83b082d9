"""Rounding as Python does it."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value. bround rounds the shortest decimal form instead, and so takes 0.35, a little
    less than 7/20, for a tie. For |x| * 10**digits below 2**52 and digits up to 3; null stays null.

    The scaled value and the error of that product, exact by splitting x into halves, tell on which side of a tie x is.
    """
    scale = F.lit(float(10**digits))
    product, big = x * scale, x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    away = (product - whole) - F.lit(0.5)
    up = F.when(away != 0, away > 0).when(error != 0, error > 0).otherwise(whole % 2 != 0)
    return F.when(x.isNotNull(), (whole + F.when(up, 1).otherwise(0)) / scale)
