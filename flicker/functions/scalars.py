"""Scalar expressions: hashed uniforms, ratios with null for a zero denominator, null-dominant conjunction, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 0.975 quantiles of Student's t by degrees of freedom; fixed values, 1 to 30.
T_975 = (
    12.7062047364, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520,
    2.2009851601, 2.1788128297, 2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402, 2.0930240544, 2.0859634473,
    2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616, 2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)


def t_975(df: Column) -> Column:
    """The 0.975 quantile of Student's t; beyond 30 degrees of freedom by a four-term expansion about the normal's."""
    z = 1.959963984540054
    v = df.cast("double")
    far = F.lit(z) + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v)
    near = F.get(F.array(*[F.lit(t) for t in T_975]), df.cast("int") - 1)
    return F.when(df.isNull() | (df < 1), F.lit(None)).when(df <= 30, near).otherwise(far)


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that the key alone decides (32 bits of its md5)."""
    return F.conv(F.substring(F.md5(_joined(*key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def below(level: float, *key: Column | str) -> Column:
    """uniform(*key) < level, from the digits of the md5 alone: they are in the order of the numbers."""
    least = max(math.ceil(level * 2**32), 0)  # the first number that isn't below; digits longer by some are above their beginning
    return F.md5(_joined(*key)) < F.lit(f"{least:08x}" if least < 2**32 else "g")


def _joined(*key: Column | str) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])


def gaussian(u: Column, v: Column) -> Column:
    """A normal deviate of two uniforms (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(2.0**-33)))) * F.cos(F.lit(2 * math.pi) * v)


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def all_known(*conditions: Column) -> Column:
    """Null if any condition is null (even beside a false one), else whether all hold."""
    known = conditions[0].isNotNull()
    holds = F.coalesce(conditions[0], F.lit(True))
    for c in conditions[1:]:
        known, holds = known & c.isNotNull(), holds & F.coalesce(c, F.lit(True))
    return F.when(known, holds)


def decision(*conditions: Column) -> Column:
    whole = all_known(*conditions)
    return F.when(whole.isNull(), "not_evaluable").when(whole, "pass").otherwise("fail")


def shown(value: Column, digits: int, percent: bool = False) -> Column:
    """A number with fixed decimals, or `not evaluable` for null."""
    text = F.format_number(value * 100 if percent else value, digits)
    return F.coalesce(F.concat(F.replace(text, F.lit(","), F.lit("")), F.lit("%" if percent else "")), F.lit("not evaluable"))
