"""Exact texts of doubles: the binary value, rounded half to even.

``format_string`` rounds the shortest decimal text of a double half up, and
``format_number`` pads digits beyond the seventeenth with zeros, so both can
differ from the value's own decimal expansion. Here a value is split into whole
and fraction, which is exact, and the fraction times a power of ten is kept as a
product and, where the product is a tie, its rounding error (Dekker's two-product),
so a tie is a tie only if the binary value is one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PLACES = 15
_SPLIT = 134217729.0          # 2**27 + 1
_LONG, _HALF = float(1 << 63), float(1 << 62)
_WIDEST = float(1 << 125)
_PLACEHOLDER = re.compile(r"%(%|s|\+?d|(\+?)(,?)\.(\d+)f)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Not compiled, so kept to the rare branches,
    which also keeps the code generated for the common ones small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounded_fraction(f: Column, scale: int) -> Column:
    """``f * scale`` for ``0 <= f < 1``, rounded half to even by its exact value."""
    b = float(scale)
    b_high = _SPLIT * b - (_SPLIT * b - b)
    b_low = b - b_high

    def middle(f: Column) -> Column:
        def by_error(s: Column) -> Column:
            f, high, product = s["f"], s["high"], s["product"]
            low = f - high
            error = ((high * b_high - product) + high * b_low + low * b_high) + low * b_low
            below = product - 0.5
            return F.when(error > 0, below + 1).when(error < 0, below).otherwise(F.rint(product))
        return _let(F.struct(f.alias("f"), (f * _SPLIT - (f * _SPLIT - f)).alias("high"), (f * b).alias("product")), by_error)

    product = f * b
    # Beside the middle of two neighbours the product alone decides; in it, its error does.
    return F.when(F.abs(product - F.rint(product)) != 0.5, F.rint(product)).otherwise(_let(f, middle))


def _whole_text(w: Column, grouped: bool) -> Column:
    """Digits of a double without a fraction; exact below 2**125."""
    def text(c: Column) -> Column:
        return F.format_number(c, 0) if grouped else F.replace(F.format_number(c, 0), F.lit(","), F.lit(""))

    def wide(w: Column) -> Column:
        upper = w / _HALF - (w / _HALF) % 1.0
        lower = w - upper * _HALF
        dec = (upper.cast("bigint").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)")
               + lower.cast("bigint").cast("decimal(20,0)")).cast("decimal(38,0)")
        return F.when(w < _WIDEST, text(dec)).otherwise(text(w))

    small = F.format_number(w.cast("bigint"), 0) if grouped else w.cast("bigint").cast("string")
    return F.when(w < _LONG, small).otherwise(_let(w, wide))


def fixed(c: Column, places: int, plus: bool = False, grouped: bool = False) -> Column:
    """Like Python's ``f"{x:.Nf}"``; ``plus`` shows a plus sign, ``grouped`` sets commas.

    Null stays null; a value that rounds to zero keeps its sign; NaN and the
    infinities are ``nan`` and ``inf``; digits of values from 2**125 on are those
    of their shortest text.
    """
    if not 0 <= places <= MAX_PLACES:
        raise ValueError(f"places must be 0 to {MAX_PLACES}")
    x = c.cast("double")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
    a = F.abs(x)
    if places == 0:
        body = _whole_text(F.rint(a), grouped)
    else:
        scale = 10 ** places
        part = a % 1.0
        r = _rounded_fraction(part, scale)
        carried = r >= float(scale)
        digits = F.lpad(F.when(carried, F.lit(0)).otherwise(r.cast("bigint")).cast("string"), places, "0")
        whole = a - part + F.when(carried, 1.0).otherwise(0.0)
        body = F.concat(_whole_text(whole, grouped), F.lit("."), digits)
    body = F.when(F.isnan(x), "nan").when(a == float("inf"), "inf").otherwise(body)
    return F.when(x.isNotNull(), F.concat(sign, body))


def plain(c: Column) -> Column:
    """The shortest text of a double, without an exponent from 0.0001 to 10**16, as Python prints it."""
    x = c.cast("double")
    text = F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0"))
    text = F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    a = F.abs(x)
    return F.when((a >= 1e-4) & (a < 1e16), text).otherwise(x.cast("string"))


def filled(template: str, *args: Column) -> Column:
    """``format_string`` with exact numbers: ``%.Nf``, ``%+.Nf`` and ``%,.Nf`` take the text of ``fixed``."""
    out, rest, given = [], "", list(args)
    at = 0
    for m in _PLACEHOLDER.finditer(template):
        rest += template[at:m.start()]
        at = m.end()
        if m.group(4) is None:
            rest += m.group(0)
            if m.group(1) != "%":
                out.append(given.pop(0))
        else:
            rest += "%s"
            out.append(fixed(given.pop(0), int(m.group(4)), plus=bool(m.group(2)), grouped=bool(m.group(3))))
    if given:
        raise ValueError("more values than places in the text")
    return F.format_string(rest + template[at:], *out)


def money(c: Column, places: int = 0) -> Column:
    """``$#,##0`` text."""
    return F.concat(F.lit("$"), fixed(c, places, grouped=True))
