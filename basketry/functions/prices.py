"""Money and quantity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far pack sizes may differ and still be one pack; which offers are sane beside the median.
PACK_SAME, WEIGHT_TOLERANCE = 0.03, 0.2
SANE_LOW, SANE_HIGH, SANE_FROM = 0.2, 5.0, 3
PRICE_STEP = 0.004
EARTH_KM = 6371.0


def parse_money(text: Column) -> Column:
    """A number with decimal comma, spaces of any kind between thousands and currency signs; null if it is none."""
    plain = text.cast("string")  # most texts are digits and two decimals: one pattern instead of four
    s = F.regexp_replace(plain, "[\\s  ]", "")
    s = F.regexp_replace(s, r"(?iu)(?:руб\.?|р\.|₽|rub)$", "")
    s = F.when(s.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^-?\d+(?:\.\d+|,\d{1,2})?$"), F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")).when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double"))


def receipt_money(value: Column) -> Column:
    """Receipt JSON: an integer is kopecks, a fraction is roubles."""
    s = value.cast("string")
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("double") / 100).otherwise(parse_money(s))


def off_by_hundred(parsed: Column, listed: Column) -> Column:
    """``parsed``, times a hundred where that is what the list says."""
    return F.when(F.abs(parsed * 100 - listed) <= F.greatest(F.lit(0.02), F.abs(listed) * 0.001), parsed * 100).otherwise(parsed)


def upper_median(values: Column) -> Column:
    """The upper of the middle two of an array; null of an empty one."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def sane(values: Column) -> Column:
    """Of three or more values those from a fifth of the upper median to five times it; all, if none is or there are fewer."""
    m = upper_median(values)
    kept = F.filter(values, lambda v: v.between(m * SANE_LOW, m * SANE_HIGH))
    return F.when((F.size(values) >= SANE_FROM) & (F.size(kept) > 0), kept).otherwise(values)


def sane_min(values: Column) -> Column:
    return F.array_min(sane(values))


def weight_ok(expected: Column, found: Column, tolerance: float = WEIGHT_TOLERANCE) -> Column:
    """The found weight is within a share of the expected one; unknown weights pass."""
    unknown = (F.coalesce(expected, F.lit(0.0)) <= 0) | (F.coalesce(found, F.lit(0.0)) == 0)
    return unknown | (F.abs(found - expected) / expected <= tolerance)


def weights_agree(a: Column, b: Column, tolerance: float = WEIGHT_TOLERANCE) -> Column:
    """Both weights are within a share of the larger; silence is no contradiction."""
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(a, b), F.lit(True))


def per_unit_price(price: Column, unit: Column, weight_g: Column) -> Column:
    """value, label: the price of a kilogram or litre where the weight is known, else of a piece."""
    by_weight = unit.eqNullSafe("kg") | (F.coalesce(weight_g, F.lit(0.0)) > 0)
    value = F.when(unit.eqNullSafe("kg"), price).when(weight_g > 0, price * 1000.0 / weight_g).otherwise(price)
    return F.struct(F.round(value, 2).alias("value"), F.when(by_weight & price.isNotNull(), "kg").otherwise("pcs").alias("label"))


def whole_pieces(qty: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(qty + 0.5))


def pieces(qty: Column, pack_g: Column | None, unit: Column, limit: int | None = None) -> Column:
    """Packs or pieces that go into the cart: kilograms are covered by whole packs, pieces rounded up."""
    exact = F.when((unit == "kg") & (pack_g > 0), qty * 1000.0 / pack_g).otherwise(qty) if pack_g is not None else qty
    n = F.greatest(F.lit(1), F.ceil(exact - 1e-9))
    return F.least(n, F.lit(limit)) if limit else n


def line_price(
    price: Column, per_kg: Column, shop_unit: Column, pack_g: Column, qty: Column, weighed: Column, ref_g: Column, portions: Column, by_weight: Column
) -> Column:
    """value (what is paid), adjust (for the choice only): a basket line in a shop; null where no price compares.

    A weighed product in packs costs as many packs as it takes; sold by weight it costs its kilograms, in the chain's
    portions where it has them; a pack of unknown weight does not compare. A piece sold by weight needs the piece's
    weight; a piece of another pack size costs its shelf price, the difference in size goes to ``adjust``.
    """
    rate = F.coalesce(F.nullif(per_kg, F.lit(0.0)), price)
    packed = (F.coalesce(pack_g, F.lit(0.0)) > 0) & ~shop_unit.eqNullSafe("kg")
    loose = ~packed & F.coalesce(by_weight, F.lit(False))
    portion = F.when(loose & F.coalesce(portions, F.lit(False)) & (pack_g > 0), pack_g)
    packs = F.greatest(F.lit(1), F.ceil(qty * 1000.0 / F.when(pack_g > 0, pack_g) - 1e-9))
    count = F.greatest(F.lit(1), F.ceil(qty - 1e-9))
    grams = F.coalesce(portion, F.when(ref_g > 0, ref_g))
    of_weight = (
        F.when(packed, packs * price)
        .when(portion.isNotNull(), packs * rate * portion / 1000.0)
        .when(loose, rate * qty)
        .when(shop_unit.eqNullSafe("pcs"), F.lit(None).cast("double"))
        .otherwise(price * qty)
    )
    of_piece = F.when(loose, rate * grams / 1000.0 * count).otherwise(price * count)
    value = F.when(weighed, of_weight).otherwise(of_piece)
    other = ~weighed & ~loose & (ref_g > 0) & (pack_g > 0) & (F.abs(pack_g - ref_g) / F.when(ref_g > 0, ref_g) > PACK_SAME)
    adjust = F.when(other, price * (ref_g / F.when(pack_g > 0, pack_g) - 1.0) * count).otherwise(0.0)
    return F.when(price.isNotNull() & value.isNotNull(), F.struct(F.round(value, 2).alias("value"), F.round(adjust, 2).alias("adjust")))


def weighed_by_evidence(name_unit: Column, fractional: Column, whole: Column, chains_by_weight: Column) -> Column:
    """Words of the name first, then receipts with fractions, then whole receipts, then how chains sell; else weighed."""
    return F.coalesce(F.when(name_unit.isNotNull(), name_unit == "kg"), F.when(fractional, True), F.when(whole, False), chains_by_weight, F.lit(True))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def half_up(value: Column, digits: int) -> Column:
    """Rounded in double arithmetic, as other engines do; ``round`` goes by the shortest decimals of a number."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def point_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat.cast("double"), lon.cast("double"))


def months_inclusive(first: Column, last: Column) -> Column:
    return (F.months_between(F.trunc(last, "month"), F.trunc(first, "month")) + 1).cast("int")


def offer_discount(total: Column, percent: Column, cap: Column, min_check: Column, cap_used: Column) -> Column:
    """Cashback of a total; the least check counts, and of the cap what is left of it."""
    left = cap - F.coalesce(cap_used, F.lit(0.0))
    raw = total * percent / 100.0
    capped = F.when(cap.isNotNull(), F.least(raw, F.greatest(left, F.lit(0.0)))).otherwise(raw)
    return F.when(total >= F.coalesce(min_check, F.lit(0.0)), F.round(capped, 2)).otherwise(0.0)


def offer_valid(day: Column, valid_from: Column, valid_to: Column, requires: Column, activated: Column, cap: Column, used: Column) -> Column:
    in_time = (F.coalesce(valid_from, day) <= day) & (day <= F.coalesce(valid_to, day))
    return in_time & (~F.coalesce(requires, F.lit(False)) | F.coalesce(activated, F.lit(False))) & (cap.isNull() | (cap - F.coalesce(used, F.lit(0.0)) > 0))


def delivery(subtotal: Column, fee: Column, free_from: Column) -> Column:
    return F.when(free_from.isNotNull() & (subtotal >= free_from), 0.0).otherwise(F.coalesce(fee, F.lit(0.0)))
