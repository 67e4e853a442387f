"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
# Colour words with their red, green and blue, and what stands for an unknown word.
PALETTE = {
    "red": (206, 32, 41), "crimson": (190, 30, 55), "maroon": (120, 24, 40), "claret": (124, 32, 56), "burgundy": (110, 28, 46),
    "blue": (28, 68, 190), "navy": (18, 30, 84), "royal": (32, 74, 200), "sky": (110, 180, 235), "skyblue": (110, 180, 235),
    "lightblue": (140, 195, 240), "darkblue": (20, 38, 110), "teal": (24, 130, 132), "turquoise": (48, 190, 180), "cyan": (40, 210, 220),
    "white": (245, 245, 245), "cream": (238, 232, 205), "beige": (226, 214, 182), "black": (24, 24, 26), "grey": (128, 128, 132),
    "gray": (128, 128, 132), "silver": (188, 190, 195), "green": (32, 140, 62), "lime": (110, 200, 60), "darkgreen": (20, 78, 40),
    "yellow": (240, 214, 48), "gold": (218, 176, 52), "amber": (236, 178, 40), "orange": (236, 126, 34), "pink": (232, 130, 170),
    "purple": (118, 56, 160), "violet": (140, 84, 200), "brown": (110, 72, 46),
}
GREY = (150, 150, 150)


def foot_x(x: str = "x", w: str = "w") -> Column:
    return F.expr(f"{x} + {w} / 2")


def foot_y(y: str = "y", h: str = "h") -> Column:
    return F.expr(f"{y} + {h}")


def canonical(text: Column) -> Column:
    """Without white space at the ends, in small letters."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def error_class(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def label_suffix(text: Column) -> Column:
    return F.substring_index(text, "·", -1)


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3.0 - 2.0 * t)


def gate_width(h: Column, dt: Column, spacing: Column | None = None) -> Column:
    """How far a body of height h may get in dt: 12 heights or 0.88 of the frame a second, and a floor; never
    more than 1.5 times the usual spacing where that is known."""
    g = F.least(12.0 * F.greatest(h, F.lit(0.02)), F.lit(0.88)) * dt + 0.01
    return g if spacing is None else F.least(g, F.coalesce(1.5 * spacing, g))


def rounded(v: Column, places: int) -> Column:
    """A number from 0 on, rounded half up on the scaled double, as SQL engines do; ``F.round`` goes by decimal objects, which is most of
    the time of a query that makes pairs. What is too large for it, infinite or no number stays as it is."""
    m = 10.0**places
    return F.when(v * m < 4e15, F.floor(v * m + 0.5) / m).otherwise(v)


def roman(n: Column) -> Column:
    """Label of a number from 0 on, up to 64 bits: Roman numerals of n + 1 up to 3999, then small letters of n in bijective base 26, as
    many as it takes; null has none."""
    n, out = n.cast("long"), F.lit("")
    rest = F.least(n, F.lit(3998)) + 1
    for size, letters in SMALL:
        times = F.floor(rest / size).cast("int")
        out = F.concat(out, F.repeat(F.lit(letters), times))
        rest = rest % size

    def one(state: Column, _: Column) -> Column:
        left, done = state["left"], state["done"]
        more = left >= 0
        return F.struct(
            F.when(more, F.call_function("div", left, F.lit(26)) - 1).otherwise(left).alias("left"),
            F.when(more, F.concat(F.char(F.pmod(left, F.lit(26)) + 97), done)).otherwise(done).alias("done"),
        )

    # letters from the last to the first; a 64-bit number has 14 of them at most
    start = F.struct(n.alias("left"), F.lit("").alias("done"))
    base = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, one, lambda s: s["done"])
    return F.when(n < 3999, out).when(n.isNotNull(), base)


def word_jaccard(a: Column, b: Column, longer_than: int = 3) -> Column:
    """Share of common words; 1 where neither has a word that counts."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > longer_than))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of 8-bit sRGB, with the usual four-digit matrix."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    r, g, b = linear(r), linear(g), linear(b)
    x = f((0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047)
    y = f(0.2126 * r + 0.7152 * g + 0.0722 * b)
    z = f((0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def delta_e(p: tuple, q: tuple) -> Column:
    """CIE76 difference of two colours given as (r, g, b) columns."""
    a, b = lab(*p), lab(*q)
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))


def opposite(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue turned by half a circle, saturation at least 0.75 and value at least 0.85; 8-bit channels."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2.0).otherwise((r - g) / span + 4.0) / 6.0
    hue = F.pmod(hue + 0.5, F.lit(1.0)) * 6.0
    s, v = F.greatest(F.when(high == 0, 0.0).otherwise(span / high), F.lit(0.75)), F.greatest(high, F.lit(0.85))
    i = F.floor(hue).cast("int")
    f = hue - i
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    pick = lambda *c: F.element_at(F.array(*c), i % 6 + 1)
    return [F.rint(255.0 * c).cast("int") for c in (pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q))]


def index_percentile(values: Column, share: float) -> Column:
    """The value at place int(n * share) of the sorted values (n div 2 for 0.5: the upper median)."""
    a = F.array_sort(values)
    return F.try_element_at(a, F.floor(F.size(a) * share).cast("int") + 1)


def source_index(i: Column, source_fps: float, fps: float) -> Column:
    """Source frame of the i-th sample, ties to even."""
    return F.rint(i * source_fps / fps).cast("int")


def money(v: Column) -> Column:
    return v.try_cast("double")
