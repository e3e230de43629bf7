"""Colours of domains: evenly spaced hues, and blends for pages of several domains."""

from __future__ import annotations

import colorsys
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markdown as M


def palette(n: int, offset: float = 220.0, saturation: float = 0.70, lightness: float = 0.65) -> list[str]:
    """n colours `#rrggbb` whose hues are 360 / n degrees apart, from offset on; none for n below 1."""
    hues = (math.fmod(offset + 360.0 * i / n, 360.0) / 360.0 for i in range(max(n, 0)))
    return ["#" + bytes(round(255 * x) for x in colorsys.hls_to_rgb(h, lightness, saturation)).hex() for h in hues]


def domain_colors(domains: DataFrame, colors: list[str]) -> DataFrame:
    """(domain, color): distinct domains in order take the colours in turn. Domains are few; they are numbered in one task."""
    place = F.row_number().over(Window.orderBy("domain")) - 1
    return domains.select("domain").distinct().select("domain", F.array(*map(F.lit, colors))[(place % len(colors)).cast("int")].alias("color"))


def hls(rgb: Column) -> Column:
    """Hue, lightness and saturation from 0 to 1 of a struct of r, g, b up to 255."""
    r, g, b = (rgb[k] / F.lit(255.0) for k in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    turn = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    light = (top + low) / 2
    sat = F.when(light <= 0.5, span / (top + low)).otherwise(span / (2 - top - low))
    return F.struct(F.coalesce(F.pmod(turn / 6, F.lit(1.0)), F.lit(0.0)).alias("h"), light.alias("l"), F.coalesce(sat, F.lit(0.0)).alias("s"))


def hex_of_hls(h: Column, l: Column, s: Column) -> Column:  # noqa: E741
    """`#rrggbb`: a channel lies at k = n + 12 h of twelve steps, and is l - s min(l, 1 - l) max(-1, min(k - 3, 9 - k, 1))."""

    def channel(n: int) -> Column:
        k = F.pmod(n + h * 12, F.lit(12.0))
        x = l - s * F.least(l, 1 - l) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.bround(x * 255)

    return M.rgb_to_hex(channel(0), channel(8), channel(4))


def blended(of: DataFrame, colors: DataFrame, default: str = "#cccccc") -> DataFrame:
    """(name, color) for pages (name, domain), a row for each domain: one known domain gives its colour, several a mean in HLS, none the default.

    The mean hue is that of the sum of unit vectors; where these cancel out (length below 0.05 for each), the plain mean. Blends are darker by 0.18 and less
    saturated by 0.05, so that they differ from any one domain's colour.
    """
    c = of.select("name", "domain").join(F.broadcast(colors), "domain", "left").select("name", "color", hls(M.hex_to_rgb(F.col("color"))).alias("x"))
    angle = F.col("x.h") * (2 * math.pi)
    a = c.groupBy("name").agg(F.count("color").alias("n"), F.max("color").alias("one"), F.avg("x.h").alias("h"), F.avg("x.l").alias("l"), F.avg("x.s").alias("s"), F.sum(F.sin(angle)).alias("y"), F.sum(F.cos(angle)).alias("z"))
    length = F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    hue = F.when(length < 0.05 * F.col("n"), F.col("h")).otherwise(F.pmod(F.atan2("y", "z") / (2 * math.pi), F.lit(1.0)))
    mix = hex_of_hls(hue, M.clamp(F.col("l") - 0.18, 0.0, 1.0), M.clamp(F.col("s") - 0.05, 0.0, 1.0))
    return a.select("name", F.when(F.col("n") == 0, default).when(F.col("n") == 1, F.col("one")).otherwise(mix).alias("color"))
