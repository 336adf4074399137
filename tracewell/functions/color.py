"""Colour maps: a voltage to red, green and blue, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Background, and the stops of each ramp after it, as hexadecimal RGB.
BACKGROUND = "262930"
POSITIVE = {
    "YellowMagenta": "442a4a 5d3366 7b268c 9304b0",
    "RedBlue": "2e3042 252c61 2434b3 2c43f5",
    "OrangeBlue": "293b54 315485 2d6fc4",
    "IceFire": "393247 39295c 46278a 205f9e 71b5bd 93cfc9",
    "Vanimo": "2e3627 3c5227 568a22 8ded2d",
    "GreyScale": "000000",
}
NEGATIVE = {
    "YellowMagenta": "333126 3d391f 524b1e 756a1e a39012 ffdf12",
    "RedBlue": "402c2b 612f2c 9e322b f54336",
    "OrangeBlue": "4a2922 753628 d14221",
    "IceFire": "403130 4d2f2d 5e2925 8a241d ba4f22 d9a273",
    "Vanimo": "433147 663573 b94ed4",
    "GreyScale": "303030 505050 606060 d0d0d0",
}
ACCENT = {
    "YellowMagenta": (250, 234, 130), "RedBlue": (204, 103, 230), "OrangeBlue": (242, 171, 126),
    "IceFire": (166, 217, 237), "Vanimo": (202, 237, 166), "GreyScale": (255, 255, 255),
}
OVERLAY_ALPHA = {"YellowMagenta": 5, "RedBlue": 8, "OrangeBlue": 5, "IceFire": 8, "Vanimo": 5, "GreyScale": 2}
BUFFER_ALPHA, VIEW_ALPHA = 10, 180
GAP_DOT = 0x60


def stops(name: str, positive: bool) -> list[tuple[int, int, int]]:
    return [tuple(bytes.fromhex(s)) for s in (BACKGROUND + " " + (POSITIVE if positive else NEGATIVE)[name]).split()]


def background() -> tuple[int, int, int]:
    return tuple(bytes.fromhex(BACKGROUND))


def rgb(v: Column, vmax: Column | float, name: str) -> Column:
    """struct<r,g,b> of a voltage: linear between the stops of its sign's ramp, cut off to whole numbers."""
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / vmax))

    def ramp(u: Column, positive: bool) -> Column:
        table = stops(name, positive)
        n = len(table) - 1
        at = F.least(F.floor(u * n), F.lit(n - 1)).cast("int")  # u = 1 is the end of the last piece

        def part(c: int) -> Column:
            values = F.array(*[F.lit(float(s[c])) for s in table])
            low, high = F.get(values, at), F.get(values, at + 1)
            return F.floor(low + (high - low) * (u * n - at)).cast("int")

        return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))

    return F.when(t >= 0, ramp(t, True)).otherwise(ramp(-t, False))
