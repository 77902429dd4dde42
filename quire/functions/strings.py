"""String, code point and geometry helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of CJK font names.
CJK_FONTS = [
    "simsun", "simhei", "simkai", "fangsong", "kaiti", "heiti", "songti", "mingliu", "pminglu", "dfkai", "dflihei", "mshei", "msson", "msfan",
    "hiragi", "mincho", "gothic", "kozuka", "kozgo", "kozmn", "msmincho", "msgothic", "meiryo", "batang", "dotum", "gulim", "gungsuh", "malgun",
    "stxihei", "stheiti", "stfangsong", "stkaiti", "stsong", "adobesong", "adobeheiti", "adobekaiti", "adobefangsong",
    "notosans", "notosanscjk", "notoserifcjk", "sourcehansans", "sourcehanserif",
]
#: Prefixes of CJK character map names.
CJK_CMAPS = ["GBK", "GB", "UniGB", "B5", "CNS", "UniCNS", "83pv", "90ms", "UniJIS", "KSC", "UniKS"]
#: Punctuation and its vertical forms.
HORIZONTAL, VERTICAL = "（）〈〉《》「」『』【】〔〕〖〗—…、。，", "︵︶︿﹀︽︾﹁﹂﹃﹄︻︼︹︺︗︘︱︙︑︒︐"
#: Code points that stand upright in vertical text.
UPRIGHT = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F),
    (0x31350, 0x323AF), (0x3000, 0x303F), (0xFF00, 0xFFEF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xAC00, 0xD7AF), (0x1100, 0x11FF),
]


def is_cjk_font(name: Column) -> Column:
    return F.lower(name).rlike("|".join(CJK_FONTS))


#: Parts of font names that tell a character collection, tried in this order.
ORDERINGS = {
    "GB1": ["simsun", "simhei", "simkai", "fangsong", "stxihei", "stheiti", "stfangsong", "stkaiti", "stsong", "songti", "heiti", "adobesong", "adobeheiti", "adobekaiti", "adobefangsong", "sourcehansanssc", "sourcehanserifsc", "notosanssc", "notoserifsc"],
    "CNS1": ["mingliu", "pminglu", "dfkai", "dflihei", "mshei", "msson", "sourcehansanstc", "sourcehanseriftc", "notosanstc", "notoseriftc"],
    "Japan1": ["hiragi", "mincho", "gothic", "kozuka", "kozgo", "kozmn", "msmincho", "msgothic", "meiryo", "sourcehansansjp", "sourcehanserifserijp", "notosansjp", "notoserifjp"],
    "Korea1": ["batang", "dotum", "gulim", "gungsuh", "malgun", "sourcehansanskr", "sourcehanserifkr", "notosanskr", "notoserifkr"],
}


def cjk_ordering(name: Column) -> Column:
    """The character collection that a font's name tells; empty if none."""
    out = F.lit("")
    for ordering in reversed(ORDERINGS):
        out = F.when(F.lower(name).rlike("|".join(ORDERINGS[ordering])), ordering).otherwise(out)
    return F.coalesce(out, F.lit(""))


def is_cjk_cmap(name: Column) -> Column:
    return name.rlike(f"^({'|'.join(CJK_CMAPS)})")


def writing_mode(cmap: Column) -> Column:
    """1 vertical, 0 horizontal, -1 unknown, by the end of a character map's name."""
    return F.when(F.endswith(cmap, F.lit("-V")), 1).when(F.endswith(cmap, F.lit("-H")) | cmap.isin("Identity"), 0).otherwise(-1)


def vertical_variant(text: Column) -> Column:
    return F.translate(text, HORIZONTAL, VERTICAL)


def should_rotate(char: Column) -> Column:
    point = F.ascii(char)  # the code point of the first character
    return ~reduce(lambda a, b: a | b, [point.between(lo, hi) for lo, hi in UPRIGHT])


def split_any(text: Column, separators: str) -> Column:
    """Parts between any of the separators, without empty ones."""
    marks = "".join("\\" + c for c in separators)
    return F.filter(F.split(text, f"[{marks}]"), lambda x: x != "")


def hex_decode(text: Column) -> Column:
    """Bytes of hexadecimal digits; other characters are passed over and an odd digit at the end is followed by 0."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def hex_valid(text: Column) -> Column:
    return text.rlike("^([0-9A-Fa-f]{2})+$")


def utf16_text(raw: Column) -> Column:
    """A metadata string: UTF-16 with its mark, UTF-8 with its mark, else Latin-1."""
    rest = lambda at: F.substring(raw, F.lit(at), F.octet_length(raw))
    return (
        F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(rest(3), "UTF-16BE"))
        .when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Place of a point on the Hilbert curve over a square of 2 ** order cells a side."""
    n = 1 << order
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0), F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        turn = lambda v: F.when(rx == 1, n - 1 - v).otherwise(v)
        return F.struct(F.when(ry == 0, turn(a["y"])).otherwise(a["x"]).cast("bigint").alias("x"), F.when(ry == 0, turn(a["x"])).otherwise(a["y"]).cast("bigint").alias("y"), d.cast("bigint").alias("d"))

    sizes = F.array(*[F.lit(1 << i).cast("bigint") for i in range(order - 1, -1, -1)])
    return F.aggregate(sizes, start, step)["d"]


def transform(x: Column, y: Column, matrix: tuple) -> tuple[Column, Column]:
    """A point under an affine matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = matrix
    return x * a + y * c + e, x * b + y * d + f


def rotated(x: Column, y: Column, w: Column, h: Column, origin: tuple) -> tuple[Column, ...]:
    """A box turned by a right angle about an origin, for vertical text."""
    ox, oy = origin
    return y - oy + ox, oy - (x - ox) - w, h, w
