"""Glyph names to text and predefined character maps to codecs."""

from __future__ import annotations

import re
import unicodedata

#: Glyph names that don't follow from the names of their characters.
PLAIN = dict(
    space=" ", exclam="!", quotedbl='"', numbersign="#", dollar="$", percent="%", ampersand="&", quotesingle="'", parenleft="(", parenright=")",
    asterisk="*", plus="+", comma=",", hyphen="-", period=".", slash="/", colon=":", semicolon=";", less="<", equal="=", greater=">", question="?",
    at="@", bracketleft="[", backslash="\\", bracketright="]", asciicircum="^", underscore="_", grave="`", braceleft="{", bar="|", braceright="}",
    asciitilde="~", zero="0", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9",
    quoteleft="‘", quoteright="’", quotedblleft="“", quotedblright="”", quotesinglbase="‚", quotedblbase="„", guilsinglleft="‹", guilsinglright="›",
    guillemotleft="«", guillemotright="»", endash="–", emdash="—", bullet="•", ellipsis="…", dagger="†", daggerdbl="‡", perthousand="‰", fraction="⁄",
    exclamdown="¡", questiondown="¿", cent="¢", sterling="£", currency="¤", yen="¥", Euro="€", florin="ƒ", section="§", paragraph="¶", copyright="©",
    registered="®", trademark="™", degree="°", plusminus="±", multiply="×", divide="÷", minus="−", mu="µ", logicalnot="¬", brokenbar="¦",
    periodcentered="·", ordfeminine="ª", ordmasculine="º", onehalf="½", onequarter="¼", threequarters="¾", onesuperior="¹", twosuperior="²",
    threesuperior="³", AE="Æ", ae="æ", OE="Œ", oe="œ", germandbls="ß", Thorn="Þ", thorn="þ", Eth="Ð", eth="ð", Oslash="Ø", oslash="ø", Lslash="Ł",
    lslash="ł", dotlessi="ı", fi="ﬁ", fl="ﬂ", ff="ﬀ", ffi="ﬃ", ffl="ﬄ", acute="´", dieresis="¨", circumflex="ˆ", tilde="˜", caron="ˇ", breve="˘",
    dotaccent="˙", ring="˚", cedilla="¸", ogonek="˛", hungarumlaut="˝", macron="¯", nbspace=" ", sfthyphen="­",
)
#: Accents in glyph names and their combining characters.
ACCENTS = dict(
    grave="̀", acute="́", circumflex="̂", tilde="̃", macron="̄", breve="̆", dotaccent="̇", dieresis="̈",
    ring="̊", hungarumlaut="̋", caron="̌", cedilla="̧", ogonek="̨", commaaccent="̧", dotbelow="̣",
)
#: Parts of the names of predefined character maps and the codecs of their codes, first fit.
CODECS = [
    ("UCS2", "utf-16-be"), ("UTF16", "utf-16-be"), ("GBK2K", "gb18030"), ("GBKp", "gbk"), ("GBK", "gbk"), ("GB-EUC", "gb2312"), ("GBpc", "gb2312"),
    ("ETen", "big5"), ("B5pc", "big5"), ("HKscs", "big5hkscs"), ("RKSJ", "cp932"), ("KSCms", "cp949"), ("KSC-EUC", "euc_kr"), ("KSCpc", "euc_kr"),
]


def codec_of(cmap: str) -> str:
    """The codec of a predefined character map; Identity and unknown ones are taken for UTF-16."""
    return next((codec for part, codec in CODECS if part in cmap), "utf-16-be")


def glyph_text(name: str) -> str:
    """The text of a glyph name: listed ones, ``uni`` and ``u`` with digits, Greek and Cyrillic letters by character name, letters
    with accents, and parts joined by underscores; a suffix after a full stop is left out. Unknown names are empty."""
    stem = name.split(".")[0] if not name.startswith(".") else ""
    if "_" in stem and stem not in PLAIN:
        return "".join(glyph_text(p) for p in stem.split("_"))
    if stem in PLAIN:
        return PLAIN[stem]
    if len(stem) == 1:
        return stem
    if re.fullmatch(r"uni([0-9A-F]{4})+", stem):
        return bytes.fromhex(stem[3:]).decode("utf-16-be", "replace")
    if re.fullmatch(r"u[0-9A-F]{4,6}", stem) and int(stem[1:], 16) < 0x110000:
        return chr(int(stem[1:], 16))
    for accent, mark in ACCENTS.items():
        if len(stem) == len(accent) + 1 and stem.endswith(accent) and stem[0].isalpha():
            return unicodedata.normalize("NFC", stem[0] + mark)
    if re.fullmatch(r"[A-Z]?[a-z]+", stem):
        kind = "CAPITAL" if stem[0].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"GREEK {kind} LETTER {'LAMDA' if stem.lower() == 'lambda' else stem.upper()}")
        except KeyError:
            pass
    if re.fullmatch(r"afii10(0[1-9]\d|1[0-4]\d)", stem):
        n = int(stem[4:])
        for first, point in ((10017, 0x410), (10065, 0x430)):
            # the letter after Ie stands apart from the order of code points
            if first <= n < first + 33:
                i = n - first
                return chr(point + i - (i > 6)) if i != 6 else chr(0x401 if point == 0x410 else 0x451)
    return ""
