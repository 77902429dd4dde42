"""Type 1 and CFF programs built by hand, and metrics of composite fonts."""

import pytest

from quire.sources import pdfkernel
from quire.sources.fontprograms import CidMetrics, Cff, Type1, charstring_width, codespaces, uncover


def cover(data, key, lead=b"\0\0\0\0"):
    out = bytearray()
    for b in lead + data:
        c = b ^ key >> 8
        out.append(c)
        key = ((c + key) * 52845 + 22719) & 0xFFFF
    return bytes(out)


def num(n):
    """A number as Type 1 and CFF programs write it."""
    if -107 <= n <= 107:
        return bytes([n + 139])
    return bytes([247 + (n - 108 >> 8), (n - 108) & 255]) if 108 <= n <= 1131 else bytes([251 + (-n - 108 >> 8), (-n - 108) & 255])


def type1(digits=False, pfb=False):
    a = cover(num(20) + num(600) + bytes([13, 14]), 4330)
    by_subr = cover(num(0) + bytes([10, 14]), 4330)
    subr = cover(num(-5) + num(-250) + bytes([13, 11]), 4330)
    private = b"dup /Private 8 dict dup begin /lenIV 4 def /Subrs 1 array dup 0 %d RD %s NP /CharStrings 2 dict dup begin /A %d RD %s ND /B %d -| %s |- end" % (len(subr), subr, len(a), a, len(by_subr), by_subr)
    clear = b"%!PS-AdobeFont-1.0: T\n/FontName /Test-Font def /FontMatrix [0.001 0 0 0.001 0 0] readonly def /Encoding 256 array dup 65 /A put dup 66 /B put currentfile eexec\n"
    hidden = cover(private, 55665, b"zzzz")
    hidden = hidden.hex().encode() if digits else hidden
    if pfb:
        return b"".join(b"\x80" + bytes([k]) + len(d).to_bytes(4, "little") + d for k, d in ((1, clear), (2, hidden))) + b"\x80\x03"
    return clear + hidden


@pytest.mark.parametrize("digits", [False, True])
@pytest.mark.parametrize("pfb", [False, True])
def test_type1(digits, pfb):
    font = Type1.read(type1(digits, pfb))
    assert font.name == "Test-Font" and font.encoding == {65: "A", 66: "B"} and font.matrix[0] == 0.001
    assert sorted(font.charstrings) == ["A", "B"] and font.width("A") == 600 and font.width("B") == -250 and font.width("C") == 0


def test_type1_parts():
    assert uncover(cover(b"text", 4330), 4330) == b"text"
    assert charstring_width(num(1) + num(2) + num(300) + num(4) + bytes([12, 7])) == (1, 300)
    assert charstring_width(num(0) + num(900) + num(3) + bytes([12, 12, 13])) == (0, 300)
    assert charstring_width(b"") is None and charstring_width(num(0) + bytes([10]), {0: num(0) + bytes([10])}) is None
    with pytest.raises(pdfkernel.PdfError):
        Type1.read(b"nothing")


def index(items):
    if not items:
        return b"\0\0"
    places, at = [], 1
    for i in items:
        places.append(at)
        at += len(i)
    return len(items).to_bytes(2, "big") + b"\x02" + b"".join(p.to_bytes(2, "big") for p in [*places, at]) + b"".join(items)


def op32(n):
    return b"\x1d" + n.to_bytes(4, "big", signed=True)


def cff(cid=False, base=0):
    glyphs = index([bytes([14]), num(50) + num(10) + bytes([22, 14]), num(10) + bytes([22, 14]), num(-20) + num(1) + num(2) + bytes([21, 14])])
    charset = bytes([1]) + (391).to_bytes(2, "big") + b"\x02"
    chooser = bytes([3]) + (1).to_bytes(2, "big") + (0).to_bytes(2, "big") + b"\0" + (4).to_bytes(2, "big")
    private = num(500) + bytes([20]) + num(600) + bytes([21])
    at_glyphs = base + len(charset)
    at_private = at_glyphs + len(glyphs)
    at_chooser = at_private + len(private)
    place = op32(len(private)) + op32(at_private) + bytes([18])
    top, tail = op32(base) + bytes([15]) + op32(at_glyphs) + bytes([17]), b""
    if cid:
        top = num(0) * 3 + bytes([12, 30]) + top + op32(at_chooser + len(chooser)) + bytes([12, 36]) + op32(at_chooser) + bytes([12, 37])
        tail = chooser + index([place])
    else:
        top += place
    front = b"\x01\x00\x04\x02" + index([b"Test-CFF"]) + index([top]) + index([b"one", b"two", b"three"]) + index([])
    # numbers of five bytes keep the front's size whatever the base is
    return front + charset + glyphs + private + tail if base else cff(cid, len(front))


def test_cff():
    font = Cff.read(cff())
    assert font.name == "Test-CFF" and not font.cid and font.charset == [0, 391, 392, 393]
    assert [font.string(s) for s in font.charset] == [None, "one", "two", "three"]
    assert [font.width(i) for i in range(5)] == [500, 650, 500, 580, 0]
    for bad in (b"", b"\x02\0\4\1", b"\1\0\4\1\0\0\0\0\0\0\0\0"):
        with pytest.raises(pdfkernel.PdfError):
            Cff.read(bad)


def test_cff_cid():
    font = Cff.read(cff(True))
    assert font.cid and font.chooser == [0, 0, 0, 0] and [font.width(i) for i in range(4)] == [500, 650, 500, 580]


def test_metrics_of_composite_fonts():
    doc = pdfkernel.Document(b"")
    head = pdfkernel.Lexer(b"<< /DW 900 /W [1 [500 600] 10 12 250] /DW2 [800 -900] /W2 [5 [-1 2 3] 7 8 -4 5 6] >>").value()
    head["CIDToGIDMap"] = pdfkernel.Stream({}, b"\0\0\0\7")
    m = CidMetrics.read(doc, head)
    assert [m.width(i) for i in (0, 1, 2, 3, 10, 12, 13)] == [900, 500, 600, 900, 250, 250, 900]
    assert m.down(5) == (-1, 2, 3) and m.down(8) == (-4, 5, 6) and m.down(1) == (-900, 250, 800)
    assert m.glyph(1) == 7 and CidMetrics.read(doc, {}).glyph(9) == 9


def test_codespaces():
    assert codespaces(b"/CIDInit 2 begincodespacerange <00> <80> <8140> <FEFE> endcodespacerange") == [(b"\0", b"\x80"), (b"\x81\x40", b"\xfe\xfe")]


def test_widths_from_an_embedded_program():
    for data, want in ((type1(), [("A", 600), ("B", -250), ("C", 0)]), (b"nothing", [("A", 0), ("B", 0), ("C", 0)])):
        head = {"Subtype": pdfkernel.Name("Type1"), "FontDescriptor": {"FontFile": pdfkernel.Stream({}, data)}}
        got = list(pdfkernel.Font(pdfkernel.Document(b""), head, metrics=True).glyphs(b"ABC"))
        assert [s for s, _ in got] == ["A", "B", "C"] and [w for _, w in got] == pytest.approx([w for _, w in want])
        assert [w for _, w in pdfkernel.Font(pdfkernel.Document(b""), head).glyphs(b"ABC")] == [0, 0, 0]
    listed = head | {"FirstChar": 65, "Widths": [333], "FontDescriptor": {"FontFile": pdfkernel.Stream({}, type1())}}
    assert [w for _, w in pdfkernel.Font(pdfkernel.Document(b""), listed, metrics=True).glyphs(b"AB")] == pytest.approx([333, -250])
