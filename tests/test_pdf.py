"""Generated PDFs through the reader: cross-reference kinds, filters, forms, damage, streaming."""

import base64
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.__main__ import MODES, main
from quire.functions import documents
from quire.sources import ciphers, encodings, pdf, pdfkernel, pdfsample
from quire.streaming.files import glyph_stream


def build(pages, kind="table", pack=lambda d: (d, ""), damage=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold /FirstChar 32 /Widths [%s] >>" % b" ".join([b"500"] * 96), 4: b"<< /Title (T\\(x\\)) /Author <FEFF00E9> >>"}
    kids = []
    for i, content in enumerate(pages):
        data, extra = pack(content)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), extra.encode(), data)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(pages))
    out, at = bytearray(b"%PDF-1.5\n"), {}
    if kind == "stream":
        inner = [n for n in objects if b"stream\n" not in objects[n]]
        heads, body = [], b""
        for n in inner:
            heads.append(b"%d %d" % (n, len(body)))
            body += objects.pop(n) + b" "
        first = b" ".join(heads) + b" "
        data = zlib.compress(first + body)
        objects[50] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inner), len(first), len(data), data)
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    if kind == "table":
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(at.items()))
        out += b"trailer\n<< /Size 60 /Root 1 0 R /Info 4 0 R >>\n"
    else:
        rows = {n: (1, a, 0) for n, a in at.items()} | {n: (2, 50, i) for i, n in enumerate(inner)} | {60: (1, start, 0)}
        table = b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(r, p, strict=True)) for r, p in _up([rows.get(n, (0, 0, 0)) for n in range(61)]))
        data = zlib.compress(table)
        out += b"60 0 obj\n<< /Type /XRef /Size 61 /W [1 4 2] /Root 1 0 R /Info 4 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(data), data)
    out += b"startxref\n%d\n%%%%EOF" % (116 if damage else start)
    return bytes(out)


def _up(rows):
    flat = [bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows]
    return list(zip(flat, [bytes(7), *flat[:-1]], strict=True))


PAGE = b"BT /F1 12 Tf 50 700 Td (Hello page) Tj 0 -20 Td [(a) -1000 (b)] TJ ET"
PACKS = {
    "plain": lambda d: (d, ""),
    "flate": lambda d: (zlib.compress(d), "/Filter /FlateDecode "),
    "hex": lambda d: (d.hex().encode() + b">", "/Filter /ASCIIHexDecode "),
    "85": lambda d: (base64.a85encode(d) + b"~>", "/Filter [/ASCII85Decode] "),
    "run": lambda d: (b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80", "/Filter /RunLengthDecode "),
}


@pytest.mark.parametrize("kind", ["table", "stream"])
@pytest.mark.parametrize("pack", sorted(PACKS))
@pytest.mark.parametrize("damage", [False, True])
def test_texts_and_metadata(kind, pack, damage):
    doc = pdfkernel.Document.open(build([PAGE, PAGE.replace(b"page", b"two!")], kind, PACKS[pack], damage))
    assert doc.recovered == damage and doc.info() == {"Title": "T(x)", "Author": "é"}
    first, second = (pdfkernel.page_glyphs(doc, p) for p in doc.pages())
    assert "".join(g[5] for g in first) == "Hello pageab\n" and "".join(g[5] for g in second[:10]) == "Hello two!"
    assert first[0][:5] == ("Helvetica-Bold", 12, 50, 700, 6) and first[1][2] == 56
    assert first[11][2:4] == (50 + 6 + 12, 680)


def test_lzw_and_cmaps():
    assert pdfkernel.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    font = pdfkernel.Font(pdfkernel.Document(b""), {"Subtype": "Type0", "ToUnicode": pdfkernel.Stream({}, b"1 beginbfchar <0001> <0041> <0002> <4E2D> endbfchar 1 beginbfrange <0041> <005A> <0061> endbfrange")})
    assert [g[0] for g in font.glyphs(b"\x00\x01\x00\x02\x00\x42")] == ["A", "中", "b"]


def test_codespaces_and_used_maps():
    def texts(cmap, raw, **more):
        font = pdfkernel.Font(pdfkernel.Document(b""), {"Subtype": "Type0", "ToUnicode": pdfkernel.Stream({}, cmap)} | more)
        return [g[0] for g in font.glyphs(raw)]

    mixed = b"2 begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange 2 beginbfchar <41> <0061> <8140> <4E2D> endbfchar"
    assert texts(mixed, b"\x41\x81\x40\x42\xff\x41") == ["a", "中", "\ufffd", "\ufffd", "a"]
    used = b"/Identity-H usecmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar"
    assert texts(used, b"\x00\x01\x4e\x2d") == ["A", "中"]
    assert texts(used.replace(b"Identity-H", b"90ms-RKSJ-H"), "中".encode("cp932")) == ["中"]
    # a code cut off at the end, an empty text and a map without ranges
    assert texts(used, b"\x00\x01\x4e") == ["A", "\ufffd"] and texts(used, b"") == []
    assert texts(b"1 beginbfchar <0001> <0041> endbfchar", b"\x00\x01\x00\x42") == ["A", "B"]
    # ranges count for composite fonts alone
    assert texts(mixed, b"\x41\x42", Subtype="Type1") == ["a", "B"]


@pytest.mark.parametrize(("source", "value"), [(b"(a\\(b\\)\\101(c)\\\n)", b"a(b)A(c)"), (b"<48 65 6C6>", b"Hel`"), (b"/A#20B", "A B"), (b"[1 2 0 R -.5]", [1, pdfkernel.Ref(2, 0), -0.5]), (b"<< /A << /B true >> /C null >>", {"A": {"B": True}, "C": None}), (b"% x\n7", 7)])
def test_lexer(source, value):
    assert pdfkernel.Lexer(source).value() == value


def test_forms_that_call_themselves_end():
    form = pdfkernel.Stream({"Subtype": pdfkernel.Name("Form")}, b"BT /F1 10 Tf (x) Tj ET /Me Do")
    resources = {"XObject": {"Me": form}, "Font": {"F1": {}}}
    got = pdfkernel.page_glyphs(pdfkernel.Document(b""), {"Resources": resources, "Contents": pdfkernel.Stream({}, b"/Me Do")})
    assert [g[5] for g in got] == ["x", "x"]


def test_tables_and_stream(spark, tmp_path):
    for i, data in enumerate([build([PAGE] * 3), build([PAGE], "stream", damage=True), b"not a pdf", b""]):
        (tmp_path / f"{i}.pdf").write_bytes(data)
    table = pdf.files(spark, str(tmp_path))
    rows = pdf.glyphs(table)
    texts = sorted((r.path[-5], r.page_num, r.text) for r in pdf.page_text(rows).collect())
    assert texts == [("0", 1, "Hello page\nab"), ("0", 2, "Hello page\nab"), ("0", 3, "Hello page\nab"), ("1", 1, "Hello page\nab")]
    assert [r.path[-5] for r in rows.where("error is not null").collect()] == ["2"]  # Spark's file sources pass over empty files
    empty = spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")
    assert sorted(r.path for r in pdf.glyphs(empty).where("error is not null").collect()) == ["a", "b"]
    info = {r.path[-5]: r for r in pdf.metadata(table).collect()}
    assert (info["0"].pages, info["0"].version, info["0"].info["Title"]) == (3, "1.5", "T(x)") and info["1"].recovered and info["2"].error
    query = glyph_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("glyph_rows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("glyph_rows").where("error is null").count() == rows.where("error is null").count()


@pytest.mark.parametrize("scheme", sorted(pdfsample.SCHEMES))
@pytest.mark.parametrize("damage", [False, True])
def test_encrypted(scheme, damage):
    data = pdfsample.make("one\ntwo", "títle", pdfsample.lock(scheme, "us", "own"))
    data = data.replace(b"startxref\n", b"startxref\n9") if damage else data
    for words in (("us",), ("no", "own")):
        doc = pdfkernel.Document.open(data, words)
        assert doc.recovered == damage and doc.info() == {"Title": "títle"} and doc.outline() == [(0, "page 1")]
        assert "".join(g[5] for g in pdfkernel.page_glyphs(doc, doc.pages()[0])) == "onetwo"
        assert doc.cipher.permits(3) and not doc.cipher.permits(1)
    with pytest.raises(pdfkernel.PdfError, match="password"):
        pdfkernel.Document.open(data, ("no",))


def test_ciphers_by_published_vectors():
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    hidden = bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    assert ciphers.aes_encrypt(key, iv, plain) == hidden and ciphers.aes_decrypt(key, iv, hidden) == plain
    long = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    assert ciphers.aes_encrypt(long, iv, plain)[:16].hex() == "f58c4c04d6e5f1ba779eabfb5f7bfbd6"
    assert ciphers.aes_decrypt(long, iv, ciphers.aes_encrypt(long, iv, plain)) == plain
    assert ciphers.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert ciphers.unpad(b"ab" + b"\x02\x02") == b"ab" and ciphers.unpad(b"") == b""


@pytest.mark.parametrize(("name", "value"), [("Aacute", "Á"), ("ccedilla", "ç"), ("uni00410042", "AB"), ("u1F600", "😀"), ("alpha", "α"), ("Omega", "Ω"), ("afii10017", "А"), ("afii10023", "Ё"), ("afii10097", "я"), ("f_f.alt", "ff"), (".notdef", ""), ("nosuchname", ""), ("Scaron", "Š"), ("space", " ")])
def test_glyph_names(name, value):
    assert encodings.glyph_text(name) == value


def test_differences_and_predefined_maps():
    name, doc = pdfkernel.Name, pdfkernel.Document(b"")
    plain = pdfkernel.Font(doc, {"Subtype": name("Type3"), "Encoding": {"Differences": [65, name("eacute"), name("alpha"), 97, name("fi")]}})
    assert "".join(g[0] for g in plain.glyphs(b"ABCa")) == "éαCﬁ"
    wide = pdfkernel.Font(doc, {"Subtype": name("Type0"), "Encoding": name("GBK-EUC-H")})
    assert "".join(g[0] for g in wide.glyphs("中A文".encode("gbk"))) == "中A文"
    kana = pdfkernel.Font(doc, {"Subtype": name("Type0"), "Encoding": name("90ms-RKSJ-V")})
    assert "".join(g[0] for g in kana.glyphs("ｱ漢b".encode("cp932"))) == "ｱ漢b"
    below = pdfkernel.Font(doc, {"Subtype": name("Type0"), "Encoding": name("Identity-H"), "DescendantFonts": [{"ToUnicode": pdfkernel.Stream({}, b"1 beginbfchar <0001> <0041> endbfchar")}]})
    assert [g[0] for g in below.glyphs(b"\x00\x01")] == ["A"]


def test_objects_as_text():
    value = pdfkernel.Lexer(b"<< /B [1 2.50 true null (a\"b)] /A 3 0 R /C /N >>").value()
    assert pdfkernel.shown(value) == '<</A 3 0 R /B [1 2.5 true null "a\\"b"] /C /N>>'
    doc = pdfkernel.Document(b"%PDF-1.4\n1 0 obj\n<< /Linearized 1 /L 9 >>\nendobj")
    assert doc.linearization() == {"Linearized": "1", "L": "9"}


def test_parts_of_documents_that_cannot_be_read(spark):
    broken = spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")
    for name in ("outline", "page_fonts", "rects", "objects", "linearization", "trailer"):
        assert sorted(r.path for r in pdf.part(broken, name).where("error is not null").collect()) == ["a", "b"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(pdfsample.make("One line\nand two", "t", pdfsample.lock("AES-128", "word", "own")))
    for mode in MODES:
        assert main([str(tmp_path), "--mode", mode, "--password", "word", "--page", "1"], spark) == 0
        rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        shown = "".join(str(r.get("text", r.get("content", r.get("s")))) for r in rows)
        assert set("Onelineandtwo") <= set(shown) and all(r["page_num"] == 1 for r in rows)
        if mode == "plain":
            assert shown == "One line\nand two"


def test_limits(monkeypatch):
    doc = pdfkernel.Document.open(build([PAGE], pack=PACKS["flate"]))
    with pytest.raises(pdfkernel.PdfError, match="too long"):
        pdfkernel.page_glyphs(doc, doc.pages()[0], seconds=-1)
    monkeypatch.setattr(pdfkernel, "STREAM_BYTES", 10)
    with pytest.raises(pdfkernel.PdfError, match="stream is too long"):
        pdfkernel.page_glyphs(doc, doc.pages()[0])


def test_metadata_as_lines(spark):
    info = spark.createDataFrame([({"Zed": "z", "_HasXMP": "true", "Author": "me", "Title": "T", "Subject": ""},), ({},)], "info map<string,string>")
    assert [r[0] for r in info.select(documents.printed(F.col("info"))).collect()] == ["Title: T\nAuthor: me\nZed: z", ""]


def test_any_damage_is_an_error_of_its_file(spark):
    good = pdfsample.make("One line", "t")
    bad = re.sub(rb"/Resources\s*<<", b"/Resources [ 1 ] /Other <<", good)
    assert bad != good
    rows = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad))], "path string, content binary")
    got = pdf.glyphs(rows).collect()
    assert any(r.path == "good" and r.s == "O" for r in got) and all(r.error for r in got if r.path == "bad")


def test_filters_have_a_limit(monkeypatch):
    assert pdfkernel.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    assert pdfkernel.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    monkeypatch.setattr(pdfkernel, "STREAM_BYTES", 5)
    for unpack, data in ((pdfkernel.run_length, b"\xfed" * 9), (pdfkernel.lzw, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))):
        with pytest.raises(pdfkernel.PdfError, match="too long"):
            unpack(data)


def test_strings_are_placed_by_tm_and_forms_alone():
    form = pdfkernel.Stream({"Subtype": pdfkernel.Name("Form"), "Matrix": [1, 0, 0, 1, 5, 7]}, b"BT 1 0 0 1 10 20 Tm (inner) Tj ET")
    body = b"2 0 0 2 0 0 cm BT /F1 12 Tf (at once) Tj 1 0 0 1 50 700 Tm [(a) -250 (b)] TJ 0 -20 Td (c) Tj T* (d) ' 1 2 (e) \" ET /Me Do"
    page = {"Resources": {"XObject": {"Me": form}, "Font": {"F1": {}}}, "Contents": pdfkernel.Stream({}, body)}
    got = pdfkernel.page_strings(pdfkernel.Document(b""), page)
    assert got == [(0, 0, "at once"), (50, 700, "a"), (50, 700, "b"), (50, 700, ""), (50, 700, "c"), (50, 700, "d"), (50, 700, "e"), (15, 27, "inner")]
    endless = pdfkernel.Stream({"Subtype": pdfkernel.Name("Form")}, b"(x) Tj /Me Do")
    got = pdfkernel.page_strings(pdfkernel.Document(b""), {"Resources": {"XObject": {"Me": endless}}, "Contents": pdfkernel.Stream({}, b"(only 1 Tj /Me Do")})
    assert got == []
    got = pdfkernel.page_strings(pdfkernel.Document(b""), {"Resources": {"XObject": {"Me": endless}}, "Contents": pdfkernel.Stream({}, b"/Me Do 1 Tj")})
    assert [s for *_, s in got] == ["x", "x"]


def test_rows_and_columns_of_files(spark):
    doc = build([b"BT /F1 12 Tf 1 0 0 1 50 700.9 Tm (b) Tj 1 0 0 1 20 700.1 Tm (a) Tj 1 0 0 1 20.5 -0.5 Tm (c) Tj 0 0 Td ET"])
    strings = pdf.part(spark.createDataFrame([("p", doc), ("q", b"")], "path string, content binary"), "strings")
    assert strings.where("error is not null").count() == 1
    assert sorted((r.position, r.content, r.n) for r in pdf.lined(strings).collect()) == [(0, "c", 1), (700, "a b", 2)]
    assert sorted((r.position, r.content, r.n) for r in pdf.lined(strings, "x").collect()) == [(20, "a c", 2), (50, "b", 1)]


def test_forms_see_the_fonts_around_them():
    deep = pdfkernel.Stream({"Subtype": pdfkernel.Name("Form"), "Resources": {"Font": {"F2": {"BaseFont": pdfkernel.Name("Two")}}}}, b"BT /F1 10 Tf (x) Tj /F2 10 Tf (y) Tj ET")
    page = {"Resources": {"XObject": {"Me": deep}, "Font": {"F1": {"BaseFont": pdfkernel.Name("One")}}}, "Contents": pdfkernel.Stream({}, b"/Me Do")}
    assert [(g[0], g[5]) for g in pdfkernel.page_glyphs(pdfkernel.Document(b""), page)] == [("One", "x"), ("Two", "y")]


def test_vertical_marks_and_widths_of_composite_fonts(spark):
    name = pdfkernel.Name
    head = {"Subtype": name("Type0"), "Encoding": name("Identity-V"), "DescendantFonts": [{"WMode": 1, "DW": 800, "W": [65, [500]]}]}
    page = {"Resources": {"Font": {"F1": head}}, "Contents": pdfkernel.Stream({}, b"BT /F1 10 Tf <00410042> Tj ET")}
    doc = pdfkernel.Document(b"")
    assert [g[2:] for g in pdfkernel.page_glyphs(doc, page)] == [(0, 0, 0, "A", True), (0, 0, 0, "B", True)]
    assert [g[2:] for g in pdfkernel.page_glyphs(doc, page, metrics=True)] == [(0, 0, 5, "A", True), (5, 0, 8, "B", True)]
    runs = pdf.for_layout(pdf.glyphs(spark.createDataFrame([("p", pdfsample.make("one", "t"))], "path string, content binary"), metrics=True))
    assert [r.vertical for r in runs.collect()] == [False] * 3


#: Strings that are placed by arrays and ones that aren't, slanted and upright, out of order and with line marks.
LONG = b"BT /F1 12 Tf 3 Tc 50 700 Td (a longer string of a line) Tj 1 0 0 1 20 699 Tm (left of it, below) Tj .7 .7 -.7 .7 300 300 Tm (slanted upwards) Tj 2 Ts 80 Tz 0 -1 1 0 90 90 Tm (short) Tj [(and a longer one) -9000 (e)] TJ -1 0 0 1 400 698.5 Tm (from the right) Tj 1 0 0 1 20 500 Tm (with\\012a line mark) Tj ET"


def one_by_one(monkeypatch):
    monkeypatch.setattr(pdfkernel, "_LONG", 1 << 40)


def test_strings_by_arrays_as_one_by_one(monkeypatch):
    doc = pdfkernel.Document.open(build([LONG]))
    runs = pdfkernel.page_runs(doc, doc.pages()[0])
    assert sum(isinstance(r.x, np.ndarray) for r in runs) == 6 and sum(isinstance(r.y, float | int) for r in runs) == 4
    fast = pdfkernel.page_glyphs(doc, doc.pages()[0])
    one_by_one(monkeypatch)
    assert fast == pdfkernel.page_glyphs(doc, doc.pages()[0]) and len(fast) > 100


def test_codes_that_arrays_do_not_hold():
    font = pdfkernel.Font(pdfkernel.Document(b""), {"Subtype": "Type1", "FirstChar": 65, "Widths": [500, None, "odd"], "ToUnicode": pdfkernel.Stream({}, b"1 beginbfchar <61> <00660066> endbfchar")})
    assert font.cells(b"AaA") is None and font.cells(b"AC") is None and font.cells(b"ABA")[0] == "ABA" and font.cells(b"BA")[1].tolist() == [0, 500]
    page = {"Resources": {"Font": {"F1": {"FirstChar": 65, "Widths": [500, 500, pdfkernel.Name("odd")]}}}, "Contents": pdfkernel.Stream({}, b"BT /F1 10 Tf (AAAABBBBCAAA) Tj (AB) Tj ET")}
    assert "".join(g[5] for g in pdfkernel.page_glyphs(pdfkernel.Document(b""), page)) == "AAAABBBBAB"


def test_glyph_ends_of_pages_as_of_rows(spark):
    files = spark.createDataFrame([("a", build([LONG, PAGE, b""])), ("b", b"no"), ("c", pdfsample.make("one\n\ntwo", "t"))], "path string, content binary")
    rows = pdf.glyphs(files)
    want = rows.where("error is null").groupBy("path", "page_num").agg(F.count("*"), F.min("x"), F.max(F.col("x") + F.col("w")), F.min("y"), F.max("y"))
    got = pdf.page_extents(files)
    assert sorted(got.where("error is null").drop("error").collect()) == sorted(want.collect()) and want.count() == 3
    assert [(r.path, r.page_num, r.n) for r in got.where("error is not null").collect()] == [("b", None, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_operators_and_values_of_contents():
    got = list(pdfkernel._operations(b"1 -.5 2. Td null true /A 1 0 R 3 x% 4\n5 (a)Tj[1 0 R 2]TJ [7 8] TJ \x006 w 1 2\x00m T* ' 9"))
    assert got == [("Td", [1, -0.5, 2.0]), ("x", [None, True, "A", pdfkernel.Ref(1, 0), 3]), ("Tj", [5, b"a"]), ("TJ", [[pdfkernel.Ref(1, 0), 2]]), ("TJ", [[7, 8]]), ("w", [6]), ("m", [1, 2]), ("T*", []), ("'", [])]


@pytest.mark.skipif(ciphers._library() is None, reason="no library of ciphers")
def test_ciphers_of_the_library_as_in_python(monkeypatch):
    for n in (0, 1, 15, 16, 33, 400):
        data = bytes(i * 7 & 255 for i in range(n))
        for size in (5, 16, 24, 32):
            key, whole = bytes(range(size)), data[: n // 16 * 16]
            assert ciphers.rc4(key, data) == ciphers.rc4_plain(key, data)
            if size > 5:
                assert ciphers.aes_encrypt(key, key[:16], whole) == ciphers.aes_encrypt_plain(key, key[:16], whole)
                assert ciphers.aes_decrypt(key, key[:16], data) == ciphers.aes_decrypt_plain(key, key[:16], whole)
    called = []
    monkeypatch.setattr(ciphers, "rc4_plain", lambda *a: called.append(a))
    monkeypatch.setattr(ciphers, "aes_encrypt_plain", lambda *a: called.append(a))
    monkeypatch.setattr(ciphers, "aes_decrypt_plain", lambda *a: called.append(a))
    for scheme in pdfsample.SCHEMES:
        assert pdfkernel.Document.open(pdfsample.make("one", "t", pdfsample.lock(scheme, "us", "own")), ("us",)).info() == {"Title": "t"}
    assert not called


@pytest.mark.parametrize("scheme", sorted(pdfsample.SCHEMES))
def test_ciphers_without_the_library(scheme, monkeypatch):
    data = pdfsample.make("one", "t", pdfsample.lock(scheme, "us", "own"))
    monkeypatch.setattr(ciphers, "_library", lambda: None)
    ciphers._TRIED.clear()
    ciphers.hardened.cache_clear()
    assert pdfsample.make("one", "t", pdfsample.lock(scheme, "us", "own")) == data
    assert pdfkernel.Document.open(data, ("own",)).info() == {"Title": "t"}


def test_passwords_of_files_with_the_same_marks_are_tried_once(monkeypatch):
    ciphers._TRIED.clear()
    data = pdfsample.make("one", "t", pdfsample.lock("RC4-128", "us", "own"))
    other = pdfsample.make("two", "t", pdfsample.lock("RC4-128", "them", "own"))
    tries, found = [], ciphers.Handler._try
    monkeypatch.setattr(ciphers.Handler, "_try", lambda self, words: tries.append(words) or found(self, words))
    for _ in range(3):
        assert pdfkernel.Document.open(data, ("us",)).info() == {"Title": "t"}
        for file, words in ((data, ("no",)), (other, ("us",))):
            with pytest.raises(pdfkernel.PdfError, match="password"):
                pdfkernel.Document.open(file, words)
    assert tries == [["", "us"], ["", "no"], ["", "us"]]


def test_texts_of_pages_as_of_rows(spark, monkeypatch):
    upright = b"BT /F1 12 Tf 0 1 -1 0 200 300 Tm (all of one x and many y) Tj 1 0 0 1 200 301 Tm (tie) Tj 1 0 0 1 200 299.5 Tm (a tie of a longer one) Tj 1 0 0 1 10 303 Tm (\\012\\012\\012\\012\\012\\012\\012\\012\\012) Tj ET"
    # lines by a fold from the top: 700, 698.5 and 698 are one, 697.9 begins the next
    fold = b"BT /F1 12 Tf 1 0 0 1 50 698 Tm (third of the first) Tj 1 0 0 1 20 697.9 Tm (the second line) Tj 1 0 0 1 50 700 Tm (first of the first) Tj 1 0 0 1 52 698.5 Tm (b) Tj 1 0 0 1 20 695.9 Tm (still the second) Tj ET"
    marks = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (\\012) Tj [] TJ ET"
    files = spark.createDataFrame([("a", build([LONG, upright, b"", fold, marks, PAGE])), ("b", b"no"), ("c", pdfsample.make("one\n\ntwo", "t")), ("d", None)], "path string, content binary")
    for tolerance in (2.0, 0.0, 30.0):
        want, got = pdf.page_text(pdf.glyphs(files), tolerance), pdf.page_texts(files, tolerance=tolerance)
        assert sorted(got.where("error is null").drop("error").collect()) == sorted(want.collect())
    assert sorted((r.path, r.page_num, r.text) for r in got.where("error is not null").collect()) == [("b", None, None), ("d", None, None)]
    assert want.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_texts_of_pages_beside_broken_ones(spark):
    bad = build([PAGE] * 3).replace(b"/Contents 13 0 R", b"/Contents 13 0 R /Resources 7")
    rows = pdf.page_texts(spark.createDataFrame([("x", bad)], "path string, content binary")).collect()
    assert sorted((r.page_num, r.text, bool(r.error)) for r in rows) == [(1, "Hello page\nab", False), (2, None, True), (3, "Hello page\nab", False)]
