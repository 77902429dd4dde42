"""Small PDF files made from texts, as input for queries and benchmarks of the reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources.ciphers import PAD, Handler, aes_encrypt, hardened, rc4

LINES = 35


#: Encrypt dictionaries by scheme, without their marks.
SCHEMES = {
    "RC4-40": {"V": 1, "R": 2},
    "RC4-128": {"V": 2, "R": 3, "Length": 128},
    "AES-128": {"V": 4, "R": 4, "Length": 128, "CF": {"StdCF": {"CFM": "AESV2"}}, "StmF": "StdCF", "StrF": "StdCF"},
    "AES-256": {"V": 5, "R": 6, "Length": 256, "CF": {"StdCF": {"CFM": "AESV3"}}, "StmF": "StdCF", "StrF": "StdCF"},
}
ID = bytes(range(16))


def lock(scheme: str, user: str, owner: str) -> Handler:
    """A handler of the scheme that both passwords open; salts and keys are fixed, as the files are samples."""
    head = SCHEMES[scheme] | {"P": -4, "O": b"", "U": b""}
    own = Handler(head, ID)
    if own.version == 5:
        own.key, u, o = bytes(range(32)), user.encode(), owner.encode()
        head["U"] = hardened(u, b"saltuser") + b"saltuserkey-user"
        head["UE"] = aes_encrypt(hardened(u, b"key-user"), bytes(16), own.key)
        head["O"] = hardened(o, b"saltownr", head["U"]) + b"saltownrkey-ownr"
        head["OE"] = aes_encrypt(hardened(o, b"key-ownr", head["U"]), bytes(16), own.key)
        return own
    word, key = (user.encode("latin-1") + PAD)[:32], own.owner_key(owner.encode("latin-1"))
    for i in range(20 if own.revision >= 3 else 1):
        word = rc4(bytes(b ^ i for b in key), word)
    head["O"] = word
    own.key = own.file_key(user.encode("latin-1"))
    head["U"] = own.user_mark(own.key).ljust(32, b"\0")
    return own


def _shown(value) -> bytes:
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, dict):
        return b"<< " + b" ".join(b"/" + k.encode() + b" " + _shown(v) for k, v in value.items()) + b" >>"
    return b"/" + value.encode() if isinstance(value, str) else str(value).encode()


def make(text: str, title: str, cipher: Handler | None = None) -> bytes:
    """One line of text per baseline, LINES lines a page, Helvetica at 12 points with all widths 500; a frame and an entry of the
    outline for each page."""
    hidden = (lambda data, num, use: cipher.encrypt(data, num, 0, use, hashlib.md5(b"%d" % num).digest())) if cipher else (lambda data, num, use: data)
    lines = text.split("\n")
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    n = len(pages)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines %d 0 R >>" % (5 + 2 * n),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [" + b"500 " * 256 + b"] >>",
        4: b"<< /Title " + _shown(hidden(b"\xfe\xff" + title.encode("utf-16-be"), 4, "StrF")) + b" >>",
        5 + 2 * n: b"<< /First %d 0 R /Last %d 0 R >>" % (6 + 2 * n, 5 + 3 * n),
    }
    for i, page in enumerate(pages):
        body = b"40 40 532 740 re S\nBT /F1 12 Tf 50 760 Td 0 TL\n" + b"".join(b"<%s> Tj 0 -20 Td\n" % x.encode("cp1252", "replace").hex().encode() if not k else b"1 0 0 1 50 %d Tm <%s> Tj\n" % (760 - 20 * k, x.encode("cp1252", "replace").hex().encode()) for k, x in enumerate(page)) + b"ET"
        body = hidden(body, 6 + 2 * i, "StmF")
        objects[5 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * i)
        objects[6 + 2 * i] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
        after = b" /Next %d 0 R" % (7 + 2 * n + i) if i + 1 < n else b""
        objects[6 + 2 * n + i] = b"<< /Title " + _shown(hidden(b"page %d" % (i + 1), 6 + 2 * n + i, "StrF")) + after + b" >>"
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n)), n)
    if cipher:
        objects[6 + 3 * n] = _shown({"Filter": "Standard"} | cipher.head)
    out, table = bytearray(b"%PDF-1.4\n"), []
    for num in sorted(objects):
        table.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (num, objects[num])
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(table) + 1) + b"".join(b"%010d 00000 n \n" % a for a in table)
    locked = b" /ID [%s %s] /Encrypt %d 0 R" % (_shown(ID), _shown(ID), 6 + 3 * n) if cipher else b""
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(table) + 1, locked, start))


def from_texts(documents: DataFrame, password: str | None = None) -> DataFrame:
    """(path, content) with a PDF for each row of (doc_id, text) that has a text; the path is the id.

    With a password files are encrypted for it, by the schemes in turn.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ciphers = [lock(scheme, password, "owner") for scheme in SCHEMES] if password is not None else [None]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 200).columns)
                yield pa.record_batch([pa.array([str(i) for i in ids], pa.string()), pa.array([make(t, f"document {i}", ciphers[i % len(ciphers)]) for i, t in zip(ids, texts, strict=True)], pa.binary())], ["path", "content"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(work, "path string, content binary")
