"""Checks over the bytes of a document (as a Latin-1 string) and its metadata strings, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(data: Column, *marks: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(data, F.lit(m)) for m in marks])


def issues(*pairs: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, m) for c, m in pairs])), "; ")


def sub_format(data: Column) -> Column:
    return (
        F.when(has(data, "pdfaid:part") & has(data, "pdfaid:conformance"), "PDF/A")
        .when(has(data, "pdfx:", "PDF/X"), "PDF/X")
        .when(has(data, "/GTS_PDFA"), "PDF/A")
        .when(has(data, "/GTS_PDFX"), "PDF/X")
        .otherwise("")
    )


def flags(data: Column) -> dict[str, Column]:
    return {
        "linearized": has(data, "/Linearized"),
        "transparency": has(data, "/GS", "/SMask", "/BM"),
        "layers": has(data, "/OCG", "/D"),
        "forms": has(data, "/AcroForm", "/FT"),
        "javascript": has(data, "/JS", "/JavaScript"),
    }


def pdfa_issues(data: Column) -> Column:
    return issues(
        (~has(data, "pdfaid:part"), "Missing PDF/A identification metadata"),
        (~has(data, "/Font"), "No fonts found - PDF/A requires all fonts to be embedded"),
        (has(data, "/SMask", "/BM"), "Transparency found - not allowed in PDF/A-1"),
        (has(data, "/JS", "/JavaScript"), "JavaScript found - not allowed in PDF/A"),
    )


def pdfx_issues(data: Column) -> Column:
    return issues(
        (~has(data, "pdfx:", "/GTS_PDFX"), "Missing PDF/X identification metadata"),
        (~has(data, "/OutputIntents"), "Missing output intents - required for PDF/X"),
        (~has(data, "/ColorSpace"), "No color space definitions found"),
    )


def integrity(data: Column) -> dict[str, Column]:
    """Header in the first KiB, end marks in the last 4 KiB, objects estimated from the first 512 KiB."""
    size = F.length(data)
    small = size < 20
    header = has(F.substring(data, F.lit(1), F.lit(1024)), "%PDF-")
    tail = F.substring(data, F.greatest(size - 4095, F.lit(1)), F.lit(4096))
    eof, start, xref = has(tail, "%%EOF"), has(tail, "startxref"), has(tail, "xref", "/Type /XRef", "/Type/XRef")
    trailer = has(tail, "trailer") | xref
    sample = F.substring(data, F.lit(1), F.lit(512 * 1024))
    objects = ((F.length(sample) - F.length(F.replace(sample, F.lit(" obj"), F.lit("")))) / 4).cast("bigint")
    scaled = F.when(size > 512 * 1024, F.floor(objects * size / (512 * 1024))).otherwise(objects)
    looked = ~small & header
    rest = [
        (looked & ~eof, "missing %%EOF marker (file may be truncated)"),
        (looked & ~start, "missing startxref marker"),
        (looked & ~xref, "xref table/stream not found in expected location"),
        (looked & ~trailer, "trailer not found"),
    ]
    n = reduce(lambda a, b: a + b, [c.cast("int") for c, _ in rest])
    return {
        "has_header": looked,
        "has_eof": looked & eof,
        "has_startxref": looked & start,
        "has_xref": looked & xref,
        "objects": F.when(looked, scaled).otherwise(0).cast("bigint"),
        "valid": looked & (start | xref | (n < 3)),
        "issues": issues((small, "file too small to be a valid PDF"), (~small & ~header, "missing PDF header"), *rest),
    }


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` and an optional offset, as a UTC timestamp; fields out of range roll over."""
    part = lambda at, n: F.when(F.substring(raw, F.lit(at), F.lit(n)).rlike(r"^\d+$"), F.substring(raw, F.lit(at), F.lit(n)).cast("int")).otherwise(0)
    sign = F.when(F.substring(raw, F.lit(17), F.lit(1)) == "-", -1).when(F.substring(raw, F.lit(17), F.lit(1)) == "+", 1).otherwise(0)
    start = F.make_timestamp(part(3, 4), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    shift = F.make_interval(F.lit(0), part(7, 2) - 1, F.lit(0), part(9, 2) - 1, part(11, 2) - sign * part(18, 2), part(13, 2) - sign * part(21, 2), part(15, 2).cast("decimal(18,6)"))
    return F.when(F.startswith(raw, F.lit("D:")) & (F.length(raw) >= 16), start + shift)


def keywords(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "[,;]"), lambda k: F.trim(k)), lambda k: k != "")


#: The metadata fields with a label, in the order of printing.
LABELLED = ["Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"]


def printed(info: Column) -> Column:
    """A metadata map as lines: labelled fields, then the others by name; those whose name begins with ``_`` and empty ones are
    left out."""
    known = F.transform(F.array(*[F.lit(k) for k in LABELLED]), lambda k: F.struct(k.alias("key"), F.try_element_at(info, k).alias("value")))
    other = F.filter(F.array_sort(F.map_entries(info)), lambda e: ~e["key"].isin(LABELLED) & ~F.startswith(e["key"], F.lit("_")))
    lines = F.concat(F.transform(known, lambda e: F.when(e["value"] != "", F.concat_ws(": ", e["key"], e["value"]))), F.transform(other, lambda e: F.when(e["value"] != "", F.concat_ws(": ", e["key"], e["value"]))))
    return F.array_join(F.array_compact(lines), "\n")
