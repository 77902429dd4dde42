"""Font programs: Type 1 and CFF files, and the widths of composite fonts. Helpers beside text extraction, which goes by a
font's dictionary."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.sources.pdfkernel import Document, Lexer, Name, PdfError, Stream, Word, decode


def uncover(data: bytes, key: int, skip: int = 4) -> bytes:
    """The decryption of Type 1 programs: 55665 for the private part, 4330 for charstrings; the first bytes are random."""
    out = bytearray()
    for b in data:
        out.append(b ^ key >> 8)
        key = ((b + key) * 52845 + 22719) & 0xFFFF
    return bytes(out[skip:])


def charstring_width(code: bytes, subrs: dict[int, bytes] | None = None) -> tuple[float, float] | None:
    """(left side bearing, width) that a decrypted Type 1 charstring sets by hsbw or sbw; None if it sets none."""
    stack: list[float] = []
    todo, calls = [(code, 0)], 0
    while todo:
        data, at = todo.pop()
        while at < len(data):
            b = data[at]
            at += 1
            if b >= 32:
                if b <= 246:
                    stack.append(b - 139)
                elif b <= 254:
                    more = data[at] if at < len(data) else 0
                    stack.append((b - 247) * 256 + more + 108 if b <= 250 else -(b - 251) * 256 - more - 108)
                    at += 1
                else:
                    stack.append(int.from_bytes(data[at : at + 4], "big", signed=True))
                    at += 4
            elif b == 13 and len(stack) >= 2:
                return stack[-2], stack[-1]
            elif b == 12 and at < len(data):
                at += 1
                if data[at - 1] == 7 and len(stack) >= 4:
                    return stack[-4], stack[-2]
                if data[at - 1] == 12 and len(stack) >= 2 and stack[-1]:
                    over = stack.pop()
                    stack.append(stack.pop() / over)
            elif b == 10 and stack and calls < 50:
                calls += 1
                todo.append((data, at))
                data, at = (subrs or {}).get(int(stack.pop()), b""), 0
            elif b in (11, 14):
                break
            else:
                stack = []
    return None


@dataclass
class Type1:
    name: str = ""
    matrix: list = field(default_factory=lambda: [0.001, 0, 0, 0.001, 0, 0])
    encoding: dict[int, str] = field(default_factory=dict)  # empty: the standard one
    subrs: dict[int, bytes] = field(default_factory=dict)
    charstrings: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def read(cls, data: bytes) -> Type1:
        """A program with or without the segment headers of PFB files; the private part as bytes or hexadecimal digits."""
        if data[:1] == b"\x80":
            parts, at = [], 0
            while data[at : at + 1] == b"\x80" and data[at + 1] in (1, 2):
                size = int.from_bytes(data[at + 2 : at + 6], "little")
                parts.append(data[at + 6 : at + 6 + size])
                at += 6 + size
            data = b"".join(parts)
        cut = data.find(b"eexec")
        if not data.startswith(b"%!") or cut < 0:
            raise PdfError("not a Type 1 program")
        font, clear = cls(), data[:cut]
        if m := re.search(rb"/FontName\s*/(\S+)", clear):
            font.name = m[1].decode("latin-1")
        if m := re.search(rb"/FontMatrix\s*\[([^\]]*)\]", clear):
            font.matrix = [float(x) for x in m[1].split()]
        font.encoding = {int(m[1]): m[2].decode("latin-1") for m in re.finditer(rb"dup\s+(\d+)\s*/(\S+)\s+put", clear)}
        hidden = data[cut + 5 :].lstrip(b" \t\r\n")
        if re.match(rb"[0-9A-Fa-f\s]{8}", hidden):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", hidden)
            hidden = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = uncover(hidden, 55665)
        m = re.search(rb"/lenIV\s+(-?\d+)", private)
        skip = int(m[1]) if m else 4
        plain = (lambda raw: uncover(raw, 4330, skip)) if skip >= 0 else (lambda raw: raw)
        first = private.find(b"/CharStrings")
        for m in font._binary(rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\|)\s", private[: first if first >= 0 else None]):
            font.subrs[int(m[0])] = plain(m[1])
        for m in font._binary(rb"/(\S+)\s+(\d+)\s+(?:RD|-\|)\s", private[first:] if first >= 0 else b""):
            font.charstrings[m[0].decode("latin-1")] = plain(m[1])
        return font

    @staticmethod
    def _binary(pattern: bytes, data: bytes):
        """(label, bytes) of entries whose length precedes them."""
        at, entry = 0, re.compile(pattern)
        while m := entry.search(data, at):
            at = m.end() + int(m[2])
            yield m[1], data[m.end() : at]

    def width(self, glyph: str) -> float:
        found = charstring_width(self.charstrings.get(glyph, b""), self.subrs)
        return found[1] if found else 0


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The items of an INDEX and the position after it."""
    count = int.from_bytes(data[at : at + 2], "big")
    if not count:
        return [], at + 2
    size = data[at + 2]
    if not 1 <= size <= 4:
        raise PdfError("bad offset size in a CFF program")
    places = [int.from_bytes(data[at + 3 + size * i : at + 3 + size * (i + 1)], "big") for i in range(count + 1)]
    base = at + 2 + size * (count + 1)
    return [data[base + a : base + b] for a, b in zip(places, places[1:], strict=False)], base + places[-1]


def _dict(data: bytes) -> dict[int, list]:
    """Operands by operator; operators of two bytes count from 1200."""
    out, held, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12 and at < len(data):
                b, at = 1200 + data[at], at + 1
            out[b], held = held, []
        elif b == 28:
            held.append(int.from_bytes(data[at : at + 2], "big", signed=True))
            at += 2
        elif b == 29:
            held.append(int.from_bytes(data[at : at + 4], "big", signed=True))
            at += 4
        elif b == 30:
            digits = ""
            while at < len(data) and "f" not in digits:
                digits += f"{data[at]:02x}"
                at += 1
            real = "".join({"a": ".", "b": "E", "c": "E-", "e": "-"}.get(c, c) for c in digits.split("f")[0] if c != "d")
            held.append(float(real or 0))
        elif 32 <= b <= 246:
            held.append(b - 139)
        elif 247 <= b <= 254:
            more = data[at] if at < len(data) else 0
            held.append((b - 247) * 256 + more + 108 if b <= 250 else -(b - 251) * 256 - more - 108)
            at += 1
    return out


@dataclass
class Cff:
    name: str
    top: dict[int, list]
    strings: list[bytes]
    subrs: list[bytes]
    charstrings: list[bytes]
    charset: list[int]  # of glyphs: string ids, or character ids of CID fonts
    privates: list[dict[int, list]]
    chooser: list[int]  # of glyphs: the private dictionary

    @classmethod
    def read(cls, data: bytes) -> Cff:
        if len(data) < 4 or data[0] != 1:
            raise PdfError("not a CFF program")
        names, at = _index(data, data[2])
        tops, at = _index(data, at)
        strings, at = _index(data, at)
        subrs, at = _index(data, at)
        if not tops:
            raise PdfError("a CFF program without a font")
        top = _dict(tops[0])
        glyphs = _index(data, top[17][0])[0] if 17 in top else []
        n = len(glyphs)
        heads = [_dict(d) for d in _index(data, top[1236][0])[0]] if 1236 in top else [top]
        privates = [_dict(data[d[18][1] : d[18][1] + d[18][0]]) if 18 in d else {} for d in heads]
        place = top.get(15, [0])[0]
        charset = cls._charset(data, place, n) if place > 2 else list(range(n))
        chooser = cls._chooser(data, top[1237][0], n) if 1237 in top else [0] * n
        return cls(names[0].decode("latin-1") if names else "", top, strings, subrs, glyphs, charset, privates, chooser)

    @staticmethod
    def _charset(data: bytes, at: int, n: int) -> list[int]:
        kind, at, out = data[at], at + 1, [0]
        while len(out) < n and at < len(data):
            first = int.from_bytes(data[at : at + 2], "big")
            wide = (0, 1, 2)[min(kind, 2)]
            more = int.from_bytes(data[at + 2 : at + 2 + wide], "big") if wide else 0
            at += 2 + wide
            out += range(first, first + more + 1)
        return out[:n]

    @staticmethod
    def _chooser(data: bytes, at: int, n: int) -> list[int]:
        if data[at] == 0:
            return list(data[at + 1 : at + 1 + n])
        out: list[int] = []
        for i in range(int.from_bytes(data[at + 1 : at + 3], "big")):
            row = data[at + 3 + 3 * i : at + 8 + 3 * i]
            out += [row[2]] * (int.from_bytes(row[3:5], "big") - int.from_bytes(row[:2], "big"))
        return out[:n]

    @property
    def cid(self) -> bool:
        return 1230 in self.top

    def string(self, sid: int) -> str | None:
        """A string of the font's own; the 391 standard ones aren't listed here."""
        return self.strings[sid - 391].decode("latin-1") if 0 <= sid - 391 < len(self.strings) else None

    def width(self, glyph: int) -> float:
        """Width of a glyph by number: the nominal width plus the extra operand before the first stack-clearing operator, else
        the default width."""
        if not 0 <= glyph < len(self.charstrings):
            return 0
        private = self.privates[self.chooser[glyph]] if self.chooser[glyph] < len(self.privates) else {}
        usual, nominal = private.get(20, [0])[0], private.get(21, [0])[0]
        data, at, stack = self.charstrings[glyph], 0, []
        while at < len(data):
            b = data[at]
            at += 1
            if b == 28:
                stack.append(int.from_bytes(data[at : at + 2], "big", signed=True))
                at += 2
            elif b >= 32:
                if b <= 246:
                    stack.append(b - 139)
                elif b <= 254:
                    more = data[at] if at < len(data) else 0
                    stack.append((b - 247) * 256 + more + 108 if b <= 250 else -(b - 251) * 256 - more - 108)
                    at += 1
                else:
                    stack.append(int.from_bytes(data[at : at + 4], "big", signed=True) / 65536)
                    at += 4
            elif b in (1, 3, 18, 23, 19, 20):
                return nominal + stack[0] if len(stack) % 2 else usual
            elif b in (4, 22):
                return nominal + stack[0] if len(stack) > 1 else usual
            elif b == 21:
                return nominal + stack[0] if len(stack) > 2 else usual
            elif b == 14:
                return nominal + stack[0] if len(stack) in (1, 5) else usual
            else:
                return usual
        return usual


@dataclass
class CidMetrics:
    """Widths of a composite font's descendant: DW and W, DW2 and W2, and the map of character to glyph ids."""

    default: float = 1000
    widths: dict[int, float] = field(default_factory=dict)
    default_vertical: tuple = (880, -1000)
    vertical: dict[int, tuple] = field(default_factory=dict)  # (w1, v_x, v_y)
    glyph_ids: bytes = b""

    @classmethod
    def read(cls, doc: Document, head: dict) -> CidMetrics:
        get = doc.resolve
        out = cls(get(head.get("DW")) if head.get("DW") is not None else 1000)
        out._ranges([get(x) for x in get(head.get("W")) or []], out.widths, 1, get)
        out._ranges([get(x) for x in get(head.get("W2")) or []], out.vertical, 3, get)
        if two := get(head.get("DW2")):
            out.default_vertical = tuple(get(x) for x in two[:2])
        if isinstance(to := get(head.get("CIDToGIDMap")), Stream):
            out.glyph_ids = decode(to, doc)
        return out

    @staticmethod
    def _ranges(cells: list, into: dict, n: int, get) -> None:
        """``first [values]`` and ``first last value``, each value of n numbers."""
        at = 0
        while at + 1 < len(cells):
            if isinstance(cells[at + 1], list):
                flat = [get(x) for x in cells[at + 1]]
                for i in range(len(flat) // n):
                    into[cells[at] + i] = flat[i] if n == 1 else tuple(flat[n * i : n * i + n])
                at += 2
                continue
            value = cells[at + 2 : at + 2 + n]
            if len(value) == n:
                for cid in range(cells[at], min(cells[at + 1], 0xFFFF) + 1):
                    into[cid] = value[0] if n == 1 else tuple(value)
            at += 2 + n

    def width(self, cid: int) -> float:
        return self.widths.get(cid, self.default)

    def down(self, cid: int) -> tuple:
        """(w1, v_x, v_y) for vertical writing; without an entry v_x is half the width."""
        return self.vertical.get(cid) or (self.default_vertical[1], self.width(cid) / 2, self.default_vertical[0])

    def glyph(self, cid: int) -> int:
        """The glyph of a character id; the same number without a map."""
        return int.from_bytes(self.glyph_ids[2 * cid : 2 * cid + 2], "big") if self.glyph_ids else cid


def codespaces(data: bytes) -> list[tuple[bytes, bytes]]:
    """(low, high) of the codespace ranges that a character map declares."""
    lex, held, out = Lexer(data), [], []
    while (t := lex.value()) is not None:
        if isinstance(t, Word) and not isinstance(t, Name):
            if t == "endcodespacerange":
                out += [(a, b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            held = []
        else:
            held.append(t)
    return out
