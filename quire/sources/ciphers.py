"""Encrypted files: RC4, AES in CBC mode, and the standard security handler (versions 1, 2, 4 and 5, revisions 2 to 6).

The ciphers run in OpenSSL's library where Python is linked with it (on Linux it mostly is), else in Python; results are the same.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from functools import lru_cache

import numpy as np

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@lru_cache(1)
def _library() -> ctypes.CDLL | None:
    """OpenSSL's library, once it has met published vectors; None where there is none."""
    with contextlib.suppress(ImportError):
        import _hashlib  # noqa: F401  loads the library that Python is linked with
    for name in ("libcrypto.so.3", "libcrypto.so.1.1"):
        with contextlib.suppress(OSError, AttributeError):
            lib = ctypes.CDLL(name)
            chars, size, number = ctypes.c_char_p, ctypes.c_size_t, ctypes.c_int
            lib.RC4_set_key.argtypes, lib.RC4_set_key.restype = (chars, number, chars), None
            lib.RC4.argtypes, lib.RC4.restype = (chars, size, chars, chars), None
            lib.AES_set_encrypt_key.argtypes = lib.AES_set_decrypt_key.argtypes = (chars, number, chars)
            lib.AES_cbc_encrypt.argtypes, lib.AES_cbc_encrypt.restype = (chars, chars, size, chars, chars, number), None
            key, plain, hidden = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff"), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
            if _rc4(lib, b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and _cbc(lib, key, bytes(16), plain, True) == hidden and _cbc(lib, key, bytes(16), hidden, False) == plain:
                return lib
    return None


#: Bytes that hold a key's schedule for either cipher, with room to spare.
_Schedule = ctypes.c_char * 2048


def _rc4(lib: ctypes.CDLL, key: bytes, data: bytes) -> bytes:
    state, out = _Schedule(), ctypes.create_string_buffer(len(data))
    lib.RC4_set_key(state, len(key), key)
    lib.RC4(state, len(data), data, out)
    return out.raw


def _cbc(lib: ctypes.CDLL, key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    state, out = _Schedule(), ctypes.create_string_buffer(len(data))
    (lib.AES_set_encrypt_key if encrypt else lib.AES_set_decrypt_key)(key, 8 * len(key), state)
    lib.AES_cbc_encrypt(data, out, len(data), state, ctypes.create_string_buffer(iv, 16), int(encrypt))
    return out.raw


def rc4(key: bytes, data: bytes) -> bytes:
    if data and 0 < len(key) <= 256 and (lib := _library()):
        return _rc4(lib, key, data)
    return rc4_plain(key, data)


def rc4_plain(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 128 else 0)


def _substitution() -> list[int]:
    """The S-box: the inverse in GF(256), then an affine map."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x ^= _double(x)
    place = {v: i for i, v in enumerate(powers)}
    out = []
    for a in range(256):
        b = powers[-place[a] % 255] if a else 0
        out.append(0x63 ^ b ^ (b << 1 | b >> 7) & 255 ^ (b << 2 | b >> 6) & 255 ^ (b << 3 | b >> 5) & 255 ^ (b << 4 | b >> 4) & 255)
    return out


_S = _substitution()
_BACK = np.argsort(np.array(_S)).astype(np.uint8)
_ROUND = [[(_double(s) << 24 | s << 16 | s << 8 | _double(s) ^ s) >> 8 * k | ((_double(s) << 24 | s << 16 | s << 8 | _double(s) ^ s) << 32 - 8 * k) & 0xFFFFFFFF for s in _S] for k in range(4)]
_FROM = np.array([4 * ((c - r) % 4) + r for c in range(4) for r in range(4)])


def _multiples(n: int) -> np.ndarray:
    out = []
    for x in range(256):
        total, m = 0, n
        while m:
            total, x, m = total ^ (x if m & 1 else 0), _double(x), m >> 1
        out.append(total)
    return np.array(out, np.uint8)


_MIX = [_multiples(n) for n in (14, 11, 13, 9)]


def _schedule(key: bytes) -> list[int]:
    n = len(key) // 4
    words, turn = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = (w << 8 | w >> 24) & 0xFFFFFFFF
        if i % n == 0 or (n > 6 and i % n == 4):
            w = _S[w >> 24] << 24 | _S[w >> 16 & 255] << 16 | _S[w >> 8 & 255] << 8 | _S[w & 255]
        if i % n == 0:
            w, turn = w ^ turn << 24, _double(turn)
        words.append(words[i - n] ^ w)
    return words


def _fits(key: bytes, iv: bytes, data: bytes) -> bool:
    return bool(data) and len(data) % 16 == 0 and len(iv) == 16 and len(key) in (16, 24, 32)


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding; ``data`` is whole blocks."""
    if _fits(key, iv, data) and (lib := _library()):
        return _cbc(lib, key, iv, data, True)
    return aes_encrypt_plain(key, iv, data)


def aes_encrypt_plain(key: bytes, iv: bytes, data: bytes) -> bytes:
    words, (t0, t1, t2, t3) = _schedule(key), _ROUND
    last, out = [int.from_bytes(iv[i : i + 4], "big") for i in range(0, 16, 4)], bytearray()
    for at in range(0, len(data), 16):
        a, b, c, d = (int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "big") ^ last[i] ^ words[i] for i in range(4))
        for i in range(4, len(words) - 4, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ words[i],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ words[i + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ words[i + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ words[i + 3],
            )
        s = (a, b, c, d)
        last = [(_S[s[i] >> 24] << 24 | _S[s[(i + 1) % 4] >> 16 & 255] << 16 | _S[s[(i + 2) % 4] >> 8 & 255] << 8 | _S[s[(i + 3) % 4] & 255]) ^ words[i - 4] for i in range(4)]
        out += b"".join(w.to_bytes(4, "big") for w in last)
    return bytes(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding; bytes after the last whole block are left out."""
    data = data[: len(data) // 16 * 16]
    if _fits(key, iv, data) and (lib := _library()):
        return _cbc(lib, key, iv, data, False)
    return aes_decrypt_plain(key, iv, data)


def aes_decrypt_plain(key: bytes, iv: bytes, data: bytes) -> bytes:
    """All whole blocks at once."""
    keys = np.array(_schedule(key), ">u4").view(np.uint8).reshape(-1, 16)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    state = blocks ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        state = _BACK[state[:, _FROM]] ^ keys[i]
        if i:
            cells = state.reshape(-1, 4, 4)
            state = np.bitwise_xor.reduce([m[np.roll(cells, -n, axis=2)] for n, m in enumerate(_MIX)]).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks])[: len(blocks)]
    return (state ^ before).tobytes()


def unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


@lru_cache(256)  # copies of a file share their salts
def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hash of revision 6."""
    k, i, e = hashlib.sha256(password + salt + user).digest(), 0, b"\0"
    while i < 64 or e[-1] > i - 32:
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = hashlib.new(("sha256", "sha384", "sha512")[sum(e[:16]) % 3], e).digest()
        i += 1
    return k[:32]


#: What came of passwords, by the marks of a file.
_TRIED: dict[str, bytes | None] = {}


class Handler:
    """The standard security handler of a document; ``head`` is its resolved Encrypt dictionary."""

    def __init__(self, head: dict, first_id: bytes):
        self.head, self.id = head, first_id
        self.version, self.revision = head.get("V", 0), head.get("R", 2)
        if head.get("Filter", "Standard") != "Standard" or self.version not in (1, 2, 4, 5):
            raise ValueError("the document is encrypted by an unknown scheme")
        self.size = 5 if self.version == 1 else min(max(head.get("Length", 40) // 8, 5), 16) if self.version == 2 else 16
        self.key = b""

    def method(self, use: str) -> str:
        """How streams (StmF) or strings (StrF) are encrypted: V2 (RC4), AESV2, AESV3 or None."""
        if self.version < 4:
            return "V2"
        name = self.head.get(use, "Identity")
        return "None" if name == "Identity" else str((self.head.get("CF") or {}).get(name, {}).get("CFM", "None"))

    def unlock(self, passwords: list[str]) -> bool:
        """Try each password as user's and owner's; the first that fits gives the key. Files with the same marks are tried once."""
        about = repr((self.head, self.id, passwords))
        if about not in _TRIED:
            found = self._try(passwords)
            if len(_TRIED) >= 256:
                _TRIED.clear()
            _TRIED[about] = self.key if found else None
        self.key = _TRIED[about] or b""
        return _TRIED[about] is not None

    def _try(self, passwords: list[str]) -> bool:
        for p in passwords:
            for attempt in (self._modern,) if self.version == 5 else (self._user, self._owner):
                if key := attempt(p.encode("utf-8")[:127] if self.version == 5 else p.encode("latin-1", "replace")):
                    self.key = key
                    return True
        return False

    def _modern(self, p: bytes) -> bytes | None:
        digest = hardened if self.revision >= 6 else lambda word, salt, user=b"": hashlib.sha256(word + salt + user).digest()
        u, o = self.head["U"][:48], self.head["O"][:48]
        if digest(p, u[32:40]) == u[:32]:
            return aes_decrypt(digest(p, u[40:48]), bytes(16), self.head["UE"][:32])
        if digest(p, o[32:40], u) == o[:32]:
            return aes_decrypt(digest(p, o[40:48], u), bytes(16), self.head["OE"][:32])
        return None

    def file_key(self, p: bytes) -> bytes:
        plain = b"\xff" * 4 if self.revision >= 4 and self.head.get("EncryptMetadata") is False else b""
        key = hashlib.md5((p + PAD)[:32] + self.head["O"][:32] + (self.head["P"] & 0xFFFFFFFF).to_bytes(4, "little") + self.id + plain).digest()[: self.size]
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()[: self.size]
        return key

    def user_mark(self, key: bytes) -> bytes:
        """What U holds for a key; from revision 3 on only 16 bytes of it count."""
        if self.revision < 3:
            return rc4(key, PAD)
        mark = hashlib.md5(PAD + self.id).digest()
        for i in range(20):
            mark = rc4(bytes(b ^ i for b in key), mark)
        return mark

    def owner_key(self, p: bytes) -> bytes:
        key = hashlib.md5((p + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()
        return key[: self.size]

    def _user(self, p: bytes) -> bytes | None:
        key = self.file_key(p)
        mark = self.user_mark(key)
        return key if self.head["U"][: len(mark)] == mark else None

    def _owner(self, p: bytes) -> bytes | None:
        key, word = self.owner_key(p), self.head["O"][:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            word = rc4(bytes(b ^ i for b in key), word)
        return self._user(word)

    def object_key(self, num: int, gen: int, method: str) -> bytes:
        if method == "AESV3":
            return self.key
        salt = b"sAlT" if method == "AESV2" else b""
        return hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + salt).digest()[: min(len(self.key) + 5, 16)]

    def decrypt(self, data: bytes, num: int, gen: int, use: str) -> bytes:
        method = self.method(use)
        if method == "None":
            return data
        key = self.object_key(num, gen, method)
        return rc4(key, data) if method == "V2" else unpad(aes_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""

    def encrypt(self, data: bytes, num: int, gen: int, use: str, iv: bytes) -> bytes:
        method = self.method(use)
        if method == "None":
            return data
        key, fill = self.object_key(num, gen, method), 16 - len(data) % 16
        return rc4(key, data) if method == "V2" else iv + aes_encrypt(key, iv, data + bytes([fill]) * fill)

    def permits(self, bit: int) -> bool:
        """Whether the permission of a bit (from 1) is granted to the user."""
        return bool(self.head.get("P", -1) >> bit - 1 & 1)
