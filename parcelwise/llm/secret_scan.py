"""Secret scans with structural confirmation.

Base patterns give spans as they are.  On top, long runs of base64 or hexadecimal characters are candidates that
are reported only if they decode to something with the structure of a secret:

* ``jwt``: three parts joined by dots; the first decodes to a JSON object with an ``alg`` text, the second to JSON;
* ``der``: bytes of a private key in DER: a SEQUENCE whose nested lengths fill it exactly and whose first fields are a
  version and a number (or an algorithm and a key);
* ``openssh``: an OpenSSH private key: its magic, then length-prefixed fields that stay inside;
* ``pem``: the text between BEGIN and END lines of a private key whose body decodes to one of the last two.

Offsets are code points.  Edge cases: null text is empty; texts are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import read_table
from .spans import Span, byte_runs, scan

BASE = ("assign", "access", "hex")
ADDED = ("jwt", "der", "openssh", "pem")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Shortest run of base64 characters that can hold a key or a signed token's header.
LEAST_BASE64 = 32
_PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: What cannot stand between the lines of a key; inside a quoted text its line breaks may be escaped.
_NOT_PEM = re.compile(r"[^A-Za-z0-9+/=\s:,.\\-]|\\(?![nr])")
_ESCAPED_BREAK = re.compile(r"\\[nr]")
_DOTTED = re.compile(rb"[A-Za-z0-9_.-]+")
_OPENSSH = b"openssh-key-v1\0"


def _class(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, np.int8)
    flags[np.frombuffer(characters, "u1")] = 1
    return flags


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_BASE64 = _class(_LETTERS + b"+/_-=.")
_HEX = _class(b"0123456789abcdef")


def decoded(run: bytes) -> bytes | None:
    """Bytes of a base64 run (either alphabet, padding optional), or None."""
    body = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, end of the value) of the item at a byte; its length must fit and be minimal."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        size, at = int.from_bytes(data[at : at + count], "big"), at + count
        if size < 0x80 or size >> 8 * (count - 1) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """A private key: SEQUENCE (version, ...) whose items fill it, nested sequences included."""
    outer = der_item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    items = _items(data, outer[1], outer[2])
    if items is not None and [tag for tag, _, _ in items] == [0x30, 0x04]:  # an encrypted key: algorithm with parameters, then bytes
        inner = _items(data, items[0][1], items[0][2])
        return bool(inner) and len(inner) == 2 and inner[0][0] == 0x06 and inner[1][0] == 0x30 and items[1][2] - items[1][1] >= 16
    if items is None or len(items) < 3 or items[0][0] != 0x02 or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 1:
        return False
    if items[1][0] == 0x02:  # numbers of an RSA or DSA key
        return len(items) >= 6 and all(tag == 0x02 for tag, _, _ in items[:6])
    if items[1][0] == 0x30:  # algorithm, then the key as bytes
        inner = _items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06 and items[2][0] == 0x04
    return items[1][0] == 0x04 and items[1][2] - items[1][1] >= 16 and items[2][0] in (0xA0, 0xA1)  # elliptic curve


def _items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        item = der_item(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_openssh_key(data: bytes) -> bool:
    """Magic, then cipher, derivation and options as length-prefixed fields, a key count and the keys."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for number in range(5):
        if at + 4 > len(data):
            return False
        value = struct.unpack_from(">I", data, at)[0]
        at += 4
        if number == 3:
            if not 1 <= value <= 16:
                return False
        else:
            at += value
            if at > len(data):
                return False
    return True


def is_signed_token(token: bytes) -> bool:
    head, body, _ = token.split(b".")
    try:
        fields = json.loads(decoded(head) or b"")
        return isinstance(fields, dict) and isinstance(fields.get("alg"), str) and isinstance(json.loads(decoded(body) or b""), dict)
    except (ValueError, RecursionError):
        return False


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[Span]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [("hex", a, b) for a, b in hexes]


def confirmed(data: bytes, runs: list[tuple[int, int]], hexes: list[tuple[int, int]]) -> list[Span]:
    """Added spans in byte offsets."""
    out: list[Span] = []
    for a, b in runs:
        run = data[a:b]
        for m in _DOTTED.finditer(run) if run.count(b".") >= 2 else ():
            parts = m[0].split(b".")
            start = a + m.start()
            for three in zip(parts, parts[1:], parts[2:]):
                token = b".".join(three)
                if three[0][:1] == b"e" and is_signed_token(token):  # the first character of an encoded brace
                    out.append(("jwt", start, start + len(token)))
                start += len(three[0]) + 1
        at = a
        for part in re.split(rb"(?<!=)(?==)|(?<==)(?!=)|\.", run) if b"=" in run or b"." in run else [run]:
            start = data.index(part, at) if part else at
            at = start + len(part)
            end = at
            while end < b and data[end : end + 1] == b"=":
                end += 1
            kind = key_kind(decoded(part)) if len(part) >= LEAST_BASE64 else None
            if kind:
                out.append((kind, start, end))
    for a, b in hexes:
        kind = key_kind(bytes.fromhex(data[a : b - (b - a) % 2].decode()))
        if kind:
            out.append((kind, a, b))
    return out


def pem_bodies(text: str) -> list[tuple[int, int, str]]:
    """(start, end, base64 text) from each first line of a key to the nearest last line of its kind, leftmost first."""
    lines = list(_PEM_LINE.finditer(text))
    last: dict[str, list[int]] = {}
    for n, line in enumerate(lines):
        if line[1] == "END":
            last.setdefault(line[2], []).append(n)
    foreign = [m.start() for m in _NOT_PEM.finditer(text)]
    out, covered = [], 0
    for n, line in enumerate(lines):
        ends = last.get(line[2], [])
        k = bisect_left(ends, n)
        if line[1] != "BEGIN" or line.start() < covered or k == len(ends):
            continue
        close = lines[ends[k]]
        if bisect_left(foreign, line.end()) == bisect_left(foreign, close.start()):
            covered = close.end()
            body = _ESCAPED_BREAK.sub("\n", text[line.end() : close.start()])
            out.append((line.start(), covered, "".join(x for x in body.splitlines() if ":" not in x).replace(" ", "")))
    return out


def find_secrets(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    out = []
    for text in texts:
        data = text.encode()
        plain = len(data) == len(text)
        place = (lambda n: n) if plain else (lambda n, d=data: len(d[:n].decode()))
        starts, ends = byte_runs(data, _BASE64, LEAST["hex"])
        hexes: list[tuple[int, int]] = []
        runs = []
        # Hexadecimal runs lie inside runs of base64 characters.
        for a, b in zip(starts.tolist(), ends.tolist()):
            s, e = byte_runs(data[a:b], _HEX, LEAST["hex"])
            hexes += [(a + x, a + y) for x, y in zip(s.tolist(), e.tolist())]
            if b - a >= LEAST_BASE64:
                runs.append((a, b))
        added = [(k, place(a), place(b)) for k, a, b in confirmed(data, runs, hexes)] if runs or hexes else []
        if "PRIVATE KEY-----" in text:
            added += [("pem", a, b) for a, b, body in pem_bodies(text) if key_kind(decoded(body.encode("ascii", "replace")))]
        out.append((base_spans(text, [(place(a), place(b)) for a, b in hexes]), sorted(set(added))))
    return out


def secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, lambda: find_secrets, BASE, ADDED)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
