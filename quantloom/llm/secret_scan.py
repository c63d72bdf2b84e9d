"""Secret scan: patterns first, then structural confirmation of what is encoded.

Assignments, access keys and hex runs are found by pattern. Base64 and hex candidates are decoded and only reported if
what they hold parses as a private key (DER or the OpenSSH container, whose nested lengths must all fit), a signed or
encrypted token (its header and, if signed, its payload are JSON, and the signature has the algorithm's length), or text that
holds one of these. Each text is scanned where it stands: no shuffle, and a task holds one Arrow batch.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (password|passwd|secret|token|api_?key) with its ASCII letters in either case; the look-ahead only makes it fast.
_WORDS = "(?=[PpSsTtAa])(" + re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", "password|passwd|secret|token|api_?key") + ")"
#: Patterns, the group whose length counts, and its least length; and the kinds that structure confirms.
BASE = {
    "assign": (re.compile(_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # whole runs, as short ones never match
}
STRUCTURAL = ("token", "key", "hexkey", "wrapped")
KINDS = (*BASE, *STRUCTURAL)

#: Bytes of a signature by algorithm (fixed values); RS and PS ones have 128 at least.
SIGNATURES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}, "none": {0}}
#: Object identifiers inside PKCS #8 (fixed values): RSA, elliptic curves, Ed25519 and X25519, and password-based encryption.
RSA, EC, RAW, PBES = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), {bytes.fromhex("2b6570"), bytes.fromhex("2b656e")}, bytes.fromhex("2a864886f70d0105")
OPENSSH = b"openssh-key-v1\0"

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy3][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
_KEY = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)")  # the first characters of a DER sequence or of OPENSSH
_BODY = re.compile(r"(?:[A-Za-z0-9+/_-]|\r?\n[\x20\t]*|\\n)*={0,2}")
_FILL = re.compile(r"\r?\n[\x20\t]*|\\n")
_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e737368|6F70656E737368)[0-9A-Fa-f]{30,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{60,}={0,2}")
#: Bytes of an encoded key at most: far over RSA keys of 16,384 bits. Lengths of three bytes and more are no keys.
_LONGEST = 1 << 16


def _decode(text: str) -> bytes | None:
    """Base64 of either alphabet, padded or not; None if it is none."""
    plain = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at `at`, which must fit before `end`, its length as short as can be."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size - 0x80
        if not 1 <= n <= 2 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 0x80 or (n == 2 and size < 0x100):
            return None
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements that fill the span exactly."""
    found = []
    while at < end:
        one = _element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def _number(data: bytes, one: tuple[int, int, int]) -> int:
    return int.from_bytes(data[one[1] : one[2]], signed=True) if one[0] == 2 and one[2] > one[1] else -1


def _der_key(data: bytes, at: int, end: int) -> str | None:
    """What private key the DER sequence at `at` holds, of exactly this span."""
    top = _element(data, at, end)
    if top is None or top[0] != 0x30 or top[2] != end:
        return None
    parts = _elements(data, top[1], top[2])
    if not parts:
        return None
    tags, numbers = [p[0] for p in parts], [_number(data, p) for p in parts]
    if tags == [2] * 9 and numbers[0] == 0 and all(n > 0 for n in numbers[1:]) and numbers[1] == numbers[4] * numbers[5]:
        return "rsa"
    if tags == [2] * 6 and numbers[0] == 0 and all(n > 1 for n in numbers[1:]) and pow(numbers[3], numbers[5], numbers[1]) == numbers[4]:
        return "dsa"
    if tags[:2] == [2, 4] and numbers[0] == 1 and set(tags[2:]) <= {0xA0, 0xA1} and 20 <= parts[1][2] - parts[1][1] <= 66:
        return "ec"
    if tags[:2] == [0x30, 4] and len(tags) == 2:
        inner = _elements(data, parts[0][1], parts[0][2])
        if inner and inner[0][0] == 6 and data[inner[0][1] : inner[0][2]].startswith(PBES) and parts[1][2] - parts[1][1] >= 16:
            return "encrypted"
    if tags[:3] == [2, 0x30, 4] and numbers[0] in (0, 1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        inner = _elements(data, parts[1][1], parts[1][2])
        if inner and inner[0][0] == 6:
            oid, (_, s, e) = data[inner[0][1] : inner[0][2]], parts[2]
            if oid in (RSA, EC):
                return f"pkcs8:{own}" if (own := _der_key(data, s, e)) == ("rsa" if oid == RSA else "ec") else None
            if oid in RAW and _elements(data, s, e) == [(4, s + 2, e)] and e - s == 34:
                return "pkcs8:raw"
    return None


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n strings with lengths of four bytes before them, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def _openssh(data: bytes) -> int:
    """Length of the OpenSSH container that data begins with, all of whose lengths fit; 0 if there is none."""
    if not data.startswith(OPENSSH) or (head := _strings(data, len(OPENSSH), 3)) is None:
        return 0
    (cipher, kdf, _), at = head
    n = int.from_bytes(data[at : at + 4])
    body = _strings(data, at + 4, n + 1) if 1 <= n <= 64 else None
    if body is None or (cipher == b"none") != (kdf == b"none") or len(body[0][-1]) % 8:
        return 0
    fits = all((kind := _strings(blob, 0, 1)) and kind[0][0].isascii() and kind[0][0] for blob in body[0][:-1])
    checks = cipher != b"none" or (len(body[0][-1]) >= 8 and body[0][-1][:4] == body[0][-1][4:8])
    return body[1] if fits and checks else 0


def _key(data: bytes) -> tuple[str, int] | None:
    """Kind and length of the private key that data begins with."""
    if size := _openssh(data):
        return "openssh", size
    top = _element(data, 0, len(data))
    own = _der_key(data, 0, top[2]) if top and top[0] == 0x30 else None
    return (own, top[2]) if own else None


def _promising(data: bytes) -> bool:
    """Whether the first bytes can begin a key: a sequence of a fitting length, then a version or an algorithm."""
    if data.startswith(OPENSSH[: len(data)]):
        return True
    at = 2 + (data[1] - 0x80 if data[1] >= 0x80 else 0)
    return data[0] == 0x30 and data[1] <= 0x82 and data[1] != 0x80 and (data[at : at + 3] in (b"\2\1\0", b"\2\1\1") or data[at : at + 1] == b"\x30")


def _token(text: str) -> str | None:
    """The algorithm of a compact token, if its header, payload and signature are what they must be."""
    parts = text.split(".")
    raw = [_decode(p) for p in parts]
    if raw[0] is None or any(r is None for r in raw):
        return None
    try:
        header = json.loads(raw[0])
        alg = header.get("alg") if isinstance(header, dict) else None
        if not isinstance(alg, str) or not alg:
            return None
        if len(parts) == 5:
            return f"{alg}:{header['enc']}" if isinstance(header.get("enc"), str) and raw[3] and raw[4] else None
        if not isinstance(json.loads(raw[1]), dict):
            return None
    except (ValueError, RecursionError):
        return None
    size = len(raw[2])
    fits = size in SIGNATURES[alg] if alg in SIGNATURES else size >= (128 if alg[:2] in ("RS", "PS") else 16)
    return alg if fits else None


def _base64_keys(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in _KEY.finditer(text):
        at = m.start()
        if at < done:
            continue
        head = _decode(_FILL.sub("", text[at : at + 64])[:32]) if text[at] == "M" else OPENSSH
        if not head or len(head) < 8 or not _promising(head):
            continue
        body = _BODY.match(text, at, at + 2 * _LONGEST)
        marks = [i for i, c in enumerate(_FILL.sub(lambda f: "\0" * len(f[0]), body[0])) if c not in "\0="]
        plain = "".join(body[0][i] for i in marks)
        found = _key(_decode(plain[: len(plain) // 4 * 4]) or b"") or (len(plain) % 4 > 1 and _key(_decode(plain) or b"")) or None
        if found:
            last = marks[-(-found[1] * 4 // 3) - 1] + 1
            last += len(re.match("={0,2}", body[0][last:])[0])
            done = at + last
            yield at, done, found[0]


def _structures(text: str, deep: bool = True) -> Iterator[tuple[str, int, int, str]]:
    """kind, start, end and what it is, of all that decodes and parses."""
    for m in _TOKEN.finditer(text):
        own = m[0]
        for one in (own, ".".join(own.split(".")[:3])):
            if alg := _token(one):
                yield "token", m.start(), m.start() + len(one), alg
                break
    for start, end, what in _base64_keys(text):
        yield "key", start, end, what
    for m in _HEX.finditer(text):
        found = _key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2][: 2 * _LONGEST]))
        if found:
            yield "hexkey", m.start(), m.start() + 2 * found[1], found[0]
    if deep:
        for m in _RUN.finditer(text):
            data = _decode(m[0])
            inner = next(_structures(data.decode("ascii"), False), None) if data and data.isascii() else None
            if inner:
                yield "wrapped", m.start(), m.end(), f"{inner[0]}:{inner[3]}"


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, what) of all secrets of a text, by start and kind; code points, end exclusive."""
    found = [(kind, m.start(), m.end(), "") for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    found += _structures(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("what", pa.string())])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and secrets: array<struct<kind, start, end, what>>, by start and kind.

    A null text is empty and has none; repeated rows each have theirs; a column named secrets is replaced. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "what"), s, strict=True)) for s in scan(t.as_py() or "")] for t in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names[:-1], "secrets"])

    kept = [c for c in docs.columns if c != "secrets"]
    names = [f"c{i}" for i in range(len(kept))]  # struct fields and clashing names travel by place
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text}`").cast("string").alias("secrets"))
    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, ", ".join(x for x in (types, "secrets array<struct<kind string, start long, end long, what string>>") if x))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], "secrets")


def listed(secrets: Column, base_only: bool = False) -> Column:
    """kind:start:end of the secrets, comma-joined."""
    own = F.filter(secrets, lambda s: s["kind"].isin(*BASE)) if base_only else secrets
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(secrets: Column, *kinds: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"].isin(*kinds))).cast("long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with all secrets of their texts replaced by a mark; overlapping ones by one mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            out = []
            for t in batch.column(at):
                own, parts, end = t.as_py(), [], 0
                for _, s, e, _ in scan(own or ""):
                    if s >= end:
                        parts += [own[end:s], mark]
                    end = max(end, e)
                out.append(None if own is None else "".join([*parts, own[end:]]))
            yield batch.set_column(at, "_text", pa.array(out, pa.string()))

    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias("_text" if c == text else n) for c, n in zip(docs.columns, names, strict=True)])
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
