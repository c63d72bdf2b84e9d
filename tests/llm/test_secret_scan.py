"""The secret scan against a reader of single characters, on planted keys and tokens, and on odd inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import string

import pytest

from quantloom.llm import queries, secret_scan

ALNUM = string.ascii_letters + string.digits


def element(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2)
    return bytes([tag]) + size + body


def number(n: int) -> bytes:
    return element(2, n.to_bytes(n.bit_length() // 8 + 1))


P, Q = (1 << 521) - 1, (1 << 607) - 1
RSA = element(0x30, b"".join(map(number, [0, P * Q, 65537, 12345, P, Q, 7, 8, 9])))
PKCS8 = element(0x30, number(0) + element(0x30, element(6, secret_scan.RSA) + b"\5\0") + element(4, RSA))
EC = element(0x30, number(1) + element(4, bytes(range(32))) + element(0xA0, element(6, b"\x2a\x86\x48\xce\x3d\3\1\7")))
RAW = element(0x30, number(0) + element(0x30, element(6, b"\x2b\x65\x70")) + element(4, element(4, bytes(range(32)))))
ENCRYPTED = element(0x30, element(0x30, element(6, secret_scan.PBES + b"\x0d") + element(0x30, b"")) + element(4, bytes(32)))


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(4) + data


OPENSSH = secret_scan.OPENSSH + packed(b"none") + packed(b"none") + packed(b"") + (1).to_bytes(4) + packed(packed(b"ssh-ed25519") + packed(bytes(32))) + packed(bytes(8) + bytes(range(64)))
KEYS = {"rsa": RSA, "pkcs8:rsa": PKCS8, "ec": EC, "pkcs8:raw": RAW, "encrypted": ENCRYPTED, "openssh": OPENSSH}


def url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


TOKEN = url(b'{"alg":"HS256","typ":"JWT"}') + "." + url(b'{"sub":"1"}') + "." + url(bytes(32))


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """The contract's base spans, one character after the other."""
    found = []
    value, hexes, upper = set(ALNUM + "+/_.=-"), set("0123456789abcdef"), set(string.ascii_uppercase + string.digits)
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(word, i):
                continue
            j = i + len(word)
            j += j < len(text) and text[j] in "\"'"
            while j < len(text) and text[j] == " ":
                j += 1
            if j >= len(text) or text[j] not in ":=":
                continue
            j += 1
            while j < len(text) and text[j] == " ":
                j += 1
            j += j < len(text) and text[j] in "\"'"
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                end = k
                if k - j >= 6:
                    found.append(("assign", i, k))
                break
        i = end or i + 1
    for kind, start, own, least in (("access", "AKIA", upper, 20), ("hex", "", hexes, 24)):
        i = 0
        while i < len(text):
            k = i + len(start)
            if text.startswith(start, i):
                while k < len(text) and text[k] in own:
                    k += 1
            if text.startswith(start, i) and k > i + len(start):
                if k - i >= least:
                    found.append((kind, i, k))
                i = k
            else:
                i += 1
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def noisy(rng: random.Random) -> str:
    bits = ["password", "PassWd", "ſecret", "SECRET", "toKen", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKI", "é", "\n", "0123456789abcdef", "deadbeef", "ABCDEFGH", "x", ".", "-", "zz9_"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(60)))


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [noisy(rng) for _ in range(1500)] + ["", None, "token=abcdef" * 3, "token = '" + "a" * 100_000, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 24, "f" * 23, 'x="' + TOKEN + '"']
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets string, _text long")
    found = {r["doc_id"]: r for r in secret_scan.find_secrets(rows).select("doc_id", secret_scan.listed(secret_scan.F.col("secrets"), True).alias("spans"), "_text").collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert found[i]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t or "")), t


@pytest.mark.parametrize("what", KEYS)
def test_keys(what):
    data = KEYS[what]
    plain, lines = base64.b64encode(data).decode(), base64.encodebytes(data).decode().strip()
    for before, own, after in (("key=", plain, " more"), ("-----BEGIN KEY-----\n", lines, "\n-----END KEY-----"), ('{"k": "', lines.replace("\n", "\\n"), '\\n"}'), ("\r\n  ", lines.replace("\n", "\r\n  "), ""), ("é ", plain.rstrip("="), ", x")):
        found = [s for s in secret_scan.scan(before + own + after) if s[0] == "key"]
        assert found == [("key", len(before), len(before) + len(own), what)], before
    for text in (data.hex(), data.hex().upper()):
        assert [s for s in secret_scan.scan(f"0 {text} g") if s[0] == "hexkey"] == [("hexkey", 2, 2 + len(text), what)]
    inside = base64.b64encode(b"-----BEGIN KEY-----\n" + base64.encodebytes(data)).decode()
    assert [s for s in secret_scan.scan(f"data: {inside};") if s[0] == "wrapped"] == [("wrapped", 6, 6 + len(inside), f"key:{what}")]


@pytest.mark.parametrize("what", KEYS)
def test_damaged_keys_are_left_alone(what):
    data = KEYS[what]
    broken = [data[:-1], data[: len(data) // 2], bytes([data[0]]) + bytes([data[1] ^ 1]) + data[2:], b"\x31" + data[1:]]
    if what == "rsa":
        broken.append(element(0x30, b"".join(map(number, [0, P * Q + 2, 65537, 12345, P, Q, 7, 8, 9]))))
    for b in broken:
        assert not [s for s in secret_scan.scan(base64.b64encode(b).decode() + " " + b.hex()) if s[0] in ("key", "hexkey")]


def test_tokens():
    jwe = ".".join([url(b'{"alg":"dir","enc":"A128GCM"}'), "", url(bytes(12)), url(bytes(20)), url(bytes(16))])
    assert secret_scan.scan(f"a {TOKEN}, b.{TOKEN}") == [("token", 2, 2 + len(TOKEN), "HS256"), ("token", 6 + len(TOKEN), 6 + 2 * len(TOKEN), "HS256")]
    assert secret_scan.scan(jwe) == [("token", 0, len(jwe), "dir:A128GCM")]
    short = url(b'{"alg":"HS256"}') + "." + url(b'{"a":1}') + "." + url(bytes(31))
    listed = url(b"[1, 2, 3, 4, 5, 6]") + "." + url(b"{}") + "." + url(bytes(32))
    other = url(b'{"alg":"HS256"}') + "." + url(b"not json") + "." + url(bytes(32))
    deep = url(b'{"alg":' + b"[" * 100_000) + "." + url(b"{}") + "." + url(bytes(32))
    for text in (short, listed, other, deep, "eyJ.eyJ.x", "eyJ" * 1000 + ".", "version 1.2.3 and ewe.are.here"):
        assert not secret_scan.scan(text), text[:40]


def test_redact_and_odd_rows(spark):
    rows = [(1, None), (1, f"a {TOKEN} b token=abcdef12 c"), (None, ""), (2, "plain"), (2, "plain")]
    out = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, None), (1, "a [secret] b [secret] c"), (None, ""), (2, "plain"), (2, "plain")]
    empty = secret_scan.find_secrets(spark.createDataFrame([], "text string, a struct<x:int>"))
    assert empty.columns == ["text", "a", "secrets"] and empty.count() == 0


def test_query(spark, tmp_path):
    text = f"token = 'abcdef0123456789abcdef0123' {TOKEN} AKIA{'Z' * 16}"
    spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seven, eight = queries.op11_secret_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    base = "assign:0:35,hex:9:35," + f"access:{len(text) - 20}:{len(text)}"
    assert (seven["n_assign"], seven["n_access"], seven["n_hex"], seven["n_confirmed"]) == (1, 1, 1, 1)
    assert seven["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert seven["spans"] == base.replace(",access", f",token:37:{37 + len(TOKEN)},access")
    assert (eight["n_assign"], eight["spans"], eight["base_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
