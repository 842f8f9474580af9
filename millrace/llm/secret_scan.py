"""Secret scan: pattern spans, and spans confirmed by structure.

Base patterns: `assign` (a keyword, a separator and a value of 6 or more characters), `access` (AKIA
key ids of 20 or more characters) and `hex` (24 or more hex digits). Each is the leftmost
non-overlapping matches of its pattern, from which those that are too short are dropped.

Confirmed spans are reported only once the candidate decodes and parses:
* `jwt`: header and claims are base64url JSON objects, the header names a signing algorithm, and the
  signature decodes to as many bytes as that algorithm gives;
* `key`: base64 or hex, bare or in a PEM block, that decodes to DER whose nested lengths all fit
  and whose layout is a private key's (PKCS#1, PKCS#8, SEC1), or to an OpenSSH private key.

Offsets count code points, ends are exclusive. Null text is empty and has no spans; repeated rows are
scanned alike; every text is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("assign", "access", "hex", "jwt", "key")
BASE = KINDS[:3]
_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile("(" + "|".join(map(_any_case, KEYWORDS[:4])) + "|" + _any_case("api") + "_?" + _any_case("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
MIN_VALUE = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
#: A word shorter than this has no access key, hex run, token or encoded key in it.
SHORTEST = 20
#: Tried at every start of a run, since a token may follow other dotted text.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{40,}))")
#: Signature bytes by algorithm; those of RSA have the modulus's size, MIN_RSA or more.
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
MIN_RSA = 128
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
HEX_DIGITS = re.compile(r"(?:[0-9A-Fa-f]{2})+")
MAX_DEPTH = 12

Span = tuple[str, int, int]


def decode64(text: str) -> bytes | None:
    """Either alphabet, with or without padding; None if it isn't base64."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode((text + "=" * (-len(text) % 4)).replace("-", "+").replace("_", "/"), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, children or content) of DER values that fill `data` exactly, else None."""
    out: list[tuple[int, object]] = []
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > MAX_DEPTH:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body: object = data[at : at + size]
        if tag & 0x20 and (body := der(data[at : at + size], depth + 1)) is None:
            return None
        out.append((tag, body))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """A SEQUENCE laid out as PKCS#1, PKCS#8 or SEC1."""
    top = der(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1 or not isinstance(top[0][1], list) or not top[0][1]:
        return False
    parts = top[0][1]
    tags = [tag for tag, _ in parts]
    if tags[0] != 0x02 or len(parts[0][1]) != 1:
        return False
    version = parts[0][1][0]
    if len(tags) >= 9 and tags[:9] == [0x02] * 9 and version in (0, 1):
        return True
    if tags[1:3] == [0x30, 0x04] and version in (0, 1):
        algorithm = parts[1][1]
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1:2] == [0x04] and version == 1


def is_openssh(data: bytes) -> bool:
    """The magic, then cipher, kdf, kdf options, a count, and that many public keys and one private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def skip(n: int) -> bool:
        nonlocal at
        for _ in range(n):
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at += 4 + size
        return True

    if not skip(3) or at + 4 > len(data):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= n <= 64 and skip(n + 1) and at == len(data)


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_openssh(data))


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    try:
        parts = [json.loads(decode64(x) or b"") for x in (header, claims)]
    except (ValueError, RecursionError):
        return False
    if not all(isinstance(x, dict) for x in parts):
        return False
    algorithm, size = parts[0].get("alg"), len(decode64(signature) or b"")
    return size >= MIN_RSA if algorithm in RSA_ALGORITHMS else isinstance(algorithm, str) and size in SIGNATURE_BYTES.get(algorithm, ())


def spans(text: str) -> list[Span]:
    """All spans by start, then by kind as listed."""
    out: list[Span] = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if len(text) >= SHORTEST and max(map(len, text.split()), default=0) >= SHORTEST:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        out += [("jwt", m.start(), m.end(3)) for m in JWT.finditer(text) if is_signed_token(m[1], m[2], m[3])]
        for m in ENCODED.finditer(text):
            as_hex = HEX_DIGITS.fullmatch(m[0])
            if as_hex and is_private_key(bytes.fromhex(m[0])) or is_private_key(decode64(m[0])):
                out.append(("key", *m.span()))
    if "PRIVATE KEY-----" in text:
        out += [("key", *m.span()) for m in PEM.finditer(text) if is_private_key(decode64("".join(m[2].split())))]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch["text"]:
                found = spans(text.as_py())
                base = [s for s in found if s[0] in BASE]
                for column, kind in zip(out, BASE):
                    column.append(sum(s[0] == kind for s in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(found))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, out, types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(
        texts, run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, secret: one row per span."""
    one = F.explode(F.split(F.col("spans"), ",")).alias("span")
    found = scan(docs).where(F.col("spans") != "").select("doc_id", one)
    parts = F.split("span", ":")
    found = found.select("doc_id", parts[0].alias("kind"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"))
    text = docs.select("doc_id", "text")
    return found.join(text, "doc_id").select("doc_id", "kind", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("secret"))
