"""Secrets in text: pattern candidates, and encoded candidates that are reported only if their structure holds.

Three kinds are patterns alone: ``assign`` (a value assigned to a telling name), ``access`` (an access key id) and ``hex``
(a long run of hex digits). Four kinds are confirmed by decoding: a candidate in base64 or hex is reported as

* ``pem``: a private-key block whose body, its line ends as they are or escaped, decodes to one of the forms below,
* ``der``: base64 or hex of ASN.1 DER that begins as a key does and whose nested lengths add up to the last byte,
* ``wire``: base64 or hex of an OpenSSH key, a chain of length-prefixed fields that adds up to the last byte,
* ``jwt``: three base64url parts of which the first decodes to a JSON object naming its algorithm and the second to a
  JSON object.

NULL and empty texts have no spans. Spans are in code points, ends exclusive, ordered by start and then by kind.
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

from scrubwell.llm.batches import ids_and_texts, pieces, texts

KINDS = ("assign", "access", "hex", "pem", "der", "wire", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# An escaped line end or tab, as in JSON and code, delimits too: its letter is no part of a candidate.
_ESCAPED = r"(?<=\\[nrt])"
_HEX_KEY = re.compile(rf"(?:{_ESCAPED}|(?<![0-9A-Za-z]))[0-9A-Fa-f]{{64,}}(?![0-9A-Za-z])")
_BASE64_KEY = re.compile(rf"(?:{_ESCAPED}|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))[A-Za-z0-9+/_-]{{40,}}={{0,2}}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
_BREAK = re.compile(r"\\+[nrt]?|\s+")
_JWT = re.compile(rf"(?:{_ESCAPED}|(?<![A-Za-z0-9_.-])(?!(?<=\\)[nrt]))[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{2,}}\.[A-Za-z0-9_-]*")
# No candidate but an assignment is shorter than this without a blank inside.
_SHORTEST = 24
# Elements that a DER key begins with: a version number, an algorithm, or a curve's private number.
_INTEGER, _OCTETS, _OBJECT, _SEQUENCE, _BITS, _NULL = 0x02, 0x04, 0x06, 0x30, 0x03, 0x05


def _decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, padded or not."""
    body = text.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tag and content of DER elements that fill ``data`` exactly, sequences checked inside; else ``None``."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
            if size < 0x80 or size >> 8 * (width - 1) == 0:  # DER uses the shortest form
                return None
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag == _SEQUENCE and (depth > 8 or _elements(content, depth + 1) is None):
            return None
        out.append((tag, content))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private or public key in DER: PKCS#1, PKCS#8 (encrypted or not), SEC1 or SubjectPublicKeyInfo."""
    if len(data) < 24 or data[0] != _SEQUENCE:
        return False
    outer = _elements(data)
    if not outer or len(outer) != 1:
        return False
    inner = _elements(outer[0][1]) or []
    tags = [t for t, _ in inner]
    algorithm = lambda content: (_elements(content) or [(0, b"")])[0][0] == _OBJECT
    if tags[:1] == [_INTEGER] and len(inner[0][1]) == 1:
        if tags[1:3] == [_SEQUENCE, _OCTETS]:
            return algorithm(inner[1][1])
        return tags[1:2] == [_OCTETS] or tags.count(_INTEGER) >= 6
    if tags == [_SEQUENCE, _BITS]:
        return algorithm(inner[0][1])
    if tags == [_SEQUENCE, _OCTETS]:  # digests have this form, but ciphers have parameters
        return algorithm(inner[0][1]) and [t for t, _ in _elements(inner[0][1])][1:2] != [_NULL]
    return tags == [_INTEGER, _INTEGER] and len(inner[0][1]) >= 64


def is_wire_key(data: bytes) -> bool:
    """An OpenSSH private key container, or a public key of length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    fields, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{2,40}", fields[0]) is not None


def is_signed_token(text: str) -> bool:
    """Two JSON objects in base64url, the first naming an algorithm."""
    try:
        header, payload = (json.loads(_decoded(part) or b"") for part in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def _key_kind(data: bytes | None) -> str | None:
    if data:
        return "der" if is_der_key(data) else "wire" if is_wire_key(data) else None
    return None


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end of each span."""
    found: list[tuple[str, int, int]] = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    longest = max(map(len, text.split()), default=0)
    if longest >= 20:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if longest >= _SHORTEST and "." in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if _key_kind(_decoded(_BREAK.sub("", m[2])))]
    if longest >= 40:
        found += [(k, *m.span()) for m in _BASE64_KEY.finditer(text) if (k := _key_kind(_decoded(m[0])))]
        found += [(k, *m.span()) for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and (k := _key_kind(bytes.fromhex(m[0])))]
    return [(s, k, e) for s, k, e in sorted(((s, k, e) for k, s, e in set(found)), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id`` and ``spans``, an array of (kind, start, end). No shuffle."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in find_secrets(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, schema.field("spans").type)], schema=schema)

    ddl = "doc_id bigint, spans array<struct<kind:string, start:bigint, end:bigint>>"
    return ids_and_texts(docs, id_col, text_col).mapInArrow(scan, ddl)


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts of the pattern kinds, and spans written as ``kind:start:end``, joined by commas."""
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))  # noqa: E731, E501
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def number_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return scanned.select(
        "doc_id", *[number_of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
