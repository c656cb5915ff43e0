"""Secret scan: patterns, and structural confirmation of encoded keys and tokens.

Base kinds are patterns alone (assignments, access ids, hexadecimal runs).  Further
kinds are candidates that are decoded and parsed before they are reported:

``pem``   a private key block whose base64 decodes to a key (DER or OpenSSH form)
``jwt``   three base64url parts, the first a JSON object that names an algorithm
``der``   a base64 or hexadecimal run whose DER lengths nest exactly and whose
          elements are those of a private key
``ssh``   the same of the OpenSSH private form with nested length prefixes

Keys are read from their first bytes on, wherever these stand in a run, for as many
digits as their own lengths ask for.  Line breaks, real or escaped, quote marks and what
joins quoted lines may stand between the digits.

Offsets are code points, ends exclusive; spans come by start, then by kind.  Defined
results: a null text is empty and has no span; repeated rows are scanned each by
itself; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import documents, narrow, small_batches

KINDS = ["assign", "access", "hex", "pem", "jwt", "der", "ssh"]
BASE = KINDS[:3]

ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the maximal runs of 24 and more
PEM = re.compile(
    rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s:,.\\\"'`;>#*|&-]*?)-----END \1-----"
)
JWT = re.compile(rb"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# between lines of digits: quoted parts that are joined, escaped breaks and slashes, blanks, quotes, margins
JOIN = rb"""["'`]\s*[+.&]\s*["'`]|\\+(?:[nrt]|\r?\n|(?=/))|[\s"'`,;>#*|]"""
JOINED = re.compile(JOIN)
BREAK = re.compile(rb"(?:" + JOIN + rb")+")
HEX_BREAK = re.compile(rb"(?:" + JOIN + rb"|:|0x|\\+x)+")
DIGITS = re.compile(rb"[A-Za-z0-9+/_-]+")
HEX_DIGITS = re.compile(rb"(?:(?!0x)[0-9a-fA-F])+")
LEAST = 30  # bytes of a key
# a DER sequence in base64 begins with M and one of A to P
DER_START = re.compile(rb"M(?=[A-P][A-Za-z0-9+/_-]{18})")
SSH_START = re.compile(rb"b3BlbnNzaC1rZXktdjEA")


def _hex_bytes(pattern: str) -> bytes:
    """Pattern of hexadecimal bytes, ``..`` being any, each with a mark before it or not."""
    mark = r"(?:[:\s]|,?\s*0x|\\+x)?"
    return "".join(mark + ("[0-9a-f]" * 2 if x == ".." else x) for x in pattern.split()).encode()


_HEX_SIZES = ["[0-7][0-9a-f]", "81 ..", "82 .. ..", "83 .. .. .."]
HEX_START = re.compile(
    rb"30(?=" + rb"|".join(
        _hex_bytes(f"{size} {inner}")
        for size in _HEX_SIZES for inner in ("02 01 0[01]", *(f"30 {x} 06" for x in _HEX_SIZES[:3]))
    ) + rb")",
    re.IGNORECASE,
)
HEX_SSH_START = re.compile(b"6f" + _hex_bytes(" ".join(f"{x:02x}" for x in b"penssh-key-v1\0")), re.IGNORECASE)
SSH_MAGIC = b"openssh-key-v1\0"


def _base64(data: bytes) -> bytes | None:
    data = data.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of DER elements that fill ``data`` exactly."""
    at, found = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            width = n & 0x7F
            if not 0 < width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + width], "big")
            if n < 0x80:
                return None
            at += width
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


def private_der(data: bytes) -> bool:
    """Whether the bytes are one DER private key: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8."""
    top = _elements(data) if len(data) >= 16 else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _elements(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    whole = len(tags) in (6, 9) and set(tags) == {2} and inner[0][1] in (b"\0", b"\1")
    if whole:  # version and numbers
        return all(v and len(v) >= 1 for _, v in inner)
    if tags[:2] == [2, 4] and inner[0][1] == b"\1":  # SEC1
        return len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):  # PKCS#8
        names = _elements(inner[1][1])
        return bool(names) and names[0][0] == 6 and bool(_elements(inner[2][1]))
    if tags == [0x30, 4]:
        names = _elements(inner[0][1])
        return bool(names) and names[0][0] == 6 and names[0][1].startswith(bytes.fromhex("2a864886f70d01"))
    return False


def ssh_size(data: bytes) -> int | None:
    """Length of the OpenSSH private key that starts the bytes: magic, then length-prefixed strings."""
    if not data.startswith(SSH_MAGIC):
        return None
    at = len(SSH_MAGIC)
    for _ in range(3):  # cipher, derivation and its options
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data):
        return None
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(count + 1 if count < 100 else 0):  # public keys, then the private part
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def private_ssh(data: bytes) -> bool:
    """Whether the bytes are one OpenSSH private key."""
    return ssh_size(data) == len(data)


def der_size(head: bytes) -> int | None:
    """Length of the DER private key that may start with these bytes (15 or more)."""

    def content(at: int) -> tuple[int, int] | None:
        n = head[at + 1]
        if n < 0x80:
            return at + 2, n
        width = n & 0x7F
        if not 0 < width <= 4:
            return None
        return at + 2 + width, int.from_bytes(head[at + 2 : at + 2 + width], "big")

    if head[0] != 0x30 or not (top := content(0)):
        return None
    at, n = top
    if head[at : at + 3] in (b"\2\1\0", b"\2\1\1"):
        return at + n
    inner = content(at) if head[at] == 0x30 else None
    return at + n if inner and head[inner[0] : inner[0] + 1] == b"\6" else None


def _digits(body: bytes, at: int, most: int | None, hexed: bool) -> tuple[bytes, int]:
    """Up to ``most`` digits from ``at`` on, across breaks, and the place behind the last."""
    digits, breaks = (HEX_DIGITS, HEX_BREAK) if hexed else (DIGITS, BREAK)
    parts, end, n = [], at, 0
    while most is None or n < most:
        if not (m := digits.match(body, at)):
            break
        part = m[0] if most is None else m[0][: most - n]
        n, at = n + len(part), at + len(part)
        parts.append(part)
        end = at
        if n != most and (gap := breaks.match(body, at)):
            at = gap.end()
    return b"".join(parts), end


def _decoded(digits: bytes, hexed: bool) -> bytes:
    if hexed:
        return bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    return _base64(digits[: -1 if len(digits) % 4 == 1 else None]) or b""


def keys(body: bytes, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of keys in base64 and hexadecimal digits outside those taken."""
    for start, kind, hexed in ((DER_START, 5, False), (HEX_START, 5, True), (SSH_START, 6, False), (HEX_SSH_START, 6, True)):
        end = 0
        for m in start.finditer(body):
            if m.start() < end or any(a <= m.start() < b for a, b in taken):
                continue
            if kind == 5:
                digits, _ = _digits(body, m.start(), 40 if hexed else 20, hexed)
                head = _decoded(digits, hexed)
                size = der_size(head) if len(head) >= 15 else None
            else:
                size = ssh_size(_decoded(_digits(body, m.start(), None, hexed)[0], hexed))
            if not size or size < LEAST:
                continue
            want = size * 2 if hexed else -(-size * 4 // 3)
            digits, last = _digits(body, m.start(), want, hexed)
            raw = _decoded(digits, hexed)
            if len(digits) == want and (private_der(raw) if kind == 5 else private_ssh(raw)):
                end = last
                for _ in range(0 if hexed else 2):
                    end += body[end : end + 1] == b"="
                yield m.start(), kind, end


def signed_token(data: bytes) -> bool:
    """Whether a candidate's first part is a JSON header that names an algorithm."""
    head, body, _ = data.split(b".", 2)
    raw, second = _base64(head), _base64(body)
    try:
        parsed = json.loads(raw) if raw else None
    except ValueError:
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str) and second is not None


def _pem_body(data: bytes) -> bool:
    # blanks and commas belong to header lines
    lines = [x.strip() for x in JOINED.sub(lambda m: m[0] if m[0] in (b" ", b",") else b"\n", data).splitlines()]
    encrypted = any(x.startswith(b"Proc-Type:") for x in lines)
    raw = _base64(b"".join(x for x in b" ".join(x for x in lines if b":" not in x).split()))
    return bool(raw) and (private_der(raw) or private_ssh(raw) or (encrypted and len(raw) >= 64))


def scan(body: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in bytes, sorted."""
    found: list[tuple[int, int, int]] = []
    if b"=" in body or b":" in body:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in body:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(body)]
    taken: list[tuple[int, int]] = []
    if b"-----BEGIN" in body:
        for m in PEM.finditer(body):
            if _pem_body(m[2]):
                found.append((m.start(), 3, m.end()))
                taken.append(m.span())
    if b"eyJ" in body:
        found += [(m.start(), 4, m.end()) for m in JWT.finditer(body) if signed_token(m[0])]
    found += keys(body, taken)
    return sorted(found)


def code_points(body: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or body.isascii():
        return spans
    at = np.r_[0, np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)]
    return [(int(at[a]), k, int(at[b])) for a, k, b in spans]


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` (kind, start, end in code points) for every row; no shuffle."""
    rows = narrow(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in code_points(x, scan(x))]
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all rows and columns stay.

    Overlapping spans become one mark.  Null texts stay null.  ``length_col``, if
    there, is counted anew where a text changed.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = names.index(text_col)
            texts, changed = batch.column(at).to_pylist(), False
            for i, text in enumerate(texts):
                if not text:
                    continue
                body = text.encode("utf-8", "replace")
                if not (spans := scan(body)):
                    continue
                out, end, changed = [], 0, True
                for a, _, b in spans:
                    if a >= end:
                        out += [body[end:a], mark.encode()]
                    end = max(end, b)
                texts[i] = b"".join([*out, body[end:]]).decode("utf-8", "replace")
            if changed:
                columns = batch.columns
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    done = docs.mapInArrow(run, docs.schema)
    if length_col in names:
        kind = docs.schema[length_col].dataType
        done = done.withColumn(
            length_col,
            F.when(F.contains(text_col, F.lit(mark)), F.length(text_col).cast(kind)).otherwise(F.col(length_col)),
        )
    return done


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[count(k) for k in KINDS[3:]],
    )
