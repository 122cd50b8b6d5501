"""Secret scans with structural confirmation (operator 3).

Patterns find assignments, access keys and long hexadecimal runs. Beyond them, runs of
base64 or hexadecimal letters and armoured blocks are candidates only: each is decoded
and its bytes must parse before it is reported.

- `der_key`: DER whose nested lengths fill the data exactly and whose members are those
  of a private key (PKCS#8, PKCS#1, SEC 1, DSA), armoured (also with escaped line
  ends), in base64 of either alphabet or in hexadecimal, or armour encoded once more;
- `encrypted_key`: an encrypted PKCS#8 key (a password scheme's algorithm, then the data),
  or armour whose header names a cipher and a start value of which the data's length is
  a multiple;
- `openssh_key`: the OpenSSH private key container, field by field to its end;
- `signed_token`: three base64url parts, the first a JSON object that names an
  algorithm, the second a JSON object, the third empty only if the algorithm is none.

Base64 without armour may be wrapped over lines of any length, the first with 16 letters
or more (OpenSSH: 20): the lengths in the bytes say where the key ends, and it must end with a line.
Armour without its closing line is read so too, and its span begins with its opening line.

Spans are kind, start, end in code points, end exclusive. One pass, no shuffle.

Defined cases: null text is empty and has no spans; spans of different kinds may
overlap; repeated rows are scanned alike; an empty table gives no rows. Extra columns
are ignored; `redacted` returns all columns of its input.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common

KINDS = ("assign", "access", "hex", "der_key", "openssh_key", "signed_token", "encrypted_key")
BASE = KINDS[:3]

# fixed values: patterns and least lengths of the base kinds
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
# parts of a run that other letters precede or follow
_PARTS = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"), re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{39,}={0,2}"))
_HEXES = re.compile(r"(?:[0-9a-f]{2}){32,}|(?:[0-9A-F]{2}){32,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----((?:[^-]++|-(?!----))*+)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})[ \t]*$", re.MULTILINE)
# the first line of a wrapped key: a DER sequence or the OpenSSH container, in base64
_FIRST = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?:M[A-I][A-Za-z0-9+/_-]{14,}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]*)")
_LINE = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*([A-Za-z0-9+/_-]+)")
_PADDING = re.compile(r"={0,2}")
_OPENING = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}-----(?:\s|\\+[nr])*$")
_MAGIC = b"openssh-key-v1\0"
# object identifiers of password-based encryption: PKCS#5 and PKCS#12
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{20,}")
_HEAD = re.compile(r"(?<![A-Za-z0-9])e[wy][A-Za-z0-9_-]{6,}")  # a brace and what may follow it
_ESCAPED = re.compile(r"\\+[nr]|\r")


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or end - at < width or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    outer = _elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    members = _elements(data, *outer[0][1:])
    if not members:
        return False
    tags = [m[0] for m in members]
    version = int.from_bytes(data[members[0][1] : members[0][2]], "big") if tags[0] == 2 and members[0][2] - members[0][1] == 1 else None
    if version is None:
        return False
    if tags[:3] == [0x02, 0x30, 0x04] and version in (0, 1):  # PKCS#8: algorithm, then the key
        algorithm = _elements(data, *members[1][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and members[2][2] > members[2][1] and all(t & 0xE0 in (0x80, 0xA0) for t in tags[3:])
    if set(tags) == {2}:  # PKCS#1 has nine integers, a DSA key six
        return version in (0, 1) and len(tags) in (6, 9) and all(m[2] > m[1] for m in members)
    if tags[:2] == [0x02, 0x04] and version == 1:  # SEC 1, with optional curve and point
        return members[1][2] - members[1][1] in range(16, 73) and all(t in (0xA0, 0xA1) and _elements(data, a, b) for t, a, b in members[2:])
    return False


def is_encrypted_key(data: bytes) -> bool:
    """Encrypted PKCS#8: a password-based algorithm with its parameters, then the data."""
    outer = _elements(data, 0, len(data))
    members = _elements(data, *outer[0][1:]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not members or [m[0] for m in members] != [0x30, 0x04] or members[1][2] == members[1][1]:
        return False
    algorithm = _elements(data, *members[0][1:])
    if not algorithm or [a[0] for a in algorithm] != [0x06, 0x30] or not data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_BASED):
        return False
    return bool(_elements(data, *algorithm[1][1:]))


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(_MAGIC):
        return False
    at = len(_MAGIC)

    def field():
        nonlocal at
        if at + 4 > len(data):
            raise ValueError
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError
        at += 4 + size
        return data[at - size : at]

    try:
        cipher, kdf, _ = field(), field(), field()
        keys = int.from_bytes(data[at : at + 4], "big")
        at += 4
        public = [field() for _ in range(keys)] if 1 <= keys <= 16 else []
        private = field()
    except ValueError:
        return False
    return at == len(data) and bool(cipher and kdf and public and private)


def _decoded(run: str) -> bytes | None:
    """Bytes of a base64 run of either alphabet."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _armoured(text: str) -> list[tuple[str, int, int]]:
    """Spans of armoured keys; line ends may be escaped, as in JSON."""
    found = []
    for m in _ARMOUR.finditer(text):
        body = _ESCAPED.sub("\n", m[2].replace("\r\n", "\n").replace("\\r\\n", "\n")).replace("\\/", "/")
        head, body = body.split("\n\n", 1) if ":" in body and "\n\n" in body else ("", body)
        data, cipher = _decoded("".join(body.split())), _CIPHER.search(head)
        if cipher and data and len(data) % (len(cipher[1]) // 2) == 0 and m[1].endswith("PRIVATE KEY"):
            found.append(("encrypted_key", *m.span()))
            continue
        kind = _key_kind(data)
        if kind:
            found.append((kind, *m.span()))
    return found


def _reach(data: bytes) -> int:
    """How many bytes the key that begins with `data` has at least; all it has, once
    `data` holds so many."""
    if not data.startswith(_MAGIC):
        width = data[1] & 0x7F if data[1] & 0x80 else 0
        return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
    at = len(_MAGIC)
    for n in (3, 1):  # fields before the number of keys; keys and the private part
        if n == 1:
            if at + 4 > len(data):
                return at + 4
            n, at = 1 + int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(n):
            if at + 4 > len(data):
                return at + 4
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                return at
    return at


def _wrapped(text: str) -> list[tuple[str, int, int]]:
    """Spans of keys in base64 wrapped over two lines or more."""
    found, done = [], -1
    for m in _FIRST.finditer(text):
        if m.start() < done:
            continue
        run, at, next_line = m[0], m.end(), True
        while next_line:
            data = _decoded(run[: len(run) & ~3])
            need = -(-_reach(data) * 4 // 3)
            if need <= len(run) or need > len(text) - m.start():
                break
            lines, have = [run], len(run)
            while have < need and (next_line := _LINE.match(text, at)):
                lines.append(next_line[1])
                have, at = have + len(next_line[1]), next_line.end()
            run = "".join(lines)
        if at > m.end() and len(run) == need and (kind := _key_kind(_decoded(run))):
            opening = _OPENING.search(text[max(0, m.start() - 100) : m.start()])
            start = m.start() - len(opening[0]) if opening else m.start()
            done = _PADDING.match(text, at).end()
            found.append((kind, start, done))
    return found


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if b"-----BEGIN " in data:  # armour that was encoded once more
        inside = _armoured(data.decode("latin-1"))
        return inside[0][0] if inside else None
    if is_der_key(data):
        return "der_key"
    return "openssh_key" if is_openssh_key(data) else "encrypted_key" if is_encrypted_key(data) else None


def _base64_keys(text: str) -> list[tuple[str, int, int]]:
    """Spans of keys in base64 of either alphabet: the whole run, else its parts."""
    found = []
    for m in _BASE64.finditer(text):
        kind = _key_kind(_decoded(m[0]))
        if kind:
            found.append((kind, *m.span()))
            continue
        for x in (x for p in _PARTS for x in p.finditer(m[0])):
            kind = _key_kind(_decoded(x[0])) if x[0] != m[0] else None
            if kind:
                found.append((kind, m.start() + x.start(), m.start() + x.end()))
    return found


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens; any part of a dotted run may be the first of one, also
    after a hyphen or underscore."""
    found = []
    for run in _DOTTED.finditer(text):
        parts, at, done = run[0].split("."), run.start(), -1
        for i, part in enumerate(parts[:-2]):
            for m in _HEAD.finditer(part) if at > done else ():
                start = _decoded(part[m.start() : m.start() + 4])
                if start and start[:1] == b"{" and start[1:2] in b'" \t\r\n' and is_signed_token(part[m.start() :], parts[i + 1], parts[i + 2]):
                    done = at + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    found.append(("signed_token", at + m.start(), done))
                    break
            at += len(part) + 1
    return found


def is_signed_token(head: str, body: str, signature: str) -> bool:
    parts = []
    for x in (head, body):
        data = _decoded(x)
        if data is None or data[:1] != b"{":
            return False
        try:
            parts.append(json.loads(data))
        except (ValueError, RecursionError):
            return False
    algorithm = parts[0].get("alg") if all(isinstance(p, dict) for p in parts) else None
    if not isinstance(algorithm, str) or not algorithm:
        return False
    return algorithm.lower() == "none" if not signature else _decoded(signature) is not None


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:  # no candidate holds white space
        for run in _RUN.finditer(text):
            at, part = run.start(), run[0]
            found += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= LEAST["hex"]]
            for m in _HEXES.finditer(part):
                kind = _key_kind(bytes.fromhex(m[0]))
                if kind:
                    found.append((kind, at + m.start(), at + m.end()))
        found += _base64_keys(text)
    if "." in text and ("ey" in text or "ew" in text):
        found += _tokens(text)
    armoured = _armoured(text) if "-----BEGIN " in text else []
    found += armoured
    if longest >= 16 and ("\n" in text or "\\n" in text):
        found += [s for s in _wrapped(text) if not any(a <= s[1] and s[2] <= b for _, a, b in armoured)]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def spans(df: DataFrame, text: str = "text", out: str = "spans", keep_text: bool = True) -> DataFrame:
    """`df` with all spans of its text column as an array of kind, start, end."""

    def make():
        return lambda texts: ([[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] for t in texts],)

    return common.append(df, text, T.StructType([T.StructField(out, T.ArrayType(_SPAN))]), make, keep_text)


def redact(text: str) -> str:
    """`text` with each stretch that spans cover replaced by a mark of its first kind."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in scan(text):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"[{kind} removed]"]
        done = end
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`df` with the secrets of its text column replaced; texts without any stay as
    they are, a null text stays null. A column `length` holds the new length where
    the text was changed."""
    clean = common.free_name(df, "clean")

    def make():
        def work(texts):
            return ([r if (r := redact(t)) != t else None for t in texts],)

        return work

    changed = F.col(clean).isNotNull()
    found = common.append(df, text, T.StructType([T.StructField(clean, T.StringType())]), make)
    out = found.withColumn(text, F.coalesce(clean, f"`{text}`"))
    if length in df.columns:
        out = out.withColumn(length, F.when(changed, F.length(text).cast(df.schema[length].dataType)).otherwise(F.col(f"`{length}`")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digests(df: DataFrame, column: str = "spans") -> list:
    """Counts, digest of the base spans, and all spans as text, from a column of spans."""
    s = F.col(column)
    text = lambda x: F.array_join(F.transform(x, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(s, lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return [*counts, F.sha2(text(F.filter(s, lambda e: e["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"), text(s).alias("spans")]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *digests(found))


def brute(text: str) -> tuple:
    """The base columns by the patterns alone, for tests."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    found.sort(key=lambda s: (s[1], BASE.index(s[0])))
    return *(sum(s[0] == k for s in found) for k in BASE), hashlib.sha256(listed(found).encode()).hexdigest()
