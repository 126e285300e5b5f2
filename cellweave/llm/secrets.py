"""Secrets in texts: the plain patterns, and spans confirmed by their structure.

The base patterns are three (assign, access, hex). The structural pass looks at every maximal run of
base64, base64url or hex digits. A candidate starts wherever the run has the first digits of an encoding,
so text glued to its front does not hide it, and ends with the run; it is decoded and reported only if
the bytes parse:

* ``jwt``: three base64url runs joined by dots, the first, from some ``ey`` on or as a whole, a JSON object
  with a text ``alg``, the second a JSON object; the signature is empty only for ``alg`` none;
* ``der``: one ASN.1 element whose nested lengths fill their parents exactly to the last byte, a
  SEQUENCE with at least two children of which one is an INTEGER or a SEQUENCE (private and public
  keys, certificates);
* ``ssh``: an OpenSSH blob: ``openssh-key-v1`` and its length-prefixed fields, or a public key whose
  fields are length-prefixed to the last byte, the first naming a key type.

Lines of a PEM body are one run, also indented ones or with a written ``\\n`` between them. Runs below
LEAST_DIGITS are no candidates for keys: no key is as short. Starts are judged by their first bytes (a DER
length that does not end with the run, a JSON text that breaks off early), so a run costs its length.
Spans are code points, end exclusive. One pass over each text, whole, row by row inside Arrow batches; no
shuffle at all.

Defined results: null and empty text give no spans (n_* 0, ``spans`` empty, the hash of nothing).
Repeated rows each give their row; a null doc_id stays null. Other columns are ignored.
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

from cellweave.llm.common import id_text, pieces, table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "jwt", "ssh")

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Digits of a run that may hold a key; a run goes on over the line break of a PEM body after 48 or more.
LEAST_DIGITS = 32
BLOB = r"[A-Za-z0-9+/_-]{32,}(?:(?<=[A-Za-z0-9+/]{48})(?:\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/]{4,})*={0,2}"
BREAK = r"\r?\n[\x20\t]*|(?:\\r)?\\n|="
HEX_BLOB = r"[0-9A-Fa-f]{32,}"
URL_RUN = r"[A-Za-z0-9_-]+"
#: Digits whose JSON text is looked at before a token's header is decoded whole.
PEEK = 64

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"
OPENSSH = b"openssh-key-v1\x00"
KEY_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
CHUNK = 4 << 20


#: The first fields of OpenSSH blobs, and their whole base64 digits.
SSH_NAMES = tuple(len(k).to_bytes(4) + k for k in KEY_TYPES)
SSH_STARTS = tuple(base64.b64encode(x).decode().rstrip("=")[: len(x) * 4 // 3] for x in (OPENSSH, *SSH_NAMES))


def base_spans(text: str, rules: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in rules["assign"].finditer(text) if len(m.group(2)) >= 12]
    found += [("access", *m.span()) for m in rules["access"].finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", *m.span()) for m in rules["hex"].finditer(text) if m.end() - m.start() >= 16]


def patterns() -> dict[str, re.Pattern]:
    return {
        "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII), "access": re.compile(ACCESS), "hex": re.compile(HEX),
        "url_run": re.compile(URL_RUN), "blob": re.compile(BLOB), "hex_blob": re.compile(HEX_BLOB), "break": re.compile(BREAK),
        "start64": re.compile("(?=M[A-I]|" + "|".join(re.escape(x) for x in SSH_STARTS) + ")"),
        "start16": re.compile("(?=30|" + "|".join(x.hex() for x in (OPENSSH, *SSH_NAMES)) + ")", re.IGNORECASE),
    }


def der_end(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start of the content and end of the element at ``at``, if its length is well formed."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or tag & 0x1F == 0x1F:
        return None
    if size > 0x80:
        count = size & 0x7F
        if count > 4 or at + count > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + count]), at + count
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der(data: bytes) -> bool:
    """One SEQUENCE that ends with the data, all constructed elements filled exactly."""
    top = der_end(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    todo, children = [(top[1], top[2], True)], []
    while todo:
        at, end, outer = todo.pop()
        while at < end:
            one = der_end(data, at, end)
            if not one:
                return False
            if outer:
                children.append(one[0])
            if one[0] == 0x02 and one[1] == one[2]:
                return False
            if one[0] & 0x20:
                todo.append((one[1], one[2], False))
            at = one[2]
    return len(children) >= 2 and (0x02 in children or 0x30 in children)


def ssh_fields(data: bytes, at: int) -> list[bytes] | None:
    """Length-prefixed fields from ``at`` to the last byte."""
    fields = []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields


def is_ssh(data: bytes) -> bool:
    if data.startswith(OPENSSH):  # cipher, kdf, options, number of keys, public keys, private part
        at, names = len(OPENSSH), []
        for _ in range(3):
            size = int.from_bytes(data[at : at + 4])
            names.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        count, rest = int.from_bytes(data[at : at + 4]), ssh_fields(data, at + 4)
        return bool(names[0]) and rest is not None and 0 < count == len(rest) - 1
    fields = ssh_fields(data, 0) if data[:3] == b"\0\0\0" else None
    return bool(fields) and len(fields) >= 2 and fields[0] in KEY_TYPES


def unbase64(digits: str) -> bytes | None:
    digits = digits.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fits(head: bytes, size: int) -> bool:
    """Whether a DER header says that its element has so many bytes in all."""
    if len(head) < 2 or head[1] < 0x80:
        return len(head) >= 2 and 2 + head[1] == size
    count = head[1] & 0x7F
    return 1 <= count <= 4 and 2 + count + int.from_bytes(head[2 : 2 + count]) == size


def _kind(head: bytes, size: int, whole) -> str | None:
    """What a candidate of ``size`` bytes is; ``whole()`` decodes it if its first bytes may be something."""
    if head[:1] == b"\x30":
        return "der" if der_fits(head, size) and is_der(whole() or b"") else None
    return "ssh" if is_ssh(whole() or b"") else None


def _json_object(run: str, at: int = 0) -> dict | None:
    """The object that base64url digits encode from ``at`` on; a text that breaks off early is not decoded whole."""
    if len(run) - at > PEEK:
        try:
            json.loads((unbase64(run[at : at + PEEK]) or b"").decode())
            return None  # a whole text with more behind it
        except json.JSONDecodeError as e:
            if e.pos < len(e.doc) - 8 and not e.msg.startswith("Unterminated"):
                return None
        except UnicodeDecodeError as e:
            if e.start < len(e.object) - 4:  # else a character may be cut
                return None
        except RecursionError:
            return None
    try:
        got = json.loads((unbase64(run[at:]) or b"").decode())
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def jwt_spans(text: str, rules: dict[str, re.Pattern]) -> Iterator[tuple[str, int, int]]:
    before: list[re.Match] = []
    free = 0
    for run in rules["url_run"].finditer(text):
        if before and not (before[-1].end() + 1 == run.start() and text[before[-1].end()] == "."):
            before = []
        before = [*before[-2:], run]
        if len(before) < 2:
            continue
        # Three runs; or two and a dot, with the empty signature of an unsigned token.
        head, body, sign = before if len(before) == 3 else (*before, None)
        if sign is None or head.start() < free:
            unsigned = before[-2:] if text[run.end() : run.end() + 1] == "." and not rules["url_run"].match(text, run.end() + 1) else None
            if unsigned is None or unsigned[0].start() < free:
                continue
            head, body, sign = *unsigned, None
        found = _token(head, body, sign)
        if found is None and sign is not None and text[run.end() : run.end() + 1] == "." and not rules["url_run"].match(text, run.end() + 1):
            head, body, sign = body, sign, None
            found = _token(head, body, sign)
        if found is not None:
            free = sign.end() if sign else body.end() + 1
            yield "jwt", found, free


def _token(head: re.Match, body: re.Match, sign: re.Match | None) -> int | None:
    """Where a token with these parts starts, or nothing."""
    run, claims = head.group(), None
    # A header is a JSON object, whose first bytes are encoded as "e" or "I", "C" or "D" (white space).
    starts = {m.start() for m in re.finditer("ey", run)} | ({0} if run[0] in "eICD" else set())
    for at in sorted(starts):
        header = _json_object(run, at)
        if header is None or not isinstance(header.get("alg"), str):
            continue
        claims = claims or _json_object(body.group())
        if claims is None:
            return None
        signature = sign.group() if sign else ""
        if unbase64(signature) is not None and (len(signature) >= 8 or header["alg"].lower() == "none"):
            return head.start() + at
    return None


def structural_spans(text: str, rules: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    found = list(jwt_spans(text, rules)) if "." in text else []
    for m in rules["blob"].finditer(text):
        digits = rules["break"].sub("", m.group())
        for start in rules["start64"].finditer(digits):
            at = start.start()
            size = (len(digits) - at) * 3 // 4
            kind = _kind(unbase64(digits[at : at + 8]) or b"  ", size, lambda at=at: unbase64(digits[at:]))
            if kind:
                found.append((kind, m.start() + _offset(m.group(), at, rules["break"]), m.end()))
                break
    for m in rules["hex_blob"].finditer(text):
        run = m.group()
        for start in rules["start16"].finditer(run):
            at = start.start()
            if (len(run) - at) % 2 == 0 and len(run) - at >= LEAST_DIGITS:
                kind = _kind(bytes.fromhex(run[at : at + 12]), (len(run) - at) // 2, lambda at=at: bytes.fromhex(run[at:]))
                if kind:
                    found.append((kind, m.start() + at, m.end()))
                    break
    return found


def _offset(run: str, at: int, breaks: re.Pattern) -> int:
    """Where the digit number ``at`` stands in a run with line breaks."""
    for m in breaks.finditer(run):
        if m.start() > at:
            break
        at += m.end() - m.start()
    return at


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = patterns()
    for batch in pieces(batches, "text", CHUNK):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text, rules)
            more = structural_spans(text, rules)
            count = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(set(more))))
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structural"]
        columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds and all spans as text."""
    return id_text(docs).mapInArrow(_scan, SCHEMA)


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
