"""Secret scan: pattern candidates, and keys and tokens confirmed by decoding and parsing their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(?:" + "|".join(_EITHER(w) for w in ("password", "passwd", "secret", "token")) + "|" + _EITHER("api") + "_?" + _EITHER("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])e[w-z][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Runs over line breaks, as they are or escaped; the lines are told apart by BREAKS, as an escaped break ends in a letter.
LINE_END = r"(?:[\x20\t]*(?:\\+r)?(?:\\+n|\r?\n)[\x20\t]*)"
#: Both begin at the start of a run and never give a character back, so a run is read once.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{32,}}+(?:{LINE_END}[A-Za-z0-9+/]++)++={{0,2}}")
LONG_HEX = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
WRAPPED_HEX = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{16,}}+(?:{LINE_END}[0-9A-Fa-f]{{2,}}+)++")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
BREAKS = re.compile(r"\\+r|\\+n|\r\n?|\n")
HEADER = re.compile(r"\s*([A-Za-z][A-Za-z0-9-]*):\x20?(.*)")
#: In the order that breaks ties of spans.
KINDS = ("assign", "access", "hex", "signed", "armour", "key")


def _base64(value: str) -> bytes | None:
    body = value.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` exactly, by definite DER lengths; None if it isn't such a row."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def key_encoding(data: bytes | None) -> str | None:
    """The kind of private or public key that ``data`` encodes, by its nested lengths; None if it doesn't parse as one."""
    if not data:
        return None
    if data.startswith(magic := b"openssh-key-v1\0"):
        at = len(magic)
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data) or (n := int.from_bytes(data[at : at + 4], "big")) > len(data) - at - 4:
                return None
            at += 4 + n
        return "openssh"
    if data[:4] == b"\0\0\0\x07" and data[4:11] == b"ssh-rsa" or data[:4] == b"\0\0\0\x0b" and data[4:15] == b"ssh-ed25519":
        at, parts = 0, 0
        while at + 4 <= len(data) and (n := int.from_bytes(data[at : at + 4], "big")) <= len(data) - at - 4:
            at, parts = at + 4 + n, parts + 1
        return "ssh-public" if at == len(data) and parts >= 2 else None
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or not (inner := _elements(outer[0][1])):
        return None
    tags = [t for t, _ in inner]
    if tags[:3] == [2, 0x30, 4] and (name := _elements(inner[1][1])) and name[0][0] == 6:
        return "pkcs8"
    if tags == [0x30, 4] and inner[1][1] and (name := _elements(inner[0][1])) and name[0][0] == 6:
        return "pkcs8-encrypted"
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return "rsa"
    if tags == [2] * 6 and inner[0][1] == b"\0":
        return "dsa"
    if tags[:2] == [2, 4] and inner[0][1] == b"\x01" and len(inner[1][1]) in range(20, 67):
        return "ec"
    if tags == [0x30, 3] and (name := _elements(inner[0][1])) and name[0][0] == 6:
        return "public"
    return None


def pgp_secret(data: bytes | None) -> bool:
    """Whether ``data`` begins with a whole OpenPGP secret-key packet of a known version."""
    if not data or len(data) < 6 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, n, at = data[0] & 0x3F, data[1], 2
        if n >= 192:
            n, at = ((n - 192 << 8) + data[2] + 192, 3) if n < 224 else (int.from_bytes(data[2:6], "big"), 6) if n == 255 else (1, 2)
    else:
        tag, width = data[0] >> 2 & 15, data[0] & 3
        at = 1 + (1 << width) if width < 3 else 1
        n = int.from_bytes(data[1:at], "big") if width < 3 else len(data) - 1
    return tag == 5 and n > 0 and at + n <= len(data) and data[at] in (2, 3, 4, 5, 6)


def armoured(label: str, body: str) -> str | None:
    """What the body of an armoured private key holds: header lines and escaped line breaks are taken off before decoding."""
    lines, headers = [], {}
    for line in BREAKS.split(body):
        if (m := HEADER.fullmatch(line)) and not lines:
            headers[m[1].lower()] = m[2]
        elif x := re.sub(r"[\s\\\"',>|#*]", "", line):
            lines.append(x)
    if lines and len(lines[-1]) == 5 and lines[-1][0] == "=":  # the checksum of OpenPGP
        lines.pop()
    value = "".join(lines)
    data = _base64(value) if re.fullmatch(r"[A-Za-z0-9+/]+=*", value) else None
    if label.endswith("BLOCK"):
        return "pgp" if pgp_secret(data) else None
    if "encrypted" in headers.get("proc-type", "").lower() and "dek-info" in headers:  # ciphertext, in blocks of its cipher
        return "encrypted" if data and len(data) >= 32 and len(data) % 8 == 0 else None
    return key_encoding(data)


#: So many characters of base64 or hex show a key's opening and its first length.
HEAD = 48


def may_be_key(head: bytes | None, size: int) -> bool:
    """Whether ``size`` bytes that begin with ``head`` can be a key: a known opening, or a sequence whose own length fills them.

    Looks at the head only, so that of the many places where a key might begin few are decoded.
    """
    if not head or len(head) < 2:
        return False
    for opening in (b"openssh-key-v1\0", b"\0\0\0\x07ssh-rsa", b"\0\0\0\x0bssh-ed25519"):
        if head.startswith(opening):  # the length of what follows
            at = len(opening) + 4
            return at <= size and int.from_bytes(head[at - 4 : at], "big") <= size - at
    n = head[1] & 0x7F
    total = 2 + n if not head[1] & 0x80 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else -1
    return head[0] == 0x30 and total == size


def realigned(value: str) -> tuple[int, str] | None:
    """The offset and kind of a key that ends a run of base64 characters: after a slash or dash, which may be of a path.

    A sequence's own length must fill the rest, so few rests are decoded, however long the run.
    """
    length = len(value.rstrip("="))
    for m in re.finditer(r"[/_-](?=M|b3BlbnNza|AAAAB3NzaC1yc2E|AAAAC3NzaC1lZDI1NTE5)", value):
        head = value[m.end() : m.end() + HEAD]
        whole = head.rstrip("=")
        if may_be_key(_base64(whole[: len(whole) - (len(whole) % 4 == 1)]), (length - m.end()) * 3 // 4) and (kind := key_encoding(_base64(value[m.end() :]))):
            return m.end(), kind
    return None


def key_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Keys in base64 on one line."""
    out = []
    for m in BASE64.finditer(text):
        if kind := key_encoding(_base64(m[0])):
            out.append((m.start(), m.end(), "key", kind))
        elif found := realigned(m[0]):
            out.append((m.start() + found[0], m.end(), "key", found[1]))
    return out


def wrapped_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Keys in base64 or hex whose lines are joined over their ends: of each run of lines, the stretches that parse."""
    out = []
    for pattern, decode, wide, part in ((WRAPPED, _base64, 4, 3), (WRAPPED_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None, 2, 1)):
        for m in pattern.finditer(text):
            at, lines = m.start(), []
            at += at > 0 and text[at - 1] == "\\" and text[at] in "nrt"  # the letter of an escape
            for x in BREAKS.split(text[at : m.end()]):
                first = text.index(x, at)
                body = x.strip()
                if body:
                    lines.append((first + x.index(body), body))
                at = first + len(x)
            ends, before = [len(lines)] * len(lines), [0]
            for i in range(len(lines) - 2, -1, -1):  # where the lines as long as this one end
                ends[i] = ends[i + 1] if len(lines[i][1]) == len(lines[i + 1][1]) else i + 1
            bare = [x.rstrip("=") for _, x in lines]
            for x in bare:
                before.append(before[-1] + len(x))
            joined = "".join(bare)
            i = 0
            while i < len(lines):
                # the lines of one key are of one length, but for the last
                j = ends[i] + (ends[i] < len(lines) and len(lines[ends[i]][1]) < len(lines[i][1]))
                head = joined[before[i] : min(before[i] + HEAD, before[j])]
                opening = decode(head[: len(head) // wide * wide])
                for end in range(j, max(i + 1, j - 2), -1):  # a word after a full last line isn't of the key
                    if may_be_key(opening, (before[end] - before[i]) * part // wide) and (kind := key_encoding(decode("".join(x for _, x in lines[i:end])))):
                        out.append((lines[i][0], lines[end - 1][0] + len(lines[end - 1][1]), "key", kind))
                        i = end
                        break
                else:
                    i += 1
    return out


def signed_token(value: str) -> str | None:
    """The ``alg`` of a signed token ``header.payload.signature`` whose header and payload are JSON objects; else None."""
    try:
        header, payload = (json.loads(_base64(part) or b"") for part in value.split(".")[:2])
    except (ValueError, RecursionError):
        return None
    alg = header.get("alg") if isinstance(header, dict) and isinstance(payload, dict) else None
    return alg if isinstance(alg, str) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Assignments with a value of 12 or more characters, access ids of 18 or more, hex runs of 16 or more: whole matches, unconfirmed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Spans that decode and parse: signed tokens, armoured private keys, and keys in base64 or hex, with what was found."""
    out = [(m.start(), m.end(), "signed", alg) for m in SIGNED.finditer(text) if (alg := signed_token(m[0]))]
    armour = [(m.start(), m.end(), "armour", kind) for m in ARMOUR.finditer(text) if (kind := armoured(m[1], m[2]))]
    out += armour
    out += key_spans(text)
    out += [(m.start(), m.end(), "key", kind) for m in LONG_HEX.finditer(text) if (kind := key_encoding(bytes.fromhex(m[0])))]
    out += [x for x in wrapped_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, *_ in armour)]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"]
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("structure", pa.string())])
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base, more = base_spans(text), confirmed_spans(text)
            kinds = [k for _, _, k in base]
            found = [{"kind": k, "start": a, "end": b, "value": text[a:b], "structure": None} for a, b, k in base] + [{"kind": k, "start": a, "end": b, "value": text[a:b], "structure": s} for a, b, k, s in more]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + [s[:3] for s in more]), sorted(found, key=lambda f: (f["start"], KINDS.index(f["kind"])))))
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(finding)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text, one row per input row.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, findings``: counts and digest of the pattern spans,
    all spans as ``kind:start:end`` (code points, end exclusive, by start, then kind), and each finding with its text
    and, where decoding confirmed it, its structure.  Null text counts as empty: zeros, the digest of "", no spans.  Rows are
    independent: repeated rows repeat, null ids are carried, an empty table is empty, other columns are ignored; a long text is scanned
    whole, in time that grows with its length, also where it is one run of key-like characters.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind:string,start:bigint,end:bigint,value:string,structure:string>>")
