"""Secret scan by structural confirmation.

Regular expressions only propose. Any base64 (either alphabet), hex or token candidate is decoded and becomes a structural
finding when its bytes hold up: DER key encodings whose nested lengths add up, OpenSSH key containers, PEM blocks around
either, and signed tokens whose header is JSON that names an algorithm. Decoded base64 and hex may hold any of these.
Candidates may be broken into lines, hex also by colons or spaces; what is decoded says itself where such a one ends.

Nulls and empty texts give no finding; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored. Very long texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_and_text, per_batch, rows_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*?)-----END \1-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
URLSAFE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{62,}")
#: The same in pieces: base64 broken into lines, as such or escaped, and pairs or lines of hex between colons and white space.
LINE_END = r"[ \t]*+(?:\\r)?+(?:\\n|\r?\n)[ \t]*+"
BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{40,}}+(?:{LINE_END}[A-Za-z0-9+/]++)+={{0,2}}")
URLSAFE_LINES = re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{40,}}+(?:{LINE_END}[A-Za-z0-9_-]++)+={{0,2}}")
HEX_PIECES = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2})++(?:(?::\s*+|\s++)(?:[0-9A-Fa-f]{2})++(?![0-9A-Fa-f]))++")
PIECE = re.compile(r"[A-Za-z0-9+/_-]")
ESCAPED = re.compile(r"\\[rn]")

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "signed", "der", "openssh")
BASE_KINDS = KINDS[:3]
ORDER = {k: i for i, k in enumerate(KINDS)}
STANDARD = str.maketrans("-_", "+/")
OPENSSH_MAGIC = b"openssh-key-v1\0"
#: DER tags that a private key's SEQUENCE holds: INTEGER, BIT STRING, OCTET STRING, NULL, OID, SEQUENCE, SET, [0]..[3].
DER_TAGS = frozenset((0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3))


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the item at ``at``; None if its length doesn't fit into ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80 or data[at] == 0:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def _der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        item = _der_item(data, at, end)
        if item is None or item[0] not in DER_TAGS:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data``, with a version INTEGER and key fields whose nested lengths add up."""
    top = _der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _der_children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    for tag, a, b in parts:
        if tag in (0x30, 0x31, 0xA0, 0xA1) and _der_children(data, a, b) is None:
            return False
    if tags[0] == 0x30:  # public or encrypted key information: an algorithm, then the key bits
        inner = _der_children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and tags[1] in (0x03, 0x04)
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    return tags[1:] == [0x02] * 8 or tags[1:3] == [0x30, 0x04] or tags[1] == 0x04 or tags[1:] == [0x02] * 5


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: magic, then length-prefixed cipher, kdf and options, then a key count."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def _from_base64(s: str) -> bytes | None:
    """The bytes of base64 in the standard or the URL-safe alphabet."""
    s = s.rstrip("=").translate(STANDARD)
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _openssh_end(data: bytes) -> int | None:
    """Where an OpenSSH container ends by its own lengths: after its public keys and the private part."""
    if not is_openssh_key(data):
        return None
    at = len(OPENSSH_MAGIC)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def is_signed_token(s: str) -> bool:
    head, body, _ = s.split(".")
    try:
        parts = [json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body)]
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict)


def _key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def _is_pem_key(body: str) -> bool:
    return _key_kind(_from_base64(re.sub(r"\\n|\s", "", body))) is not None


def _text_kind(data: bytes) -> tuple[str, int, int] | None:
    """The first PEM block around a key, else signed token, that decoded bytes hold as text, and its span."""
    text = data.decode("latin-1")
    for m in PEM.finditer(text) if b"-----BEGIN" in data else ():
        if _is_pem_key(m[2]):
            return "pem", *m.span()
    for m in SIGNED.finditer(text):
        if is_signed_token(m[0]):
            return "signed", *m.span()
    return None


def _decoded_kind(data: bytes | None) -> str | None:
    """What decoded bytes are: a key encoding, or text with a PEM block around one or a signed token."""
    if data is None:
        return None
    found = _text_kind(data)
    return found[0] if found else _key_kind(data)


def _may_begin_key(data: bytes, at: int, end: int) -> bool:
    """Whether the bytes at ``at`` begin like a key encoding that ends by ``end``; looks at a few of them only."""
    if data.startswith(OPENSSH_MAGIC, at):
        return True
    top = _der_item(data, at, end)
    return top is not None and top[0] == 0x30 and (data[top[1] : top[1] + 1] == b"0" or data[top[1] : top[1] + 2] == b"\2\1")


def _key_at(data: bytes, at: int) -> tuple[str, int, int] | None:
    """A key encoding that begins at ``at``, other bytes may follow, and its span."""
    if not _may_begin_key(data, at, len(data)):
        return None
    top = _der_item(data, at, len(data))
    if top and is_der_key(data[at : top[2]]):
        return "der", at, top[2]
    end = _openssh_end(data[at:])
    return ("openssh", at, at + end) if end else None


def _place(run: str, n: int) -> int:
    """Where the ``n``-th character of an encoding ends in ``run``."""
    for p in PIECE.finditer(run):
        n -= 1
        if not n:
            return p.end()
    return len(run)


def _base64_in_lines(run: str) -> tuple[int, int, str] | None:
    """The first finding of a run of lines; it begins a line."""
    lines = [(p.start(), p[0]) for p in re.finditer(r"\S+", run)]
    for k, (start, line) in enumerate(lines):
        head = (_from_base64(line[: min(len(line), 44) & ~3]) or b"").ljust(33, b"\0")
        pem = head.startswith(b"-----BEGIN") or k == 0
        if not pem and not _may_begin_key(head, 0, len(run) + 33):
            continue
        s = "".join(x for _, x in lines[k:]).rstrip("=")
        data = _from_base64(s[: len(s) - (len(s) % 4 == 1)]) or b""
        if found := _key_at(data, 0) or (_text_kind(data) if pem else None):
            return start, start + _place(run[start:], (found[2] * 4 + 2) // 3), found[0]
        if pem and k:
            return None  # the rest has been looked through
    return None


def _hex_in_pieces(run: str) -> tuple[int, int, str] | None:
    """The first finding of a run of hex; a key begins a piece of it."""
    pieces = run.replace(":", " ").split()
    data = bytes.fromhex("".join(pieces))
    at = 0
    for p in pieces:
        if found := _key_at(data, at):
            break
        at += len(p) // 2
    else:
        found = _text_kind(data)
    return found and (_place(run, 2 * found[1] + 1) - 1, _place(run, 2 * found[2]), found[0])


def _spans_in_pieces(text: str) -> list[tuple[int, int, str]]:
    out = []
    for pattern in (BASE64_LINES, URLSAFE_LINES, HEX_PIECES):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if at - m.start() < 62:
                continue
            found = _hex_in_pieces(m[0]) if pattern is HEX_PIECES else _base64_in_lines(ESCAPED.sub("  ", m[0]))
            if found:
                start, at = m.start() + found[0], m.start() + found[1]
                while at < m.end() and text[at] == "=":
                    at += 1
                out.append((start, at, found[2]))
    return list(dict.fromkeys(out))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if _is_pem_key(m[2]):
                out.append((m.start(), m.end(), "pem"))
    pem = list(out)
    out += [(m.start(), m.end(), "signed") for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    for span in dict.fromkeys(m.span() for pattern in (BASE64, URLSAFE) for m in pattern.finditer(text)):
        if kind := _decoded_kind(_from_base64(text[slice(*span)])):
            out.append((*span, kind))
    for m in HEXKEY.finditer(text):
        s = m[0]
        if kind := _decoded_kind(bytes.fromhex(s[: len(s) & ~1])):
            out.append((m.start(), m.end(), kind))
    # what a PEM block holds is found with it; of findings of one kind inside each other the longest counts
    blocks, ends, longest = iter(pem), dict.fromkeys(KINDS, -1), []
    inside = -1
    block = next(blocks, None)
    for a, b, kind in sorted(set(_spans_in_pieces(text)).difference(out), key=lambda s: s[0]):
        while block and block[0] <= a:
            inside, block = block[1], next(blocks, None)
        if b > inside:
            out.append((a, b, kind))
    for a, b, kind in sorted(set(out), key=lambda s: (s[0], -s[1])):
        if b > ends[kind]:
            longest.append((a, b, kind))
            ends[kind] = b
    return longest


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All findings in order of start, then of kind as listed in KINDS, then of end."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], ORDER[s[2]], s[1]))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
OUT_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batch: pa.RecordBatch):
    cols = {f.name: [] for f in OUT}
    cols["doc_id"] = batch.column(0)
    for t in batch.column(1):
        spans = spans_of(t.as_py())
        base = [s for s in spans if s[2] in BASE_KINDS]
        for k in BASE_KINDS:
            cols[f"n_{k}"].append(sum(s[2] == k for s in base))
        cols["base_sha256"].append(hashlib.sha256(render(base).encode()).hexdigest())
        cols["spans"].append(render(spans))
    yield rows_of(OUT, cols)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts per base kind, a digest of the base spans, and all spans (code points, end exclusive)."""
    return key_and_text(docs, id_col, text_col).mapInArrow(per_batch(_scan), OUT_DDL)


def redact_text(text: str, mark: str) -> str:
    """``text`` with every maximal union of findings replaced by ``mark``."""
    out, at = [], 0
    end = -1
    for a, b, _ in spans_of(text):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], mark]
        at = end = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with findings in ``text_col`` replaced by ``mark``; null texts stay null, other columns are untouched."""
    at = docs.columns.index(text_col)
    cells = [F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    # one column for all: Arrow functions take no names with dots
    rows = docs.select(F.struct(*[x.alias(c) for x, c in zip(cells, docs.columns, strict=True)]).alias("row"))

    def run(batch: pa.RecordBatch):
        row = batch.column(0)
        new = row.flatten()
        new[at] = pa.array([None if t is None else redact_text(t, mark) for t in new[at].to_pylist()], new[at].type)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(new, fields=list(row.type))], schema=batch.schema)

    done = rows.mapInArrow(per_batch(run), rows.schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
