"""Secret scan with structural confirmation.

Patterns propose; structure decides. The base kinds (assignments, access ids, hex runs) are
reported by their pattern and length rules. Beyond them, base64 and hex candidates are decoded, and reported
only if what they hold parses:

- ``der``: an ASN.1 private key (PKCS#1 RSA, DSA, EC, PKCS#8, encrypted PKCS#8) whose nested
  lengths fill each other exactly; base64 and hex (in either case) may run over line ends and indents, and base64 of a
  whole PEM text is opened once more. After a key the search goes on behind it; where none parses, behind that run of characters. Public keys and certificates are no secrets.
- ``ssh``: an OpenSSH private key: magic, then length-prefixed fields that end inside the candidate.
- ``jwt``: header.payload.signature (or the five parts of an encrypted token) with a JSON header naming
  an algorithm.

Coded characters are gathered and decoded once a chain of lines (at each of the four alignments that occur), and a candidate
inside the chain is parsed in place, its declared length checked against what is left; so time is linear in the length of a text, whatever
its lines look like. A key has at most ``MAX_ITEMS`` top-level fields.

Defined results: null text counts as empty and has no findings; repeated rows come back as
given; other columns are ignored; an empty table gives no rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import id_text, map_batches, sliced

#: Kinds in their order at equal starts. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: A DER SEQUENCE starts 0x30: in base64 "M", then a letter up to "P"; "LS0t" is base64 of "---". Of a first line only.
_B64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-P]|b3Blbn|LS0t)[A-Za-z0-9+/_-]{14,}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70)(?:[0-9A-Fa-f]{2}){6,}")
_B64_RUN, _HEX_RUN, _BREAK = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+"), re.compile(r"[ \t]*(?:\r?\n|\\n)[ \t]*")
_JWT_HEAD = re.compile(r"(?<![A-Za-z0-9_.-])e[w-z0-9_-][A-Za-z0-9_-]{6,}(?=\.)")
_JWT_FORMS = (re.compile(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+){3}"), re.compile(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"))
_SSH_MAGIC = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


MAX_ITEMS = 64


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[start:end] exactly, or None; also None for more than MAX_ITEMS."""
    items = []
    while start < end:
        if start + 2 > end or len(items) == MAX_ITEMS:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at:at + n], "big"), at + n
        if at + length > end:
            return None
        items.append((tag, at, at + length))
        start = at + length
    return items


def der_length(data: bytes, at: int = 0) -> int | None:
    """Length in bytes of the SEQUENCE at ``at``, header included."""
    if len(data) < at + 6 or data[at] != SEQUENCE:
        return None
    if data[at + 1] < 0x80:
        return 2 + data[at + 1]
    n = data[at + 1] & 0x7F
    return 2 + n + int.from_bytes(data[at + 2:at + 2 + n], "big") if 1 <= n <= 4 else None


def is_private_key(data: bytes, start: int = 0, end: int | None = None) -> bool:
    """True if data[start:end] is one ASN.1 private key, all nested lengths in agreement."""
    outer = der_items(data, start, len(data) if end is None else end)
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or any(e == s for _, s, e in items[:3]):
        return False
    tags = [t for t, _, _ in items]

    def algorithm(k: int) -> bool:
        inner = der_items(data, *items[k][1:]) if tags[k] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OID

    if tags[:2] == [SEQUENCE, OCTETS] and len(items) == 2:
        return algorithm(0)  # encrypted PKCS#8
    if tags[0] != INTEGER or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 1:
        return False
    if len(items) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:
        return algorithm(1)  # PKCS#8
    if len(items) >= 2 and tags[1] == OCTETS and data[items[0][1]] == 1:
        return all(t in (0xA0, 0xA1) for t in tags[2:])  # EC
    return set(tags[:6]) == {INTEGER} and (len(items) == 6 or len(items) >= 9 and set(tags[:9]) == {INTEGER})  # DSA, RSA


def ssh_key_length(data: bytes, start: int = 0) -> int | None:
    """Length of the OpenSSH private key at ``start``, if all its fields lie inside ``data``."""
    if not data.startswith(_SSH_MAGIC, start):
        return None
    at = start + len(_SSH_MAGIC)

    def skip(at: int) -> int | None:
        if at is None or at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):  # cipher, kdf, kdf options
        at = skip(at)
    if at is None or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):  # public keys, private part
        at = skip(at)
    return None if at is None else at - start


def _b64(chars: str) -> bytes:
    chars = chars.rstrip("=").replace("-", "+").replace("_", "/")
    chars = chars[:len(chars) - (len(chars) % 4 == 1)]
    try:
        return base64.b64decode(chars + "=" * (-len(chars) % 4))
    except (binascii.Error, ValueError):
        return b""


def _key_in(data: bytes, at: int) -> tuple[str, int] | None:
    """Kind and length of the private key at ``at``."""
    n = der_length(data, at)
    if n is not None and at + n <= len(data) and is_private_key(data, at, at + n):
        return "der", n
    n = ssh_key_length(data, at)
    return ("ssh", n) if n is not None else None


class _Chain:
    """Runs of coded characters over line ends and indents, from ``start`` on, and what they decode to.

    ``group`` characters stand for ``group * bits / 8`` bytes: 4 of base64 for 3, 2 of hex for 1.
    """

    def __init__(self, text: str, start: int, run: re.Pattern, decode, group: int, size: int):
        self.runs, self.before, parts, total, at = [], [], [], 0, start
        while m := run.match(text, at):
            self.runs.append(m.start())
            self.before.append(total)
            parts.append(m.group(0))
            total += len(parts[-1])
            self.end = m.end()
            gap = _BREAK.match(text, self.end)
            if not gap:
                break
            at = gap.end()
        self.text, self.chars, self.decode, self.group, self.size, self.data, self.inner = text, "".join(parts), decode, group, size, {}, {}

    def offset(self, at: int) -> int | None:
        """Coded characters before the text's place ``at``; None if it is not in a run."""
        k = bisect.bisect_right(self.runs, at) - 1
        if k < 0:
            return None
        end = self.before[k + 1] if k + 1 < len(self.runs) else len(self.chars)
        n = self.before[k] + at - self.runs[k]
        return n if n < end else None

    def bytes_at(self, offset: int) -> tuple[bytes, int]:
        """What the chain decodes to in the alignment of a coded offset, and the place of the offset in it."""
        shift = offset % self.group
        if shift not in self.data:
            self.data[shift] = self.decode(self.chars[shift:])
        return self.data[shift], (offset - shift) // self.group * self.size

    def end_of(self, offset: int, n_bytes: int) -> int:
        """Where in the text the key of ``n_bytes`` from a coded offset ends, padding included."""
        last = offset + -(-n_bytes * self.group // self.size) - 1
        k = bisect.bisect_right(self.before, last) - 1
        at = self.runs[k] + last - self.before[k] + 1
        while self.text[at:at + 1] == "=":
            at += 1
        return at

    def keys_inside(self, offset: int) -> str | None:
        """Kind of the first key in the texts that follow from a coded offset, which are decoded once more."""
        data, place = self.bytes_at(offset)
        shift = offset % self.group
        if shift not in self.inner:
            self.inner[shift] = sorted((s, k) for k, s, _ in _candidates(data.decode("latin-1")))
        k = bisect.bisect_left(self.inner[shift], (place, ""))
        return self.inner[shift][k][1] if k < len(self.inner[shift]) else None


def _unhex(digits: str) -> bytes:
    return bytes.fromhex(digits[:len(digits) // 2 * 2])


def _in_chains(text: str, first: re.Pattern, run: re.Pattern, decode, group: int, size: int):
    """(kind, start, end) of the keys at the places where ``first`` matches."""
    at, chain = 0, None
    while m := first.search(text, at):
        start, at = m.start(), m.end()  # without a key here the search goes on behind this line's run
        if chain is None or (offset := chain.offset(start)) is None:
            chain, offset = _Chain(text, start, run, decode, group, size), 0
        data, place = chain.bytes_at(offset)
        if found := _key_in(data, place):
            at = chain.end_of(offset, found[1])
            yield found[0], start, at
        elif data.startswith(b"-----BEGIN ", place):  # a PEM text, encoded once more
            if kind := chain.keys_inside(offset):
                at = chain.end
                while text[at:at + 1] == "=":
                    at += 1
                yield kind, start, at


def _candidates(text: str):
    yield from _in_chains(text, _B64, _B64_RUN, _b64, 4, 3)
    yield from _in_chains(text, _HEX_ANY, _HEX_RUN, _unhex, 2, 1)


def _is_token(parts: list[str]) -> bool:
    try:
        header = json.loads(_b64(parts[0]))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str) and all(parts[2:])
        if len(parts) != 3 or not parts[1]:
            return False
        return (bool(parts[2]) or header["alg"].lower() == "none") and isinstance(json.loads(_b64(parts[1])), dict)
    except (ValueError, RecursionError):
        return False


def _tokens(text: str):
    for head in _JWT_HEAD.finditer(text):
        for form in _JWT_FORMS:  # five parts, else three
            m = form.match(text, head.start())
            if m and _is_token(m.group(0).split(".")):
                yield "jwt", m.start(), m.end()
                break


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of one whole text, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += _candidates(text)
    if "." in text:
        found += _tokens(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings array<struct<kind, start, end>>) for each row; findings by start, then kind."""
    rows = id_text(df, id_col, text_col)

    def apply(c):
        return {"id": c["id"], "findings": [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in c["text"]]}

    return map_batches(rows, lambda: apply, f"id {rows.schema['id'].dataType.simpleString()}, "
                       "findings array<struct<kind:string,start:long,end:long>>")


def digest(findings, kinds=KINDS):
    """``kind:start:end`` of the findings of the given kinds, comma-joined."""
    chosen = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by findings replaced by one mark."""
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with its secrets replaced; null texts stay null, all other columns and rows as they are."""
    @F.arrow_udf("string")
    def clean(texts):
        return pa.array([None if t is None else redacted(t, mark) for part in sliced(texts) for t in part], pa.string())

    return df.withColumn(text_col, clean(F.col(f"`{text_col}`")))
