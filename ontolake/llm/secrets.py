"""Secret scans: an Aho-Corasick pass finds keywords, anchored expressions run only at those places, and tokens with an
embedded checksum must pass it.

The three base kinds follow a fixed contract and are never dropped: `assign` (a named value of eight or more
characters), `access` (an access key id) and `hex` (32 or more hex digits). The other kinds are this method's own.

Defined results for odd input: a null text counts as empty; a row without an id keeps its null id; repeated rows are
scanned each by itself; other columns, whatever their names, are carried by `redact` and ignored by `scan`; an empty
table gives an empty result. Cost is linear in the text, of any length; no kind has an upper end to its length. A private key
goes to the end mark that follows it, whatever its body holds; one without an end mark before the next key takes the lines of
header fields and base-64 that follow it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points

#: Order among spans that start at the same place.
KINDS = ("assign", "access", "hex", "forge", "registry", "payment", "chat", "cloudkey", "jwt", "pem", "urlauth", "wallet", "agekey", "notekey")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_HEX_CLASS = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = b"h" * 32

_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of body as six base-62 digits, as token formats with a checksum append it."""
    n, out = zlib.crc32(body), b""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r : r + 1] + out
    return out.rjust(6, b"0")


def _crc_ok(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def jwt_header(raw: bytes, at: int, end: int) -> bool:
    """Is raw[at:end] base64 of a JSON object that names its algorithm. What is none shows in its first bytes, as a rule, so
    that the whole is read only if these could be the beginning of one."""
    for stop in (min(end, at + 1024), end):
        part = raw[at:stop]
        try:
            text = base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)).decode()
            found = json.JSONDecoder().raw_decode(text)
        except json.JSONDecodeError as e:
            if stop == end or e.pos < len(text) - 8 and "Unterminated" not in e.msg:
                return False
        except ValueError:
            return False
        else:
            return stop == end and found[1] == len(text) and "alg" in found[0]
    return False


def _any(_: re.Match) -> bool:
    return True


#: The alphabets of base-58 and bech32 texts, and the generator of bech32's checksum.
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _base58_ok(m: re.Match) -> bool:
    """The last four bytes are the first of the rest's double SHA-256. A key has 111 digits."""
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(-(-n.bit_length() // 8), "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _bech32_ok(m: re.Match) -> bool:
    """The polynomial checksum over the part before the last 1 and the data after it."""
    human, _, data = m[0].lower().rpartition(b"1")
    if m[0] not in (m[0].lower(), m[0].upper()):
        return False
    chk = 1
    for v in [*(c >> 5 for c in human), 0, *(c & 31 for c in human), *(_BECH32.index(c) for c in data)]:
        top, chk = chk >> 25, (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_GENERATOR):
            chk ^= g if top >> i & 1 else 0
    return chk == 1


_BECH32_CLASS = "[%s]" % _BECH32.decode()

#: kind, keyword as lower-case text, expression anchored at the keyword, check of the match. No upper ends: a run that goes on
#: is one secret. Runs are possessive, so that each is read once.
RULES = (
    *(("forge", f"{p}_", re.compile(rb"%s_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])" % p.encode()), _crc_ok) for p in ("ghp", "gho", "ghu", "ghs", "ghr")),
    ("registry", "npm_", re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_ok),
    ("payment", "sk_live_", re.compile(rb"sk_live_[0-9A-Za-z]{24,}+"), _any),
    ("payment", "rk_live_", re.compile(rb"rk_live_[0-9A-Za-z]{24,}+"), _any),
    *(("chat", f"xox{c}-", re.compile(rb"xox%s-[0-9]{10,}+-[0-9A-Za-z-]{10,}+" % c.encode()), _any) for c in "abprs"),
    ("cloudkey", "aiza", re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _any),
    ("jwt", "eyj", re.compile(rb"(eyJ[A-Za-z0-9_-]{10,}+)(\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{16,}+)?"), _any),
    ("pem", "-----begin ", re.compile(rb"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----"), _any),
    ("urlauth", "://", re.compile(rb"://[A-Za-z0-9._~%+-]++:[^\s:@/]{3,}+@[A-Za-z0-9.-]++"), _any),
    *(("wallet", f"{p}prv", re.compile(rb"[%s]prv[%s]{107}(?![%s])" % (p.encode(), _BASE58, _BASE58)), _base58_ok) for p in "xyzt"),
    ("agekey", "age-secret-key-1", re.compile(rb"(?i:age-secret-key-1%s{58})(?![0-9A-Za-z])" % _BECH32_CLASS.encode()), _bech32_ok),
    ("notekey", "nsec1", re.compile(rb"(?i:nsec1%s{58})(?![0-9A-Za-z])" % _BECH32_CLASS.encode()), _bech32_ok),
)

#: The mark that ends a private key, and what a key without one is taken to be: its lines of header fields and base-64.
_PEM_MARK = re.compile(rb"-----(BEGIN|END) (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----")
_PEM_LINES = re.compile(rb"(?:[\s\\]++(?:[A-Za-z-]++:\x20[^\r\n]*+|[A-Za-z0-9+/=]{16,}+))*+")


class KeyEnds:
    """Where the private keys of one text end, each found by one pass over all marks."""

    def __init__(self, raw: bytes) -> None:
        marks = [(m.start(), m.end(), m[1]) for m in _PEM_MARK.finditer(raw)]
        self.ends = {a: (n[1] if n and n[2] == b"END" else _PEM_LINES.match(raw, b).end()) for (a, b, kind), n in zip(marks, [*marks[1:], None]) if kind == b"BEGIN"}


def _automaton():
    import ahocorasick

    found: dict[str, list] = {}
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        found.setdefault(word, []).append(("assign", _ASSIGN, lambda m: len(m[2]) >= 8))
    found.setdefault("akia", []).append(("access", _ACCESS, lambda m: len(m[0]) >= 16))
    for kind, word, rx, check in RULES:
        found.setdefault(word, []).append((kind, rx, check))
    out = ahocorasick.Automaton()
    for word, rules in found.items():
        out.add_word(word, (len(word) - 1, rules))
    out.make_automaton()
    return out


class Scanner:
    """Finds the spans of one text after another; built once in each Python worker."""

    def __init__(self) -> None:
        self.hits = _automaton()
        self.order = {k: i for i, k in enumerate(KINDS)}

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        raw = text.encode("utf-8", "surrogatepass")
        found: list[tuple[int, int, int, str]] = []
        ends: dict[str, int] = {}
        keys, head, tail = None, 0, 0
        for last, (back, rules) in self.hits.iter(raw.lower().decode("latin-1")):
            at = last - back
            for kind, rx, check in rules:
                if at < ends.get(kind, 0):  # inside the kind's match before it: matches are leftmost and do not overlap
                    continue
                if kind == "jwt" and at < head:  # inside a run that was read before
                    end = tail if tail > head and head - at > 12 and jwt_header(raw, at, head) else 0
                else:
                    m = rx.match(raw, at)
                    if not m:
                        continue
                    if kind in ("assign", "access"):  # a base match that fails its length is spent all the same
                        ends[kind] = m.end()
                    end = m.end() if check(m) else 0
                    if kind == "jwt":
                        head, tail = m.end(1), m.end()
                        end = end if tail > head and jwt_header(raw, at, head) else 0
                    elif kind == "pem":
                        keys = keys or KeyEnds(raw)
                        end = keys.ends.get(at, end)
                if end:
                    ends[kind] = end
                    found.append((at, self.order[kind], end, kind))
        if _HEX_RUN in raw.translate(_HEX_CLASS):
            found += [(m.start(), self.order["hex"], m.end(), "hex") for m in _HEX.finditer(raw)]
        found.sort()
        if len(raw) == len(text):
            return [(kind, a, b) for a, _, b, kind in found]
        place = code_points(raw, (y for a, _, b, _ in found for y in (a, b)))
        return [(kind, place[a], place[b]) for a, _, b, kind in found]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scanner()
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, of)], names=[*batch.schema.names[:-1], "spans"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: its id and `spans`, all found, by start and kind; offsets in code points, end exclusive.
    A map over the rows, without a shuffle."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(_batches, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """df with every span in the text replaced by a mark; overlapping spans become one mark. Texts without a secret, nulls
    included, come back as they are, and so do all other columns."""
    schema, place = df.schema, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                parts, at = [], 0
                for _, a, b in sorted(scan(text), key=lambda s: s[1:]) if text else ():
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if parts else text)
            columns = list(batch.columns)
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def op4_secret_scan(documents: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their places, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(documents).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(spans).alias("spans"))
