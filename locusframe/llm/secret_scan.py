"""Secret scans with structural confirmation.

Three base kinds are found by their spelling. Every longer run of base64 or hex characters is
decoded as well, and reported only if its bytes have the structure of a secret: a DER key
whose nested lengths fit, an OpenSSH key whose length-prefixed fields fit, or a signed token
whose header names an algorithm. A run goes on over line breaks, real or escaped, and a key may
start anywhere in it. Base64 of a PEM file is decoded and searched like a text.
"""

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches

# Kinds in the order that sorts spans of one start.
KINDS = ["assign", "access", "hex", "token", "pem", "openssh", "der"]
BASE = ("assign", "access", "hex")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# A run of 24 or more is the whole maximal run of these characters.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
# A line break, real or escaped (also more than once), and the indent after it.
_BREAK = r"(?:\r?\n|\\++(?:r\\++)?n)[ \t]*+"
PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,]|\\++[nrt/]|-(?!----))*+)-----END \1-----"
)
_ESCAPE = re.compile(r"\\+([nrt/])")
# The first line of a run has 16 characters or more; a key has at least 48 bytes.
ENCODED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}")
HEXES = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{16,}}+(?:{_BREAK}[0-9A-Fa-f]++)*+")
LEAST = 32
_BREAKS = re.compile(_BREAK)
# Where a key can start: a DER sequence, an OpenSSH key, or "-----BEGIN " at each of three offsets.
DER_START = re.compile(r"(?=M[A-H]|MI[G-P])")
DER_HEAD = re.compile(
    rb"\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....)(?:\x02\x01|\x30(?:[\x00-\x7f]|\x81.|\x82..)\x06)", re.DOTALL
)
HEX_START = re.compile(
    r"(?=30(?:[0-7].|81..|82.{4}|83.{6}|84.{8})(?:0201|30(?:[0-7].|81..|82.{4})06)|6f70656e7373682d6b65792d763100)"
)
OPENSSH_MAGIC = b"openssh-key-v1\0"
OPENSSH_START = base64.b64encode(OPENSSH_MAGIC).decode()
# The characters that a PEM heading fixes, and how many bytes of its group are before it.
PEM_STARTS = [
    (base64.b64encode(b"\0" * k + b"-----BEGIN ").decode()[-(-8 * k // 6) : (k + 11) * 8 // 6], -(-8 * k // 6))
    for k in range(3)
]
# Object identifiers of key algorithms: RSA, EC, DSA, X25519, X448, Ed25519, Ed448.
KEY_OIDS = {
    bytes.fromhex(x)
    for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b656e", "2b656f", "2b6570", "2b6571")
}


def _item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """`(tag, start, end)` of the DER value at `at`, if its length fits."""
    if at + 2 > end:
        return None
    tag, length, start = data[at], data[at + 1], at + 2
    if length & 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or start + size > end:
            return None
        length = int.from_bytes(data[start : start + size], "big")
        if length < 0x80 or data[start] == 0:
            return None
        start += size
    return (tag, start, start + length) if start + length <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill `start` to `end` exactly."""
    out = []
    while start < end:
        item = _item(data, start, end)
        if item is None:
            return None
        out.append(item)
        start = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """Whether `data` begins with a DER private key whose nested lengths all fit."""
    whole = _item(data, 0, len(data))
    if whole is None or whole[0] != 0x30:
        return False
    parts = _children(data, whole[1], whole[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    if tags[0] == 0x30 and len(parts) >= 2 and tags[1] == 0x04:
        # Encrypted: an algorithm with its parameters, then the data.
        inner = _children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and len(parts) == 2
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    if tags[1] == 0x30 and len(parts) > 2 and tags[2] == 0x04:
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in KEY_OIDS
    if all(tag == 0x02 for tag in tags) and len(tags) in (6, 9):
        return parts[1][2] - parts[1][1] >= 16
    return tags[1] == 0x04 and 16 <= parts[1][2] - parts[1][1] <= 66 and len(tags) > 2


def is_openssh_key(data: bytes) -> bool:
    """Whether `data` is an OpenSSH private key whose length-prefixed fields fit."""
    if data[: len(OPENSSH_MAGIC)] != OPENSSH_MAGIC:
        return False
    at = len(OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys)) and field() is not None


def is_signed_token(text: str) -> bool:
    """Whether `text` is a signed token: a JSON header with an algorithm, then JSON claims."""
    head, claims, _ = text.split(".")
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        body = base64.urlsafe_b64decode(claims + "=" * (-len(claims) % 4))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and bool(body)


def _decoded(text: str) -> bytes | None:
    """The bytes of a base64 text in either alphabet."""
    text = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(text) % 4 == 1:
        text = text[:-1]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield m.start(), m.end(), "assign"
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 20:
            yield m.start(), m.end(), "access"
    for m in LONG_HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of decoded candidates whose structure was confirmed."""
    for m in TOKEN.finditer(text):
        if is_signed_token(m[0]):
            yield m.start(), m.end(), "token"
    inside = list(pem_spans(text))
    yield from ((start, end, "pem") for start, end in inside)
    free = lambda start, end: not any(a <= start and end <= b for a, b in inside)
    for pattern, search in ((ENCODED, _encoded_keys), (HEXES, _hex_keys)):
        for m in pattern.finditer(text):
            run = m[0]
            if len(run) < LEAST:
                continue
            # The run without its breaks, and for its pieces their places there and in the text.
            pieces, places, at, size = [], [], 0, 0
            for gap in [*_BREAKS.finditer(run), None] if "\n" in run or "\\" in run else [None]:
                piece = run[at : gap.start() if gap else len(run)]
                pieces.append(piece)
                places.append((size, m.start() + at))
                size += len(piece)
                at = gap.end() if gap else at
            here = lambda i: (p := places[bisect_right(places, (i, len(text))) - 1])[1] + i - p[0]
            reached = 0
            for start, end, kind in search("".join(pieces)):
                if start >= reached and free(here(start), here(end - 1) + 1):
                    reached = end
                    yield here(start), here(end - 1) + 1, kind


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of confirmed PEM blocks."""
    if "PRIVATE KEY-----" not in text:
        return
    for m in PEM.finditer(text):
        body = _ESCAPE.sub(lambda e: "/" if e[1] == "/" else "\n", m[2])
        lines = [line for line in body.split("\n") if ":" not in line]
        data = _decoded("".join("".join(lines).split()))
        # A key with a cipher header is encrypted: only its length can be checked.
        sealed = "Proc-Type:" in m[2] and data and len(data) % 8 == 0
        if data and (sealed or is_der_key(data) or is_openssh_key(data)):
            yield m.span()


def _encoded_keys(run: str) -> Iterator[tuple[int, int, str]]:
    """Keys that start anywhere in a base64 run without breaks, in order of start."""
    starts = {m.start(): "der" for m in DER_START.finditer(run)}
    starts.update((m.start(), "openssh") for m in re.finditer(OPENSSH_START, run))
    for needle, before in PEM_STARTS:
        starts.update((m.start() - before, "pem") for m in re.finditer(re.escape(needle), run) if m.start() >= before)
    phases: dict[int, bytes] = {}
    done = 0
    for start, kind in sorted(starts.items()):
        if start < done:
            continue
        if kind == "der" and not DER_HEAD.match(_decoded(run[start : start + 16]) or b""):
            continue
        # The run is decoded once for each place in a group of four characters.
        phase = start % 4
        if phase not in phases:
            phases[phase] = _decoded(run[phase:]) or b""
        data = memoryview(phases[phase])[(start - phase) // 4 * 3 :]
        end = None
        if kind == "der" and is_der_key(data):
            end = start + -(-_item(data, 0, len(data))[2] // 3) * 4
        elif kind == "openssh" and is_openssh_key(data):
            end = len(run)
        elif kind == "pem":
            for _, last in pem_spans(bytes(data).decode("latin-1")):
                end = start + -(-last // 3) * 4
        if end is not None:
            done = min(end, len(run))
            yield start, done, kind


def _hex_keys(run: str) -> Iterator[tuple[int, int, str]]:
    """Keys that start anywhere in a hex run without breaks, in order of start."""
    run = run.lower()
    phases: dict[int, bytes] = {}
    for m in HEX_START.finditer(run):
        start = m.start()
        phase = start % 2
        if phase not in phases:
            phases[phase] = bytes.fromhex(run[phase : len(run) - (len(run) - phase) % 2])
        data = memoryview(phases[phase])[(start - phase) // 2 :]
        if is_openssh_key(data):
            yield start, len(run), "openssh"
        elif is_der_key(data):
            yield start, start + 2 * _item(data, 0, len(data))[2], "der"


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text as `(start, end, kind)`, in order of start, then kind."""
    text = text or ""
    found = [*base_spans(text), *confirmed_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


SPAN = "array<struct<start:bigint,end:bigint,kind:string,secret:string>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row `(id, spans, base_text)` per document.

    `spans` has code point offsets, the kind and the secret itself; `base_text` lists the spans
    of the base kinds as `kind:start:end`, comma-joined. A NULL text is empty. Rows are scanned
    one by one, so NULL and repeated ids stay.
    """
    kind = dict(docs.dtypes)[id_column]
    cell = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string())])

    def run(batches):
        for batch in batches:
            all_spans, bases = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = spans(text)
                all_spans.append(
                    [{"start": a, "end": b, "kind": k, "secret": text[a:b]} for a, b, k in found]
                )
                bases.append(joined([s for s in found if s[2] in BASE]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_spans, pa.list_(cell)), pa.array(bases, pa.string())],
                names=["id", "spans", "base_text"],
            )

    rows = bounded_batches(docs).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"id {kind}, spans {SPAN}, base_text string")


def digest(text: str) -> str:
    """The digest that the base spans of a document are compared by."""
    return hashlib.sha256(text.encode()).hexdigest()
