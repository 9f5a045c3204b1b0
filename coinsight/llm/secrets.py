"""Secret scan with recursive decoding.

A worklist starts with the whole text. Each layer is scanned for secrets, and
each encoded run in it (percent escapes, Unicode escapes, base64, and gzip,
zlib or deflate data in any of them) gives further layers, until no new layer
appears. Layers seen before are not taken again, so data that decodes to itself
ends too. Every character of a layer knows the stretch of the original text it
comes from; findings are reported as those stretches.

Base64 is tried in both alphabets, across line breaks and at all four
alignments, as letters or a path may stand glued before it. Compressed data is
unfolded to its end, member after member, in overlapping pieces of bounded
size, so memory does not follow what it unfolds to. Only an encoded run inside
that is longer than the overlap may be cut.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame

from . import shared

KINDS = ("assign", "access", "hex")
# Keywords in either case, spelled out so that no other letters fold to them.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as shorter ones are dropped
HINTS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});")
RUN = re.compile(r"\S+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
BREAK = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
PADDING = re.compile("={0,2}")
STANDARD = str.maketrans("-_", "+/")
BYTE = re.compile(rb"\\x([0-9A-Fa-f]{2})")
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]*")
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{8,}")  # the shortest secret is longer
#: Where gzip or zlib data may begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
PIECE, OVERLAP = 1 << 24, 1 << 20  # bytes of unfolded data looked at together

Span = tuple[int, int, int]  # start, index in KINDS, end


def scan(text: str) -> list[Span]:
    """Secrets that stand openly in a text, in order of start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _unescape(m: re.Match) -> str:
    s = m[0]
    if s.startswith("&#"):
        code = int(s[3:-1], 16) if s[2] == "x" else int(s[2:-1])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if s.startswith("\\x"):
        return bytes.fromhex(s.replace("\\x", "")).decode("utf-8", "replace")
    return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")


def _unquote(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _unfolded(data: bytes | memoryview, bits: int) -> Iterator[bytes]:
    """Contents of compressed members in a row, in overlapping pieces.

    Data that breaks off or turns bad gives what comes before that.
    """
    held = b""
    while len(data):
        work = zlib.decompressobj(bits)
        try:
            while not work.eof:
                out = work.decompress(data, PIECE)
                data = work.unconsumed_tail
                held += out
                if len(held) > PIECE:
                    yield held
                    held = held[-OVERLAP:]
                if not out and not data:
                    break
        except zlib.error:
            break
        data = work.unused_data.lstrip(b"\0")
        if not MAGIC.match(data):
            break
    if held:
        yield held


def _streams(data: bytes) -> Iterator[bytes]:
    """What compressed data in some bytes unfolds to."""
    found = False
    for m in MAGIC.finditer(data):
        for piece in _unfolded(memoryview(data)[m.start() :], 47):
            found = True
            yield piece
    if not found and not PLAIN.fullmatch(data):
        work = zlib.decompressobj(-15)
        with contextlib.suppress(zlib.error):
            # Any bytes may begin like bare deflate data; its end must be there.
            if PLAIN.fullmatch(work.decompress(data, 1 << 12)) and (work.eof or work.unconsumed_tail):
                yield from _unfolded(data, -15)


def _inside(data: bytes) -> Iterator[str]:
    """Texts in some bytes and in what they unfold to, to any depth."""
    seen, work = set(), [iter([data])]
    while work:
        if (piece := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := hashlib.sha256(piece).digest()) in seen:
            continue
        seen.add(key)
        whole = None
        if PLAIN.fullmatch(piece):
            with contextlib.suppress(UnicodeDecodeError):
                whole = piece.decode()
        if whole is not None:
            yield whole
        else:
            yield from (m[0].decode() for m in STRETCH.finditer(piece))
        work.append(_streams(piece))


def _from_base64(run: str) -> Iterator[str]:
    """Texts in a base64 run, wherever in it the base64 begins."""
    body = run.translate(STANDARD)
    for at in range(4):
        part = body[at:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        yield from _inside(base64.b64decode(part + "=" * (-len(part) % 4)))


def _base64_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 in a text without line breaks and padding, and where it stands.

    Lines of one length and a last shorter one are joined. As that one may be a
    word of the text that follows, the lines before it are a run as well.
    """
    done = 0
    for m in BASE64.finditer(text):
        if m.start() >= done:
            lines, end = [m[0]], m.end()
            while (more := BREAK.match(text, end)) and len(more[1]) <= len(m[0]):
                if len(more[1]) < len(m[0]) and len(lines) > 1:
                    yield "".join(lines), m.start(), end
                lines.append(more[1])
                end = done = more.end()
                if len(more[1]) < len(m[0]):
                    break
            if len(lines) > 1:
                yield "".join(lines), m.start(), PADDING.match(text, end).end()
        yield m[0], m.start(), PADDING.match(text, m.end()).end()


Layer = tuple[str, list[tuple[int, int]] | tuple[int, int] | None]


def _origin(places, start: int, end: int) -> tuple[int, int]:
    """Where characters start..end of a layer stand in the original text."""
    if places is None:
        return start, end
    if isinstance(places, tuple):
        return places
    return places[start][0], places[end - 1][1]


def _replaced(pattern: re.Pattern, change, run: str, at: int, places) -> Layer:
    """A run with its escapes undone; other characters keep their places."""
    text, where, last = [], [], 0
    for m in pattern.finditer(run):
        for k in range(last, m.start()):
            text.append(run[k])
            where.append(_origin(places, at + k, at + k + 1))
        new = change(m)
        text.append(new)
        where += [_origin(places, at + m.start(), at + m.end())] * len(new)
        last = m.end()
    for k in range(last, len(run)):
        text.append(run[k])
        where.append(_origin(places, at + k, at + k + 1))
    return "".join(text), where


def _layers(text: str, places) -> Iterator[Layer]:
    """The layers directly inside a layer.

    Escapes of each way of writing are undone in the whole layer, as a value
    may stand behind a space from its keyword, and in each run by itself, as
    another keyword before the run would take its keyword for a value.
    """
    for sign, pattern, change in (("%", PERCENT, _unquote), ("\\", ESCAPE, _unescape), ("&#", ESCAPE, _unescape)):
        if sign in text and pattern.search(text):
            yield _replaced(pattern, change, text, 0, places)
            done = -1
            for m in pattern.finditer(text):
                if m.start() < done:
                    continue
                start = m.start()
                while start > 0 and not text[start - 1].isspace():
                    start -= 1
                run = RUN.match(text, start)
                done = run.end()
                yield _replaced(pattern, change, run[0], start, places)
                if sign != "&#":
                    raw = unquote_to_bytes(run[0]) if sign == "%" else BYTE.sub(lambda x: bytes.fromhex(x[1].decode()), run[0].encode("utf-8", "surrogatepass"))
                    if not PLAIN.fullmatch(raw):
                        where = _origin(places, start, done)
                        yield from ((x, where) for piece in _streams(raw) for x in _inside(piece))
    for run, start, end in _base64_runs(text):
        where = _origin(places, start, end)
        yield from ((x, where) for x in _from_base64(run))


def scan_deep(text: str | None) -> tuple[list[Span], list[Span]]:
    """Open secrets, and all secrets with those inside encoded runs."""
    text = text or ""
    base = scan(text)
    found, seen, work = set(base), set(), [_layers(text, None)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, places = layer
        key = (hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), _origin(places, 0, len(layer)) if layer else None)
        if not layer or key in seen or layer == text:
            continue
        seen.add(key)
        for start, kind, end in scan(layer):
            a, b = _origin(places, start, end)
            found.add((a, kind, b))
        work.append(_layers(layer, places))
    return base, sorted(found)


def spans_text(spans: list[Span]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every found stretch replaced by a mark; None stays None."""
    if not text:
        return text
    out, at = [], 0
    _, spans = scan_deep(text)
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """Counts per kind, digest of open secrets and all spans of each document.

    One row per input row, repeated rows too. Null texts count as empty and
    have no spans; long texts are scanned whole. Spans that start together are
    in the order of KINDS, then of their ends. Columns other than doc_id and
    text are not read, whatever their names; an empty table gives no rows.
    """

    def make():
        def batch(doc_ids, texts):
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                base, spans = scan_deep(text)
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans)))
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6

        return batch

    return shared.map_rows(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with found secrets replaced in ``text`` and ``n_chars`` renewed."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    @F.arrow_udf(StringType())
    def clean(texts):
        import pyarrow as pa

        return pa.array([redact(t) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
