"""Secret scans through nested encodings, by a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs that may hide a further layer.
URL_RUN = re.compile(r"(?:[A-Za-z0-9_.~+/=:&?-]|%[0-9A-Fa-f]{2})++")
ESCAPE_RUN = re.compile(r"(?:[!-\[\]-~]|\\u[0-9A-Fa-f]{4})++")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
#: A base64 run and the whole or last lines that carry it on.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
#: What of the text beside a run a pattern can take up, read away from the run on either side.
#: Bytes of expanded data that are scanned together, and those that two such windows share.
WINDOW, OVERLAP = 1 << 24, 1 << 16
VALUE, QUOTE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), frozenset("\"'")
BESIDE = (VALUE, False), (QUOTE, True), (frozenset(" "), False), (frozenset(":="), True), (frozenset(" "), False), (QUOTE, True), (VALUE, False)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets that stand in the text itself, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _compressed(data: bytes) -> int:
    """The window bits of a gzip or zlib head, 0 without one."""
    if data[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0 else 0


def _unwrapped(data: bytes) -> Iterator[bytes]:
    """The data itself, or what it was compressed from, nested and in several members too.

    What is larger than WINDOW comes in windows that overlap, so that no memory follows the expansion.
    What a broken stream gave before it broke is kept.
    """
    if not _compressed(data):
        yield data
        return
    held, first = b"", True
    while data and (bits := _compressed(data)):
        stream = zlib.decompressobj(bits)
        try:
            while not stream.eof and (data or held):
                more = stream.decompress(data, WINDOW)
                data = stream.unconsumed_tail
                held += more
                if len(held) > WINDOW:
                    yield held
                    held, first = held[-OVERLAP:], False
                if not more and not data:
                    break
        except zlib.error:
            break
        data = stream.unused_data
    if held:
        yield from _unwrapped(held) if first else (held,)


def _base64(run: str) -> Iterator[str]:
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return
    try:
        data = base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return
    for some in _unwrapped(data):
        try:
            yield some.decode()
        except UnicodeDecodeError:
            yield some.decode("latin-1")


def _unescape(run: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), run)


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded) of base64 wrapped over single line breaks.

    Wrapped lines are equally long, but for the first, which may begin within a line, and the last.
    Each stretch of equal lines is decoded with and without the line before and the one after.
    """
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m.group())]
        width = [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and width[j + 1] == width[i]:
                j += 1
            for first in {max(0, i - 1), i}:
                for last in {j, min(len(lines) - 1, j + 1)}:
                    if first < last:
                        a, b = lines[first][0], m.end() if last == len(lines) - 1 else lines[last][1]
                        for inner in _base64(text[a:b]):
                            yield a, b, inner
            i = j + 1


def _layers(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded) of every run of the text that decodes to something else."""
    for a, b, inner in _marked(text, URL_RUN, "%", unquote):
        yield a, b, inner
    for a, b, inner in _marked(text, ESCAPE_RUN, "\\u", _unescape):
        yield a, b, inner
    for m in BASE64_RUN.finditer(text):
        for inner in _base64(m.group()):
            if inner and inner != m.group():
                yield m.start(), m.end(), inner


def _marked(text: str, run: re.Pattern, mark: str, decode) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the runs that hold the mark; each character is looked at once."""
    if mark not in text:
        return []
    found = [(m.start(), m.end(), decode(m.group())) for m in run.finditer(text) if mark in m.group()]
    return [r for r in found if r[2] != text[r[0] : r[1]]]


class Layer:
    """A text with, per segment, its start and the (start, end, literal) of the source it stands for."""

    def __init__(self, text: str, segments: list[tuple[int, tuple[int, int, bool]]]):
        self.text, self.segments = text, segments
        self.at = [a for a, _ in segments]

    def span(self, a: int, b: int) -> tuple[int, int, bool]:
        """The source span of a..b, and whether it touches a decoded segment. Those count whole."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        first, last = self.segments[i][1], self.segments[j][1]
        start = first[0] + a - self.at[i] if first[2] else first[0]
        end = last[0] + b - self.at[j] if last[2] else last[1]
        return start, end, any(not s[2] for _, s in self.segments[i : j + 1])

    def replaced(self, runs: list[tuple[int, int, str]], lo: int, hi: int) -> Layer:
        """lo..hi of the layer with each run's decoded text in its place."""
        out, segments, size, at = [], [], 0, lo
        for a, b, inner in [*runs, (hi, hi, "")]:
            i = bisect_right(self.at, at) - 1
            while at < a:
                stop = min(a, self.at[i + 1] if i + 1 < len(self.at) else a)
                s = self.segments[i][1]
                segments.append((size, (s[0] + at - self.at[i], s[0] + stop - self.at[i], True) if s[2] else s))
                out.append(self.text[at:stop])
                size, at, i = size + stop - at, stop, i + 1
            if inner:
                segments.append((size, (*self.span(a, b)[:2], False)))
                out.append(inner)
                size += len(inner)
            at = b
        return Layer("".join(out), segments)


def _beside(text: str, at: int, step: int) -> int:
    """The position up to which a pattern that crosses `at` can reach, going by step."""
    k = at if step > 0 else at - 1
    for chars, once in BESIDE:
        while 0 <= k < len(text) and text[k] in chars:
            k += step
            if once:
                break
    return k if step > 0 else k + 1


def _children(layer: Layer, whole: bool) -> Iterator[tuple[Layer, bool]]:
    """(layer, whole) one decoding further in: each run by itself and in its place in the text.

    Percent and \\u runs are also put back all at once, as key and value may lie in different runs.
    Of a layer that is no whole text, only runs that touch what was decoded are taken.
    """
    text = layer.text
    runs = [*_layers(text), *_wrapped(text)]
    if not whole:
        runs = [r for r in runs if layer.span(r[0], r[1])[2]]
    for a, b, inner in runs:
        start, end, _ = layer.span(a, b)
        yield Layer(inner, [(0, (start, end, False))]), False
        lo, hi = _beside(text, a, -1), _beside(text, b, 1)
        if lo < a or hi > b:
            yield layer.replaced([(a, b, inner)], lo, hi), False
    for pattern, mark, decode in ((URL_RUN, "%", unquote), (ESCAPE_RUN, "\\u", _unescape)):
        if some := _marked(text, pattern, mark, decode):
            yield layer.replaced(some, 0, len(text)), whole


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans). What a secret takes of an encoded run counts as the outermost whole
    run; what it takes of the text beside the run counts as it stands.

    The worklist ends when no layer yields a new one: a layer already seen for the same source
    is not taken again, which also ends cycles. Null is the empty text and has no spans.
    """
    text = text or ""
    base = base_spans(text)
    spans = set(base)
    work = list(_children(Layer(text, [(0, (0, len(text), True))]), True)) if text else []
    seen: set[tuple] = set()
    while work:
        layer, whole = work.pop()
        mark = tuple(s for _, s in layer.segments) if not whole else (), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        for a, kind, b in base_spans(layer.text):
            start, end, decoded = layer.span(a, b)
            if decoded:
                spans.add((start, kind, end))
        work.extend(_children(layer, whole))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def redact(text: str | None) -> str | None:
    """The text with every found span replaced by [SECRET]; overlapping spans are one."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if end > at:
            out += [text[at:start], "[SECRET]"] if start >= at else []
            at = end
    return "".join([*out, text[at:]])


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts by kind, digest of the base spans, all spans.

    A null text is empty and has no spans (the digest is that of nothing); texts are scanned whole;
    repeated rows and null ids each have their row; an empty table gives none; other columns are
    not read.
    """

    def batch(ids, texts):
        found = [scan(text) for text in texts]
        kinds = [[kind for _, kind, _ in base] for base, _ in found]
        digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
        return (ids, *([k.count(kind) for k in kinds] for kind in KINDS), digests, [_joined(spans) for _, spans in found])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_columns(docs, ["doc_id", "text"], batch, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of `text` replaced; all other columns as they are, null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return docs.withColumn("text", clean("text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned for secrets."""
    return scan_documents(table(spark, sf_dir, "documents"))
