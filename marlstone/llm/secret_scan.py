"""Secret scans: known formats, then sliding-window Shannon entropy over candidate strings.

Known formats are found by pattern (assignments, access keys, long hex). A
candidate string is a maximal run of characters that keys are written in. A
window slides over it; its entropy is kept up by incremental counts, one
character in and one out, and compared with the limit of the window's
character class. Windows over the limit are merged into spans of kind
``entropy``, unless the allow-list covers the candidate or known formats
already cover the whole span.

Null and empty texts have no spans; very long texts are scanned whole, in time
that grows with their length. Spans that start together are listed by kind, in
the order of ``KINDS``. Repeated rows give repeated results, an empty table an
empty one. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import map_texts, text_column

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is long enough matches from its start, so this drops just the short ones
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+")

WINDOW = 20
#: Bits a character over a window of 20, by class: the most that is possible is 3.32, 4.0 and 4.32.
LIMITS = {"digits": 2.8, "hex": 3.1, "alnum": 3.55, "base64": 3.6}
#: Not secrets although they look random: UUIDs, dates, times and other numbers of up to ten digits joined by marks, paths of plain words, rulers.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[+/=_-]*[0-9]{1,10}([+/=_-]+[0-9]{1,10})+[+/=_-]*",
    r"[+/=_-]+",
    r"[A-Z]?[a-z]+([/_=+-]+[A-Z]?[a-z]+)*[/_=+-]*",
    r"[A-Z]+([/_=+-]+[A-Z]+)*[/_=+-]*",
)
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, 4097)]


def char_class(text: str) -> str:
    """The narrowest class that holds all characters."""
    if text.isdigit():
        return "digits"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``text`` whose entropy is over the limit of their class.

    The limit is that of the whole candidate's class; unless that is digits, a
    window must mix digits and letters, as words joined by marks do not.
    """
    n = len(text)
    if n < window:
        return []
    kind = char_class(text)
    limit, mixed = LIMITS[kind], 0 if kind == "digits" else 2
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _CLOGC[k + 1] - _CLOGC[k]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            old = text[i - window]
            k = counts[old]
            counts[old] = k - 1
            total += _CLOGC[k - 1] - _CLOGC[k]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= window - 1 and digits >= mixed and letters >= mixed and math.log2(window) - total / window >= limit:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def scan(text: str, allow: Iterable[re.Pattern] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that entropy adds; both by start, then kind."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=order)
    allow = [re.compile(p) for p in ALLOW] if allow is None else allow
    runs: list[tuple[int, int]] = []  # what known formats cover, in order
    for _, a, b in base:
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    added, at = [], 0
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m.group()) for p in allow):
            continue
        for s, e in entropy_spans(m.group()):
            s, e = s + m.start(), e + m.start()
            while at < len(runs) and runs[at][1] < e:  # spans come in order, so one walk over both does
                at += 1
            if at == len(runs) or runs[at][0] > s:
                added.append(("entropy", s, e))
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``id_col`` and spans, an array of (kind, start, stop, added), of every row."""

    def make() -> Callable[[list[str]], list]:
        patterns = [re.compile(p) for p in allow]

        def run(texts: list[str]) -> list:
            out = []
            for t in texts:
                base, more = scan(t, patterns)
                out.append([{"kind": k, "start": s, "stop": e, "added": False} for k, s, e in base] + [{"kind": k, "start": s, "stop": e, "added": True} for k, s, e in more])
            return [out]

        return run

    return map_texts(df, make, "spans array<struct<kind:string,start:int,stop:int,added:boolean>>", id_col, text_col)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``find_secrets``: counts by kind, the hash of the base spans, all spans as text."""
    kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    text = lambda xs: F.array_join(
        F.transform(
            F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("a"), rank(x).alias("k"), x["stop"].alias("b"), x["kind"].alias("kind")))),
            lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"]),
        ),
        ",",
    )
    base = F.filter("spans", lambda x: ~x["added"])
    return found.select(id_col, kind("assign"), kind("access"), kind("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), kind("entropy"))


def redact(text: str, mark: str = "[SECRET]", allow: Iterable[re.Pattern] | None = None) -> str:
    """The text with every span, overlapping ones merged, replaced by the mark."""
    base, more = scan(text, allow)
    out, at = [], 0
    for _, s, e in sorted(base + more, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redacted(column):
    """Column function: the text without its secrets; null stays null."""

    def make():
        patterns = [re.compile(p) for p in ALLOW]
        return lambda texts: [[redact(t, allow=patterns) for t in texts]]

    return F.when(F.col(column).isNotNull(), text_column(make, "string")(F.col(column)))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
