"""Secret scan with multipart credential linking.

Strong spans come from three fixed patterns (BASE). Beside them there are weak candidates: a short or oddly named value
that may be an access identifier, a secret or an endpoint. Alone they say nothing, so they are reported only when their
complementary parts stand near: a weak secret with an identifier or an endpoint, a weak identifier with a secret, an
endpoint with an identifier and a secret. Near means that the two spans' intervals, widened by REACH code points and cut
at the borders of their scope (the paragraph in which they start), overlap: an interval join within each text by binary
search in the sorted spans, so a text with n spans costs n log n. Strong spans are always reported, and a weak one never
covers part of one.

Offsets are code points, the end exclusive. A null or empty text has no spans. Rows that repeat an id or text are scanned
alike, and an empty table gives an empty result. A column of the result's name is replaced; all others stay.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, expression, group that is measured, least length of it. Fixed values.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Weak candidates: kind, part of a credential that it may be, expression.
WEAK = (
    ("weak_id", "id", re.compile(r"\b(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+/_.-]{3,}", re.I | re.A)),
    (
        "weak_secret",
        "secret",
        re.compile(
            r"(?i:\b(?:pass|pwd|pin|auth|credential|private[_-]?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,})"
            r"|(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",  # upper and lower case both
            re.A,
        ),
    ),
    ("endpoint", "endpoint", re.compile(r"\b[a-z][a-z0-9+.-]{1,12}://[^\s\"'<>]{4,}|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}", re.I | re.A)),
)
PART = {"assign": "secret", "hex": "secret", "access": "id"} | {kind: part for kind, part, _ in WEAK}
ORDER = {kind: n for n, kind in enumerate([*(b[0] for b in BASE), *(w[0] for w in WEAK)])}
REACH = 240
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_NEEDS = {"secret": (("id", "endpoint"),), "id": (("secret",),), "endpoint": (("id",), ("secret",))}
SCHEMA = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong spans: leftmost and without overlap within a kind, failing matches dropped."""
    return [(m.start(), m.end(), kind) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def linked_spans(text: str, strong: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak spans whose complementary parts co-occur."""
    covered = sorted(strong)
    ends = _running_ends([(start, end) for start, end, _ in covered])
    weak = []
    for kind, _, pattern in WEAK:
        for m in pattern.finditer(text):
            k = bisect.bisect_left(covered, (m.end(),))
            if not k or ends[k - 1] <= m.start():
                weak.append((m.start(), m.end(), kind))
    if not weak:
        return []
    borders = [m.start() for m in _PARAGRAPH.finditer(text)]
    parts: dict[str, _Part] = {}
    for part in ("id", "secret", "endpoint"):
        parts[part] = _Part([(start, end) for start, end, kind in [*strong, *weak] if PART[kind] == part], borders)
    near = lambda part, s: parts[part].near(s[0], s[1], 2 * reach)
    return [s for s in weak if all(any(near(p, s) for p in one) for one in _NEEDS[PART[s[2]]])]


class _Part:
    """The distinct spans of one part of a credential, in the order of their starts, each with its scope's two furthest ends so far."""

    def __init__(self, spans: list[tuple[int, int]], borders: list[int]) -> None:
        self._spans, self._borders, self._furthest = sorted(set(spans)), borders, []
        last = None
        for span in self._spans:
            scope = self._scope(span[0])
            one, two = self._furthest[-1] if scope == last else (None, None)
            if one is None or span[1] > one[1]:
                one, two = span, one
            elif two is None or span[1] > two[1]:
                two = span
            self._furthest.append((one, two))
            last = scope

    def _scope(self, at: int) -> int:
        return bisect.bisect_right(self._borders, at)

    def near(self, start: int, end: int, distance: int) -> bool:
        """Is there a span in the scope of start, other than start:end, that starts and ends within the distance?"""
        scope = self._scope(start)
        last = self._borders[scope] if scope < len(self._borders) else 1 << 60
        k = bisect.bisect_left(self._spans, (min(end + distance + 1, last),)) - 1
        if k < 0 or self._scope(self._spans[k][0]) != scope:
            return False
        return any(s is not None and s != (start, end) and s[1] >= start - distance for s in self._furthest[k])


def _running_ends(spans: list[tuple[int, int]]) -> list[int]:
    out, most = [], 0
    for _, end in spans:
        most = max(most, end)
        out.append(most)
    return out


def find_spans(text: str | None) -> list[dict]:
    if not text:
        return []
    strong = base_spans(text)
    weak = linked_spans(text, strong)
    found = [(s, e, k, True) for s, e, k in strong] + [(s, e, k, False) for s, e, k in weak]
    return [{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in sorted(found, key=lambda x: (x[0], ORDER[x[2]], x[1]))]


def scan_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """df with the spans of column `text` in an array of structs (kind, start, end, base) in column `into`."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(x.as_py()) for x in texts], kind)

    return df.withColumn(into, F.arrow_udf(scan, SCHEMA).asNondeterministic()(df[text]))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )
