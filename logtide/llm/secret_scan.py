"""Secrets in texts: certain patterns, and weak parts linked to their complements.

Three certain patterns are always reported. Beside them a text has weak parts, each too
common to report alone: identifiers (``user=``, ``client_id:``, ``access_key_id``, e-mail addresses),
secrets (long mixed strings that no certain pattern covers) and endpoints (URLs and IPv4
addresses, with or without a port). Parts are intervals; those of one text are joined when the gap
between them is at most ``scope`` characters and no blank line lies between. A weak secret is
reported when an identifier, a certain access key or an endpoint is linked to it; a weak
identifier or endpoint when a secret, weak or certain, is. Weak parts that overlap a certain
span are not reported again.

The join sweeps each text's intervals in order of place and names, for each reported weak part, the
nearest part that it is linked to. Positions are code points, end exclusive. Nothing is shuffled.

Nulls and odd rows: a null text counts as empty and has no spans; a null doc_id is kept;
repeated rows are scanned alike; of two partners at the same distance the earlier is named; an empty table gives an empty result; other
columns of the input are not read. Texts are scanned whole, in time linear in their length: a
pattern that starts with a run of any length starts at the run's first character only.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of kinds where spans start at the same place.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Largest gap between linked parts, in characters.
SCOPE = 160

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

_IDENTIFIER = re.compile(
    r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}|(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""",
    re.IGNORECASE | re.ASCII,
)
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])""", re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])", re.ASCII)

Span = tuple[int, int, str]


def certain(text: str) -> list[Span]:
    """Spans of the three certain patterns, leftmost and without overlap within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _mixed(token: str) -> bool:
    """Long enough, of letters and digits, and with a spread of characters unlike a word's."""
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return False
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return entropy >= 3.2


def weak(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that don't overlap certain spans."""
    found: list[Span] = []
    if "@" in text or ":" in text or "=" in text:
        found += [(*m.span(), "identifier") for m in _IDENTIFIER.finditer(text)]
    if "." in text or "://" in text:
        found += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    found += [(*m.span(), "secret") for m in _SECRET.finditer(text) if _mixed(m[0])]
    if base:
        starts = [s for s, _, _ in base]
        reach, ends = 0, []
        for _, end, _ in base:
            reach = max(reach, end)
            ends.append(reach)
        found = [x for x in found if (i := bisect.bisect_left(starts, x[1])) == 0 or ends[i - 1] <= x[0]]
    return sorted(found, key=_order)


def partners(text: str, base: list[Span], parts: list[Span], scope: int = SCOPE) -> list[tuple[Span, Span]]:
    """Weak parts with their nearest complementary part, if one lies within ``scope`` and no blank line between.

    Secrets complement identifiers and endpoints. One sweep to the right and one to the left
    keep, for either side, the nearest part seen.
    """
    side = {"assign": "s", "hex": "s", "secret": "s", "access": "i", "identifier": "i", "endpoint": "i"}
    rows = sorted([*((x, False) for x in base), *((x, True) for x in parts)], key=lambda r: _order(r[0]))
    best: list[tuple[int, Span] | None] = [None] * len(rows)
    near: dict[str, Span] = {}
    for i, (span, _) in enumerate(rows):
        own = side[span[2]]
        other = near.get("i" if own == "s" else "s")
        if other and span[0] - other[1] <= scope and "\n\n" not in text[other[1] : span[0]]:
            best[i] = max(span[0] - other[1], 0), other
        if own not in near or span[1] > near[own][1]:
            near[own] = span
    near = {}
    for i in range(len(rows) - 1, -1, -1):
        span, _ = rows[i]
        own = side[span[2]]
        other = near.get("i" if own == "s" else "s")
        if other and other[0] - span[1] <= scope and "\n\n" not in text[span[1] : other[0]]:
            gap = max(other[0] - span[1], 0)
            if best[i] is None or gap < best[i][0]:
                best[i] = gap, other
        near[own] = span
    return [(span, found[1]) for (span, is_weak), found in zip(rows, best, strict=True) if is_weak and found]


def linked(text: str, base: list[Span], parts: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts that have a partner."""
    return [span for span, _ in partners(text, base, parts, scope)]


def scan(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """(certain spans, all spans), in order of place and kind."""
    base, found, _ = scan_links(text, scope)
    return base, found


def scan_links(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span], list[tuple[Span, Span]]]:
    """As ``scan``, and each weak span with its partner."""
    base = certain(text)
    links = partners(text, base, weak(text, base), scope)
    return base, sorted([*base, *(span for span, _ in links)], key=_order), links


def _named(span: Span) -> str:
    return f"{span[2]}:{span[0]}:{span[1]}"


def _scanned(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_sha, spans, links = {k: [] for k in ("assign", "access", "hex")}, [], [], []
            for x in batch.column(1):
                base, found, pairs = scan_links(x.as_py() or "", scope)
                for kind, column in counts.items():
                    column.append(sum(k == kind for _, _, k in base))
                base_sha.append(hashlib.sha256(",".join(map(_named, base)).encode()).hexdigest())
                spans.append(",".join(map(_named, found)))
                links.append(",".join(f"{_named(a)}={_named(b)}" for a, b in pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), *(pa.array(c, pa.string()) for c in (base_sha, spans, links))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"],
            )

    return run


def secrets(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end), and links (weak span=partner) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanned(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
