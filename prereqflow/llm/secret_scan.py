"""Secrets: base patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
#: Runs long enough for an access id (16), a hexadecimal key (32) or an entropy window.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WINDOW = 20
#: Bits a character that a window must reach, by the class of its candidate; log2(20) = 4.32 is the most a window can have.
BITS = {"hex": 3.2, "alnum": 3.9, "base64": 3.9}
#: Never an entropy finding: no digit or no letter (words, numbers), UUIDs, one word or number after another, documentation's own examples.
ALLOWED = (
    re.compile(r"[^0-9]*"),
    re.compile(r"[^A-Za-z]*"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+]+|$))+"),
    re.compile(r".*(?:EXAMPLE|example)(?:KEY|key)?"),
)
#: Runs of one class inside a candidate, where a window fits; '=' ends a base64 run as padding or sets a name apart from its value.
RUNS = tuple(re.compile(r) for r in (r"[0-9a-f]{20,}", r"[0-9A-F]{20,}", r"[A-Za-z0-9]{20,}", r"[A-Za-z0-9+/_-]{20,}=*"))
PIECE = re.compile(r"[^=]+=*|=+")
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Unions of the windows of s whose entropy reaches the bound of its class; counts change by one character out and one in."""
    if len(s) < window or any(p.fullmatch(s) for p in ALLOWED):
        return
    bound = BITS[char_class(s)]
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1  # total: sum of c * log2(c)
    for i, c in enumerate(s):
        if i >= window:
            n = counts[old := s[i - window]]
            total += _CLOG[n - 1] - _CLOG[n]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += _CLOG[n + 1] - _CLOG[n]
        counts[c] = n + 1
        if i >= window - 1 and math.log2(window) - total / window >= bound - 1e-9:
            if begin >= 0 and i - window + 1 > end:
                yield begin, end
                begin = -1
            begin, end = (i - window + 1 if begin < 0 else begin), i + 1
    if begin >= 0:
        yield begin, end


def entropy_findings(s: str) -> list[tuple[int, int]]:
    """Spans of a candidate's secrets: the candidate and each run of one class inside it, by the bound and allow-list of its own class.

    A hit is widened to its run, and one of the candidate to the pieces between '=' that it touches, so no part of a key stays.
    """
    found = [m.span() for r in RUNS for m in r.finditer(s) if next(entropy_spans(m[0]), None)]
    pieces = [m.span() for m in PIECE.finditer(s)]
    for begin, end in entropy_spans(s):
        touched = [x for x in pieces if x[0] < end and begin < x[1]]
        found.append((touched[0][0], touched[-1][1]))
    out: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret, sorted; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in CANDIDATE.finditer(text):
        at, s = run.start(), run[0]
        found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(s)]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(s)]
        for begin, end in entropy_findings(s):
            if not any(a <= at + begin and at + end <= b for a, _, b in found):
                found.append((at + begin, 3, at + end))
    return sorted(found)


def confirmed(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the given spans in which entropy finds a secret too, whatever found them; spans that entropy alone found among them."""
    if not spans:
        return []
    hits = [(run.start() + a, run.start() + b) for run in CANDIDATE.finditer(text) for a, b in entropy_findings(run[0])]
    return [(a, k, b) for a, k, b in spans if any(x < b and a < y for x, y in hits)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Each union of overlapping spans becomes one mark; spans are sorted."""
    out, at, covered = [], 0, -1
    for a, _, b in spans:
        if a >= covered:
            out += [text[at:a], mark]
        at = covered = max(covered, b)
    return "".join(out) + text[at:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, n_confirmed, confirmed, redacted: one row a document. confirmed: the spans, joined
    likewise, in which entropy finds a secret, those of the base patterns too; what a base pattern alone says is left out there.

    Null text: as an empty one, without spans; redacted stays null. Null id: kept. Repeated rows: each scanned. Empty table: no row.
    Texts are scanned whole, in one pass, on the executors; nothing is shuffled. Columns that aren't named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = scan(text or "")
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                base = joined([x for x in spans if x[1] < 3])
                rows.append((doc, *n, hashlib.sha256(base.encode()).hexdigest(), joined(spans), len(sure := confirmed(text or "", spans)), joined(sure), redact(text, spans) if spans else text))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    id_type = df.schema[id_col].dataType
    ddl = f"doc_id {id_type.simpleString()}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, n_confirmed long, confirmed string, redacted string"
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64()), ("confirmed", pa.string()), ("redacted", pa.string())])
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every found secret replaced by a mark. Null texts stay null, null ids and repeated rows stay; an
    empty table gives no row, and no name of a column can clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t and (redact(t, s) if (s := scan(t)) else t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets() over all documents, without the redacted texts."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")
