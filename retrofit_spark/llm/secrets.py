"""Secret scans by a trigram inverted index.

Each rule's pattern is parsed and reduced to a Boolean query over trigrams that any match must contain (trigrams.py). A
partition's documents are indexed slice by slice: postings map each trigram that some query names to
the documents that have it. Queries are answered by uniting and intersecting postings, and only
the documents found are searched with the pattern. A rule whose pattern has no mandatory trigram
is answered by a full scan: of the bytes for a run that the pattern asks for (32 hex digits), else of all texts with
the pattern itself. What a rule is named has no part in it. No shuffle: the index of a slice lives beside its text.

Null text counts as empty; an empty table gives an empty result; repeated rows are scanned each on
their own; other columns are ignored. A text of any length is searched whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import LOWER, rows_of, text_slices
from .scratch import documents
from .trigrams import Query, query_of, run_of


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; least: least length of `group` in a match that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True
    compiled: re.Pattern = field(init=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    def query(self) -> Query:
        """The Boolean trigram query in disjunctive form: one of these sets of trigrams is in every match. Empty: scan fully."""
        return query_of(self.pattern, re.ASCII)


#: The base kinds, then the kinds that this scanner adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 0, False),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9+/_.=~-]+)", 1, 16, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, False),
)


def _codes(data: np.ndarray) -> np.ndarray:
    wide = LOWER[data].astype(np.uint32)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(data) >= 3 else np.zeros(0, np.uint32)


class TrigramIndex:
    """Postings of the wanted trigrams over the rows of one slice."""

    def __init__(self, wanted: set[str]):
        names = sorted(wanted)
        self.slot = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint32)
        for k, name in enumerate(names, 1):
            a, b, c = name.encode("latin-1")
            self.slot[(a << 16) | (b << 8) | c] = k
        self.names = names

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        slots = self.slot[_codes(data)]
        at = np.flatnonzero(slots)
        rows = rows_of(offsets, at)
        whole = at + 3 <= offsets[rows + 1]
        pairs = np.unique(slots[at[whole]].astype(np.int64) * len(offsets) + rows[whole])
        which, rows = pairs // len(offsets), pairs % len(offsets)
        return {name: rows[which == k] for k, name in enumerate(self.names, 1)}


def answer(query: Query, postings: dict[str, np.ndarray]) -> np.ndarray:
    """Rows that satisfy the query: the union over its sets of the intersection of their postings, shortest first."""
    found = []
    for trigrams in query:
        lists = sorted((postings[t] for t in trigrams), key=len)
        rows = lists[0]
        for other in lists[1:]:
            rows = np.intersect1d(rows, other, assume_unique=True)
        found.append(rows)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _run_rows(data: np.ndarray, offsets: np.ndarray, least: int, inside: np.ndarray) -> np.ndarray:
    """Full scan: rows that touch a run of `least` or more bytes of the table (run ends at row ends are refined by the pattern)."""
    if not len(data):
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[data].view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    spans = [np.arange(a, b + 1) for a, b in zip(rows_of(offsets, starts[long]), rows_of(offsets, ends[long] - 1), strict=True)]
    return np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)


def scan_text(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of one text, in code points, by start and then rule."""
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.compiled.finditer(text) if len(m.group(r.group)) >= r.least)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and spans (array of struct kind, start, end; code points, end exclusive)."""
    queries = [r.query() for r in rules]
    runs = {k: (n, np.isin(np.arange(256), sorted(codes))) for k, r in enumerate(rules) if not queries[k] and (found := run_of(r.pattern, re.ASCII)) for n, codes in [found]}

    def run(batches):
        index = TrigramIndex({t for q in queries for s in q for t in s})
        for rows, data, offsets in text_slices(batches):
            postings = index.postings(data, offsets)
            todo: dict[int, list[int]] = {}
            for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                if query:
                    hits = answer(query, postings)
                elif k in runs:
                    hits = _run_rows(data, offsets, *runs[k])
                else:
                    hits = range(len(offsets) - 1)
                for i in hits:
                    todo.setdefault(int(i), []).append(k)
            raw = data.tobytes()
            spans = []
            for i in range(rows.num_rows):
                text = raw[offsets[i] : offsets[i + 1]].decode() if i in todo else ""
                found = sorted((m.start(), k, m.end()) for k in todo.get(i, ()) for m in rules[k].compiled.finditer(text) if len(m.group(rules[k].group)) >= rules[k].least)
                spans.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets()."""
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) AS n_{k}" for k in ("assign", "access", "hex")),
        f"sha2({listed.format(base)}, 256) AS base_sha256",
        f"{listed.format('spans')} AS spans",
    )


def brute(text: str | None) -> str:
    """Base and added spans of one text without the index, for tests."""
    return ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in scan_text(text or ""))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
