"""Secret scans with a trigram inverted index.

Each rule's regular expression yields a Boolean query over lower-cased trigrams that every match
must contain (`required`): an AND of ORs, or nothing where no trigram is mandatory. Documents are
indexed in segments, one segment being a slice of a partition: the postings of a segment list, for
each trigram that some rule asks for, the segment's documents that hold it. A rule's query
intersects and unites postings; only the candidates are verified with the expression itself. Rules
without mandatory trigrams scan every document. Index and documents stay in one task, so nothing is
shuffled and memory is bounded by a segment or one text.

Defined results: a null text is the empty one and has no spans; offsets are code points, the end is
exclusive; matches of one kind are leftmost and don't overlap, those of different kinds may; a match
that is shorter than its rule's least length is dropped after matching; repeated rows are scanned
each; extra columns are not read. Every rule takes time in proportion to the text, hostile texts included.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import batches, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: whose length counts
    least: int = 0  #: characters; shorter matches are dropped
    linear: str = ""  #: for Python, whose search backtracks: an expression whose group "hit" is what `pattern` matches, in linear time


#: The three rules that every scan reports, in the order of their kinds.
BASE = (
    Rule("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Of a run of a token's characters only the first beginning counts: where it fails, later ones fail at the same place.
_WEB_TOKEN = r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<hit>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})"
#: Published token formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", linear=_WEB_TOKEN),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + MORE

_MOST_STRINGS, _MOST_CLASS = 64, 12


def required(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives of trigram sets: each match's lower-cased text holds all of one alternative.

    None: no trigram is mandatory.
    """
    tree = rp.parse(pattern)
    exact, query = _walk(list(tree))
    return _simple(_both(query, _of_strings(exact)))


def _walk(items: list) -> tuple[set[str] | None, frozenset | None]:
    """The strings that a sequence matches, if they are few and all known, else what it requires.

    A run of known strings is folded into the query as soon as something unknown follows it.
    """
    run: set[str] | None = {""}
    query: frozenset | None = None
    whole = True
    for op, value in items:
        strings, inner = _one(op, value)
        query = _both(query, inner)
        if strings is not None and run is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        query = _both(query, _of_strings(run))
        run = strings
    return (run, query) if whole else (None, _both(query, _of_strings(run)))


def _one(op, value) -> tuple[set[str] | None, frozenset | None]:
    if op is rc.LITERAL:
        return {chr(value).lower()}, None
    if op is rc.IN:
        members: set[str] = set()
        for kind, x in value:
            if kind is rc.LITERAL:
                members.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < _MOST_CLASS:
                members |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (members, None) if len(members) <= _MOST_CLASS else (None, None)
    if op is rc.SUBPATTERN:
        return _walk(list(value[3]))
    if op is rc.BRANCH:
        arms = [_walk(list(x)) for x in value[1]]
        if all(s is not None and q is None for s, q in arms) and sum(len(s) for s, _ in arms) <= _MOST_STRINGS:
            return set().union(*(s for s, _ in arms)), None
        found: frozenset | None = frozenset()
        for s, q in arms:
            arm = _both(q, _of_strings(s))
            found = None if found is None or arm is None else found | arm
        return None, found
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, inner = value
        s, q = _walk(list(inner))
        if low == 0:
            return (s | {""}, None) if high == 1 and s is not None and q is None else (None, None)
        if low == high == 1:
            return s, q
        return None, _both(q, _of_strings(s))
    if op is rc.AT:
        return {""}, None
    return None, None


def _of_strings(strings: set[str] | None) -> frozenset | None:
    """Alternatives of the strings' trigrams; None if one has none."""
    if strings is None or any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return a if b is None else b
    return a if len(a) * len(b) > _MOST_STRINGS else _simple(frozenset(x | y for x in a for y in b))


def _simple(q: frozenset | None) -> frozenset | None:
    """Alternatives that contain a smaller one are implied by it."""
    return None if q is None else frozenset(x for x in q if not any(y < x for y in q))


_LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint32)


class Index:
    """Postings of one segment, for the trigrams that the rules ask for."""

    def __init__(self, trigrams: list[bytes]):
        self.trigrams = trigrams
        self.number = {t: i for i, t in enumerate(trigrams)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(trigrams):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, texts: pa.Array) -> list[np.ndarray]:
        """For each trigram the sorted rows of texts, UTF-8 bytes, that hold it in either case."""
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or bounds[-1] - bounds[0] < 3:
            return [np.empty(0, np.int64)] * len(self.trigrams)
        data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
        found = self.slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found >= 0)
        row = np.searchsorted(bounds - bounds[0], at, "right") - 1
        whole = at + 3 <= (bounds - bounds[0])[row + 1]
        keys = np.unique(found[at[whole]].astype(np.int64) * len(texts) + row[whole])
        cuts = np.searchsorted(keys, np.arange(1, len(self.trigrams)) * len(texts))
        return [x % len(texts) for x in np.split(keys, cuts)]


def candidates(query: frozenset | None, index: Index, postings: list[np.ndarray], rows: int) -> np.ndarray:
    """Rows that satisfy the query: the union, over its alternatives, of intersected postings."""
    if query is None:
        return np.arange(rows)
    found = [np.empty(0, np.int64)]
    for alternative in query:
        lists = sorted((postings[index.number[t.encode()]] for t in alternative), key=len)
        hit = lists[0]
        for other in lists[1:]:
            if not len(hit):
                break
            hit = np.intersect1d(hit, other, assume_unique=True)
        found.append(hit)
    return np.unique(np.concatenate(found))


@lru_cache(8)
def _prepared(rules: tuple[Rule, ...]):
    queries = [required(r.pattern) for r in rules]
    # A trigram with a non-ASCII character has other bytes, so rules that have one scan fully.
    queries = [None if q is not None and any(not t.isascii() for a in q for t in a) else q for q in queries]
    trigrams = sorted({t.encode() for q in queries if q is not None for a in q for t in a})
    return [re.compile(r.linear or r.pattern) for r in rules], queries, Index(trigrams)


def verify(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    hit = "hit" if rule.linear else 0
    return [m.span(hit) for m in expression.finditer(text) if len(m[rule.group]) >= rule.least]


def _long_runs(rule: Rule, expression: re.Pattern) -> re.Pattern:
    """For a pattern that is one character class and +, the same matches without the short ones."""
    if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.least > 1:
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return expression


def scan_segment(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, place of the rule, end), sorted."""
    expressions, queries, index = _prepared(rules)
    postings = index.postings(texts)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    decoded: dict[int, str] = {}
    values = texts.to_pylist()
    for place, (rule, expression, query) in enumerate(zip(rules, expressions, queries)):
        expression = _long_runs(rule, expression)
        for row in candidates(query, index, postings, len(texts)).tolist():
            text = decoded.get(row) if query is not None else None
            if text is None:
                text = values[row].decode()
                if query is not None:
                    decoded[row] = text
            spans[row] += [(start, place, end) for start, end in verify(rule, expression, text)]
    return [sorted(x) for x in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of kind, start, end, by start and then the order of the rules."""
    kinds = [r.kind for r in rules]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches(it, 4 << 20):
            found = [[{"kind": kinds[p], "start": s, "end": e} for s, p, e in x] for x in scan_segment(b.column("text"), rules)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of docs; spans in text give way to the mask, joined where they overlap.

    A text without spans, null included, stays as it is. n_chars, if it is there as a whole number, follows the text.
    """
    counted = isinstance(docs.schema["n_chars"].dataType, IntegralType) if "n_chars" in docs.columns else False

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            found = scan_segment(pa.array([(t or "").encode() for t in texts], pa.binary()), rules)
            if any(found):
                texts = [masked(t, x, mask) if x else t for t, x in zip(texts, found)]
                columns = list(b.columns)
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if counted:
                    n = b.schema.get_field_index("n_chars")
                    lengths = [len(t) if x else old for t, x, old in zip(texts, found, b.column(n).to_pylist())]
                    columns[n] = pa.array(lengths, b.schema.field(n).type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]
