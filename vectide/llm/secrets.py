"""Secret scans: patterns for known credentials, and automata inferred from what they find.

Three patterns give the base spans. Their finds are the labelled credentials: a bounded sample of each kind trains a
probabilistic automaton over character classes by state merging, and a sample of ordinary strings trains a plain chain: words and
numbers, and such other candidates as are not likelier credentials, so that credentials that no pattern finds do not teach
it their format. Every run of credential characters as long as the shortest credential of the patterns is then scored; one that an
automaton makes likelier than the chain by MARGIN nats a character is added, unless a base span overlaps it.

Defined cases: a null text counts as empty and has no spans; repeated rows each give a row; an empty table gives none;
without labelled finds nothing is added; spans of one start go by kind in the order listed; very long texts are read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.automata import Automaton, Chain, symbols
from vectide.llm.common import keep, picked, read, slices

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
#: Strings of one kind that train its automaton, and candidates that train the chain.
SAMPLE = 300
ORDINARY = 5_000
#: Nats a character. Words in capitals look most like labelled keys among ordinary strings; from 0.6 on none of them passes.
MARGIN = 0.6
#: The shortest credential that a base span can label; shorter strings match the format of none.
LEAST = 6
#: Strings of symbols that a task remembers the verdict on.
MEMORY = 500_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_PLAIN = re.compile("[A-Za-z]+|[0-9+/_.=-]+")
#: Times at most that the chain chooses anew what trains it.
ROUNDS = 10


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, stop (code points) and the credential itself of every base span, by start and kind."""
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """start, stop and characters of every run of credential characters that no base span overlaps: one walk along both."""
    out, at, stop = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][1] < b:  # base spans by start: all that begin before the run ends
            stop = max(stop, base[at][2])
            at += 1
        if stop <= a:
            out.append((a, b, m[0]))
    return out


def is_plain(v: str) -> bool:
    """Whether a candidate is letters only, or digits and marks only: what the chain takes for ordinary to begin with."""
    return _PLAIN.fullmatch(v) is not None


class Least:
    """The strings with the smallest checksums so far, ORDINARY at most: those that may be among those of all tasks."""

    def __init__(self):
        self.heap: list[int] = []
        self.known: set[str] = set()

    def new(self, v: str) -> bool:
        h = -zlib.crc32(v.encode())
        if len(self.heap) < ORDINARY:
            heapq.heappush(self.heap, h)
        elif h < self.heap[0]:
            return False
        else:
            heapq.heapreplace(self.heap, h)
        self.known.add(v)
        return True


def examples(docs: DataFrame) -> DataFrame:
    """kind and v: the credentials of base spans, and those candidates of each task, plain ones and others apart, that can be among
    the ORDINARY with the smallest checksums."""

    def run(batches):
        least = {"plain": Least(), "candidate": Least()}
        for batch in slices(batches):
            out = []
            for t in batch.column(0).to_pylist():
                t = t or ""
                base = base_spans(t)
                out += [(k, v) for k, _, _, v in base]
                for v in {v for _, _, v in candidates(t, base)} - least["plain"].known - least["candidate"].known:
                    kind = "plain" if is_plain(v) else "candidate"
                    if least[kind].new(v):
                        out.append((kind, v))
            kinds, values = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "v"])

    return picked(docs, "text").mapInArrow(run, "kind string, v string")


def learn(found: DataFrame) -> tuple[dict[str, Automaton], Chain | None]:
    """An automaton for each kind that has finds, and the chain of ordinary strings, from :func:`examples`."""

    def sample(kind: str, most: int = SAMPLE) -> list[str]:
        got = found.filter(F.col("kind") == kind).select("v").distinct().orderBy(F.crc32(F.col("v").cast("binary")), "v").limit(most).collect()
        return sorted(symbols(r["v"]) for r in got)

    automata = {k: Automaton(s) for k in KINDS if (s := sample(k))}
    return automata, ordinary(sample("plain", ORDINARY), sample("candidate", ORDINARY), automata)


def ordinary(words: list[str], others: list[str], automata: dict[str, Automaton]) -> Chain | None:
    """The chain of ``words`` and of those of ``others`` that it does not find credentials itself."""
    if not words and not others:
        return None
    chain, kept = Chain(words), None
    for _ in range(ROUNDS):
        now = [s for s in others if not likely(s, automata, chain)]
        if now == kept:
            break
        chain, kept = Chain(words + now), now
    return chain


def likely(s: str, automata: dict[str, Automaton], other: Chain) -> bool:
    return bool(automata) and max(a.log_likelihood(s) + a.log_length(len(s)) for a in automata.values()) - other.log_likelihood(s) > MARGIN * len(s)


class Judge(dict):
    """Whether strings of symbols are credentials; it remembers what it has judged."""

    def __init__(self, automata: dict[str, Automaton], other: Chain | None):
        super().__init__()
        self.automata, self.other = automata, other

    def __missing__(self, s: str) -> bool:
        if len(self) > MEMORY:
            self.clear()
        out = self[s] = self.other is not None and likely(s, self.automata, self.other)
        return out


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans (all
    spans as kind:start:end, joined by commas), n_learned."""
    automata, other = learn(keep(examples(docs), "secrets-examples"))
    order = {k: i for i, k in enumerate((*KINDS, LEARNED))}

    def run(batches):
        judge = Judge(automata, other)
        for batch in slices(batches):
            out = []
            for d, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                base = base_spans(t or "")
                spans = [s[:3] for s in base]
                text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                added = [(LEARNED, a, b) for a, b, v in candidates(t or "", base) if judge[symbols(v)]] if automata else []
                full = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans + added, key=lambda s: (s[1], order[s[0]])))
                out.append((d, *(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), full, len(added)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i + 1] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    docs = picked(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))


QUERIES = {"op4_secrets": op4_secrets}
