"""Secret scanning: base patterns, and formats learnt by stochastic grammar inference (ALERGIA).

The credentials that the base patterns find are the labelled sample. A prefix tree of each kind's
credentials, over character classes, is folded into a probabilistic automaton: two states merge if a Hoeffding
bound cannot tell their frequencies apart, and neither any pair of states reached from them
(Carrasco and Oncina, 1994). Every other run of the credentials' alphabet, of any length, is then scored by
how much likelier an automaton makes its format than a model of ordinary runs does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, stage, table

KINDS = ("assign", "access", "hex", "grammar")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" if c == "_" else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A run of characters that credentials are made of; stops at its ends are no part of it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*")
#: Labelled credentials and ordinary tokens that the automata are learnt from, about: the bound of the sample.
MOST_SAMPLED = 2_000
#: Significance of the merge test, and least score of a new span.
ALPHA, LEAST = 0.05, 12.0
#: What a format is made of, and as one symbol more its end: the class of each byte of a run, all others a blank.
CLASSES = "dhlHU+/_.=-"
SYMBOLS = len(CLASSES) + 1
#: Formats up to this length are scored once and remembered; longer ones are scored each time.
REMEMBERED = 256


def classes(token: str) -> str:
    """A character class for each character: hex letters apart from other letters, digits, marks."""
    return "".join("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "H" if "A" <= c <= "F" else "U" if "A" <= c <= "Z" else c for c in token)


_CLASS_OF = "".join(classes(c) if c.isascii() and (c.isalnum() or c in CLASSES) else " " for c in map(chr, range(256))).encode()


def formats(text: str) -> list[bytes]:
    """Classes of every candidate of a text, in order; stops at the ends are left on."""
    return text.encode().translate(_CLASS_OF).split()


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns: by kind leftmost and non-overlapping, failing ones dropped."""
    out = []
    low = text.lower()
    if ("=" in text or ":" in text) and any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]


class Automaton:
    """Probabilistic deterministic automaton: a count for each arc and for ending in each state."""

    def __init__(self, sample: Counter[str], alpha: float = ALPHA) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for word, n in sorted(sample.items()):
            at = 0
            for c in word:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = self._new()
                self.counts[at][c] = self.counts[at].get(c, 0) + n
                at = self.arcs[at][c]
            self.ends[at] += n
        self._learn(alpha)
        self.totals = [self.total(s) for s in range(len(self.arcs))]

    def _new(self) -> int:
        self.arcs.append({})
        self.counts.append({})
        self.ends.append(0)
        return len(self.arcs) - 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.counts[s].values())

    def _learn(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, parent = [0], {t: (s, c) for s, arcs in enumerate(self.arcs) for c, t in arcs.items()}
        blue = sorted(self.arcs[0].values())
        while blue:
            q = blue.pop(0)
            for r in red:
                if self._alike(r, q, bound):
                    s, c = parent[q]
                    self.arcs[s][c] = r
                    self._fold(r, q)
                    for x in red:
                        for y, t in self.arcs[x].items():
                            parent[t] = (x, y) if t not in red else parent.get(t, (x, y))
                    break
            else:
                red.append(q)
            known = set(red)
            blue = sorted({t for x in red for t in self.arcs[x].values()} - known)
            for x in red:
                for y, t in self.arcs[x].items():
                    if t not in known:
                        parent[t] = (x, y)

    def _alike(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            far = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > far:
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                if abs(self.counts[a].get(c, 0) / n - self.counts[b].get(c, 0) / m) > far:
                    return False
                if c in self.arcs[a] and c in self.arcs[b]:
                    todo.append((self.arcs[a][c], self.arcs[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree, whose states have no other way in, to the state it merges with."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, t in self.arcs[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + self.counts[b][c]
                if c in self.arcs[a]:
                    todo.append((self.arcs[a][c], t))
                else:
                    self.arcs[a][c] = t

    def log_likelihood(self, word: str) -> float:
        """Natural log of the probability of a whole format. Every state is given one symbol more than it has seen, split
        evenly over all classes and the end; a class without an arc costs its part of that and leaves the state as it is."""
        at, out = 0, 0.0
        for c in word:
            out += math.log((self.counts[at].get(c, 0) + 1 / SYMBOLS) / (self.totals[at] + 1))
            at = self.arcs[at].get(c, at)
        return out + math.log((self.ends[at] + 1 / SYMBOLS) / (self.totals[at] + 1))


class Ordinary:
    """Class bigrams of tokens that are no credentials, smoothed: what a format is measured against."""

    def __init__(self, sample: Counter[str]) -> None:
        self.pairs: Counter[tuple[str, str]] = Counter()
        self.first: Counter[str] = Counter()
        for word, n in sample.items():
            for a, b in zip("^" + word, word + "$", strict=True):
                self.add(a, b, n)

    def add(self, a: str, b: str, n: int) -> None:
        self.pairs[a, b] += n
        self.first[a] += n

    def log_likelihood(self, word: str) -> float:
        return sum(math.log((self.pairs[a, b] + 0.5) / (self.first[a] + 0.5 * SYMBOLS)) for a, b in zip("^" + word, word + "$", strict=True))


class Grammar:
    """Automata of the labelled kinds and the ordinary model; ``score`` is a log-likelihood ratio."""

    def __init__(self, labelled: dict[str, Counter[str]], ordinary: Counter[str] | Ordinary) -> None:
        self.automata = {kind: Automaton(sample) for kind, sample in sorted(labelled.items()) if sample}
        self.ordinary = ordinary if isinstance(ordinary, Ordinary) else Ordinary(ordinary)
        self.seen: dict[bytes, float] = {}

    def score(self, token: str) -> float:
        return self.score_format(classes(token).encode())

    def score_format(self, found: bytes) -> float:
        """The score of a run's classes; stops at its ends do not count."""
        known = self.seen.get(found)
        if known is None:
            word = found.strip(b".").decode()
            known = max((a.log_likelihood(word) for a in self.automata.values()), default=-math.inf) - self.ordinary.log_likelihood(word) if word else -math.inf
            if len(found) <= REMEMBERED:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[found] = known
        return known


def spans(text: str, grammar: Grammar, least: float = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets: base spans, and candidates off them that the grammar scores at ``least``."""
    base = [x[:3] for x in base_spans(text)]
    new = []
    # Most texts have no format that scores so high: where the candidates lie is asked of the others only.
    if grammar.automata and any(grammar.score_format(w) >= least for w in set(formats(text))):
        for m in CANDIDATE.finditer(text):
            if grammar.score(m[0]) >= least and not any(s < m.end() and m.start() < e for s, e, _ in base):
                new.append((m.start(), m.end(), "grammar"))
    return sorted(base + new, key=lambda x: (x[0], KINDS.index(x[2])))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: Counter[tuple[str, str]] = Counter()
        plain: Counter[bytes] = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                found = base_spans(text)
                rows.update((kind, classes(x)) for _, _, kind, y in found if (x := y.strip(".")))
                if found:
                    plain.update(classes(m[0]).encode() for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _, _ in found))
                else:
                    plain.update(formats(text))
        pairs = Ordinary(Counter())
        for w, n in plain.items():
            if word := w.strip(b".").decode():
                for a, b in zip("^" + word, word + "$", strict=True):
                    pairs.add(a, b, n)
        rows.update({("ordinary", a + b): n for (a, b), n in pairs.pairs.items()})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], ["kind", "word", "n"])


def learn(docs: DataFrame, most: int = MOST_SAMPLED) -> Grammar:
    """Automata from about ``most`` documents with labelled credentials and as many others, chosen by their id's hash.

    Formats are counted in Spark; the ``most`` commonest of each kind come to the driver, ties by text. Ordinary runs,
    those off the base spans, are counted whole as pairs of classes. No credential to learn from gives a grammar that adds no span.
    """
    marked = docs.select("doc_id", "text", F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]").alias("marked"))
    sizes = {r["marked"]: r["n"] for r in marked.groupBy("marked").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("marked"), F.lit(min(1.0, most / max(1, sizes.get(True, 0))))).otherwise(F.lit(min(1.0, most / max(1, sizes.get(False, 0)))))
    some = marked.where((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)) & F.col("text").isNotNull())
    words = stage(some.select("text").mapInArrow(_labelled, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "formats")
    labelled: dict[str, Counter[str]] = {}
    for kind in KINDS[:3]:
        for r in words.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(most).collect():
            labelled.setdefault(kind, Counter())[r["word"]] = r["n"]
    ordinary = Ordinary(Counter())
    for r in words.where("kind = 'ordinary'").collect():
        ordinary.add(*r["word"], r["n"])
    return Grammar(labelled, ordinary)


def scan(docs: DataFrame, grammar: Grammar, least: float = LEAST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans) of each row's whole text.

    Offsets are code points, ends exclusive. Null and empty texts have no span (the digest of empty
    text). Base spans of different kinds may overlap and all stay; grammar spans overlap none. Repeated
    rows and null ids are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text, g, least) if text else []
                n = Counter(k for _, _, k in found)
                said = [f"{k}:{s}:{e}" for s, e, k in found]
                base = ",".join(x for x in said if not x.startswith("grammar"))
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], OUT_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


OUT_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans; see ``learn`` and ``scan`` for
    null and empty texts, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE: dict[str, str] = {}
