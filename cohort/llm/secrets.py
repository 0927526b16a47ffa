"""Secrets: base patterns, and grammars inferred from what these label.

The values that base patterns label as credentials, and the other tokens as a background, are each made a prefix
tree of character classes with counts. States whose endings and continuations are statistically compatible are
merged, the whole subtree with them, until a probabilistic automaton is left; its states also learn which
characters stand for a class. Every token of every text is then scored by its likelihood under the automata of
the kinds against that of the background, and counts as a secret if the odds, with the share of secrets among all
tokens as a prior, are high enough.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.textops import word_spans
from cohort.sizing import checkpoint

KINDS = ("assign", "access", "hex")
OTHER = "other"

# The base patterns. Longest runs of a fixed least length are the same matches as runs measured after.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LONG_ENOUGH = 8
KEYWORDS = (b"passw", b"secret", b"token", b"api")

#: Tokens that are scored: runs of these, at least so long.
TOKEN_BYTES = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_.-") for b in range(256)])
LEAST = 16
#: One or two equals signs at the end of a token.
PADDING = re.compile(r"={1,2}(?![A-Za-z0-9+/_.=-])")
#: Examples of each kind that an automaton is inferred from (those of smallest digest), and their greatest length.
EXAMPLES, LONGEST = 2_000, 200
#: Without so many different examples a kind has no grammar.
FEWEST = 8
#: Chance of taking equal frequencies for different ones.
ALPHA = 0.05
#: Probability kept for what was never seen.
UNSEEN = 1e-4
#: A token is a secret if its odds are at least these.
ODDS = 99.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind as listed. Failing matches are dropped."""
    return [(a, k, b) for a, k, b, _ in _labelled(text or "", None)]


def _labelled(text: str, data: np.ndarray | None) -> list[tuple[int, int, int, str]]:
    """Base spans with the credential that each labels."""
    out = []
    raw = text.encode("utf-8", "replace") if data is None else data.tobytes()
    lower = _LOWER[np.frombuffer(raw, np.uint8)].tobytes()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LONG_ENOUGH]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    if len(raw) >= 32 and _has_hex(np.frombuffer(raw, np.uint8)):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


_HEX_BYTES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])


def _has_hex(data: np.ndarray) -> bool:
    starts, ends = word_spans(data, _HEX_BYTES)
    return bool(len(starts)) and int((ends - starts).max()) >= 32


def _tokens(text: str, data: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at least LEAST token characters, without points around them and with the signs that pad them, in code points."""
    starts, ends = word_spans(data, TOKEN_BYTES)
    some = np.flatnonzero(ends - starts >= LEAST)
    if not len(some):
        return []
    starts, ends = starts[some], ends[some]
    if len(text) != len(data):  # bytes that begin no character
        tails = np.cumsum((data & 0xC0) == 0x80)
        moved = tails[starts - 1] * (starts > 0)
        starts, ends = starts - moved, ends - moved
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        run = text[a:b]
        padded = PADDING.match(text, b)
        a, b = a + len(run) - len(run.lstrip(".")), padded.end() if padded else a + len(run.rstrip("."))
        if b - a >= LEAST:
            out.append((a, b))
    return out


def _free(tokens: list[tuple[int, int]], spans: list) -> list[tuple[int, int]]:
    """Tokens that touch no span."""
    return [(a, b) for a, b in tokens if not any(a < s[2] and s[0] < b for s in spans)]


def examples(docs: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """Labelled credentials and other tokens of all texts: kind, value, and ``total``, the kind's number of tokens.

    Per kind the ``limit`` distinct values of smallest digest; every task passes on no more than these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[bytes, str]] = defaultdict(dict)
        totals: dict[str, int] = defaultdict(int)

        def shrink(kind: str) -> None:
            kept[kind] = dict(sorted(kept[kind].items())[:limit])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                spans = _labelled(text, data)
                found = [(KINDS[k], value) for _, k, _, value in spans]
                found += [(OTHER, text[a:b]) for a, b in _free(_tokens(text, data), spans)]
                for kind, value in found:
                    totals[kind] += 1
                    if len(value) <= LONGEST:
                        kept[kind][hashlib.blake2b(value.encode(), digest_size=8).digest()] = value
                        if len(kept[kind]) > 2 * limit:
                            shrink(kind)
        rows = []
        for kind in totals:
            shrink(kind)
            rows += [(kind, v, d, 0) for d, v in kept[kind].items()] + [(kind, None, None, totals[kind])]
        columns = list(zip(*rows)) or [[]] * 4
        types = [pa.string(), pa.string(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "value", "digest", "seen"])

    found = docs.select("text").mapInArrow(run, "kind string, value string, digest binary, seen long")
    found = checkpoint(found.groupBy("kind", "value", "digest").agg(F.sum("seen").alias("seen")))
    totals = found.filter("value is null").groupBy("kind").agg(F.sum("seen").alias("total"))
    values = found.filter("value is not null")
    first = [values.filter(F.col("kind") == kind).orderBy("digest").limit(limit) for kind in (*KINDS, OTHER)]
    return reduce(DataFrame.union, first).join(totals, "kind").select("kind", "value", "total")


def shape(c: str) -> str:
    """The class of a character: hexadecimal or further letters of either case, digits; others stand for themselves."""
    if c.isdigit() or "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "F":
        return "H"
    return "U" if "G" <= c <= "Z" else c


class PrefixTree:
    """Counts of the strings that reach a state, end in it, and go on from it by a class of characters."""

    def __init__(self, values: list[str]) -> None:
        self.ends, self.next, self.went, self.letters = [0], [{}], [{}], [{}]
        for value in values:
            at = 0
            for c in value:
                s = shape(c)
                if s not in self.next[at]:
                    self.next[at][s] = len(self.ends)
                    for part in (self.next, self.went, self.letters):
                        part.append({})
                    self.ends.append(0)
                self.went[at][s] = self.went[at].get(s, 0) + 1
                held = self.letters[at].setdefault(s, {})
                held[c] = held.get(c, 0) + 1
                at = self.next[at][s]
            self.ends[at] += 1

    def reached(self, q: int) -> int:
        return self.ends[q] + sum(self.went[q].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether no ending or continuation from ``a`` on differs in frequency from that from ``b`` on, by Hoeffding's bound."""
        scale = math.sqrt(0.5 * math.log(2 / alpha))
        queue = [(a, b)]
        while queue:
            a, b = queue.pop()
            n, m = self.reached(a), self.reached(b)
            if not n or not m:
                continue
            limit = scale * (n**-0.5 + m**-0.5)
            if limit >= 1 and not (self.next[a].keys() & self.next[b].keys()):
                continue
            if abs(self.ends[a] / n - self.ends[b] / m) > limit:
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                if abs(self.went[a].get(s, 0) / n - self.went[b].get(s, 0) / m) > limit:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    queue.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the subtree ``b`` to the state ``a``."""
        queue = [(a, b)]
        while queue:
            a, b = queue.pop()
            self.ends[a] += self.ends[b]
            for s, n in self.went[b].items():
                self.went[a][s] = self.went[a].get(s, 0) + n
                held = self.letters[a].setdefault(s, {})
                for c, k in self.letters[b][s].items():
                    held[c] = held.get(c, 0) + k
                if s in self.next[a]:
                    queue.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]


def infer(values: list[str], alpha: float = ALPHA) -> dict:
    """A probabilistic automaton: the prefix tree of ``values`` with compatible states merged, as plain lists.

    States are settled in the order in which strings meet them; a state that is compatible with a settled one is
    folded into it, others are settled themselves.
    """
    tree = PrefixTree(sorted(values))
    settled, waiting, where = [0], [(0, s) for s in sorted(tree.next[0])], {0}
    while waiting:
        # the most frequent transition first: its state has the best estimates
        waiting.sort(key=lambda p: (-tree.went[p[0]][p[1]], p))
        q, s = waiting.pop(0)
        new = tree.next[q][s]
        if new in where:
            continue
        for old in settled:
            if tree.compatible(old, new, alpha):
                tree.next[q][s] = old
                tree.fold(old, new)
                break
        else:
            settled.append(new)
            where.add(new)
        waiting = [(p, c) for p in settled for c in tree.next[p] if tree.next[p][c] not in where]
    return described(tree, settled)


def described(tree: PrefixTree, settled: list[int]) -> dict:
    """The settled states of a tree as plain lists: chance to end; per class where it leads, its chance, its characters."""
    number = {q: i for i, q in enumerate(settled)}
    letters: dict[str, dict[str, int]] = {}
    for q in settled:
        for s, held in tree.letters[q].items():
            for c, n in held.items():
                letters.setdefault(s, {})[c] = letters.get(s, {}).get(c, 0) + n
    states = []
    for q in settled:
        n = tree.reached(q)
        moves = {}
        for s, to in tree.next[q].items():
            held, every = tree.letters[q].get(s, {}), sum(letters[s].values())
            total = sum(held.values())
            # a state that has seen few characters of a class takes them from the whole automaton
            chars = {c: (held.get(c, 0) + 8 * k / every) / (total + 8) for c, k in letters[s].items()}
            moves[s] = [number[to], tree.went[q][s] / n, chars]
        states.append([tree.ends[q] / n, moves])
    return {"states": states}


class Automaton:
    """Log-likelihood of tokens under an inferred automaton; a step never seen costs a fixed share and leads to the start."""

    def __init__(self, model: dict) -> None:
        keep = math.log(1 - UNSEEN)
        self.stop, self.step = [], []
        self.miss = math.log(UNSEEN / 68)
        for ends, moves in model["states"]:
            self.stop.append(math.log(max(ends, UNSEEN)) + keep)
            row = {}
            for to, p, chars in moves.values():
                for c, share in chars.items():
                    row[c] = (to, math.log(p * share) + keep)
            self.step.append(row)

    def __call__(self, token: str) -> float:
        at, total = 0, 0.0
        for c in token:
            found = self.step[at].get(c)
            if found:
                at = found[0]
                total += found[1]
            else:
                at, total = 0, total + self.miss
        return total + self.stop[at]


def single_state(values: list[str]) -> dict:
    """The automaton of one state: characters in any order."""
    tree = PrefixTree(sorted(values))
    for q in range(len(tree.ends) - 1, 0, -1):  # children come after their parents
        tree.ends[0] += tree.ends[q]
        for s, n in tree.went[q].items():
            tree.went[0][s] = tree.went[0].get(s, 0) + n
            held = tree.letters[0].setdefault(s, {})
            for c, k in tree.letters[q][s].items():
                held[c] = held.get(c, 0) + k
    tree.next[0] = dict.fromkeys(tree.went[0], 0)
    return described(tree, [0])


def background(values: list[str], kinds: list[dict], odds: float = ODDS) -> dict:
    """The automaton of the tokens that aren't labelled, without those that follow a kind's grammar.

    Secrets without their context are among these tokens. Taken for background they would hide their like, so those
    are left out that a kind's automaton explains so much better than loose characters do.
    """
    if not values:
        return {"states": [[0.05, {}]]}
    loose, machines = Automaton(single_state(values)), [Automaton(m) for m in kinds]
    least = math.log(odds)
    plain = [v for v in values if all(machine(v) - loose(v) < least for machine in machines)]
    return infer(plain) if plain else {"states": [[0.05, {}]]}


def learn(docs: DataFrame, limit: int = EXAMPLES) -> dict:
    """Automata of the kinds and the background, and each kind's prior odds, learned from all texts.

    Counts are over all texts; each automaton is inferred from at most ``limit`` examples, in one task a kind.
    Kinds with fewer than FEWEST different examples are left out.
    """
    sample = checkpoint(examples(docs, limit))
    schema = "kind string, model string, total long, n long"

    def row(rows: pd.DataFrame, model: dict) -> pd.DataFrame:
        return pd.DataFrame({"kind": rows["kind"].iloc[:1], "model": [json.dumps(model)], "total": rows["total"].iloc[:1], "n": [len(rows)]})

    labelled = sample.filter(F.col("kind") != OTHER).groupBy("kind")
    found = labelled.applyInPandas(lambda rows: row(rows, infer(rows["value"].tolist())), schema).collect()
    models = {r.kind: json.loads(r.model) for r in found if r.n >= FEWEST}
    known = list(models.values())
    rest = sample.filter(F.col("kind") == OTHER).groupBy("kind")
    other = rest.applyInPandas(lambda rows: row(rows, background(rows["value"].tolist(), known)), schema).first()
    every = (other.total if other else 0) + 1
    prior = {r.kind: math.log(r.total / every) for r in found}
    own = json.loads(other.model) if other else background([], [])
    return {"other": own, "kinds": {k: (models[k], prior[k]) for k in KINDS if k in models}}


class Scorer:
    """The kind whose grammar a token follows, or none. Tokens met before are remembered, up to a number."""

    def __init__(self, model: dict, odds: float = ODDS, remembered: int = 100_000) -> None:
        self.other = Automaton(model["other"])
        self.kinds = [(KINDS.index(k), Automaton(m), prior) for k, (m, prior) in model["kinds"].items()]
        self.least, self.known, self.remembered = math.log(odds), {}, remembered

    def __call__(self, token: str) -> int | None:
        if not self.kinds:
            return None
        if token not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            base = self.other(token)
            score, kind = max((machine(token) - base + prior, -k) for k, machine, prior in self.kinds)
            self.known[token] = -kind if score >= self.least else None
        return self.known[token]


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = [*KINDS, *(f"like_{k}" for k in KINDS)]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, added.

    Counts and digest are of the base spans; ``spans`` holds all, those found by a grammar under ``like_`` and the
    kind whose examples it was inferred from; they never touch base spans. ``added`` is their number. A null or
    empty text has none (the digest is that of the empty string). Repeated rows give repeated rows. Other columns
    are left out.
    """
    model = learn(docs) if model is None else model
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = Scorer(model)
        for batch in batches:
            counts, digests, all_spans, added = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, more = [], []
                if text:
                    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                    base = [s[:3] for s in _labelled(text, data)]
                    for a, b in _free(_tokens(text, data), base):
                        k = like(text[a:b])
                        if k is not None:
                            more.append((a, len(KINDS) + k, b))
                counts.append([sum(s[1] == k for s in base) for k in range(len(KINDS))])
                own = joined(base)
                digests.append(hashlib.sha256(own.encode()).hexdigest())
                all_spans.append(joined(sorted(base + more)) if more else own)
                added.append(len(more))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string, added int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
