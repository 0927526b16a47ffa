"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.textops import ALPHANUMERIC, U64, distinct, grams, hash_spans, word_spans

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: So many words of an item, or all if it has fewer, must be matched besides the share: one phrase is no copy.
MATCHED = 8
#: Bytes of benchmark text that are matched in one pass over the documents; more items mean more passes.
BLOCK_BYTES = 4_000_000


def _words(text: str | None) -> np.ndarray:
    """Numbers of the words of a text: runs of letters and digits in lower case, so punctuation can differ."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return hash_spans(data, *word_spans(data, ALPHANUMERIC))


def align(query: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: score and where it ends in ``text`` (exclusive).

    Smith-Waterman with linear gaps. A row is computed as a whole: a gap along the row is a running maximum
    of scores that are raised by the cost of the way.
    """
    slope = -GAP * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in query:
        step = np.zeros(len(text) + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align_words(query: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int]:
    """As ``align``, over the alignments with at least so many matches; 0 if there is none.

    Row k of the table holds the alignments with k matches so far, the last row those with ``least`` or more.
    """
    slope = -GAP * np.arange(len(text) + 1)
    rows, best, end = np.full((least + 1, len(text) + 1), -(1 << 40)), 0, 0
    rows[0] = 0
    for word in query:
        step = rows + GAP
        np.maximum(step[:, 1:], rows[:, :-1] + MISMATCH, out=step[:, 1:])
        more = np.vstack([np.full((1, len(text)), -(1 << 40)), rows[:-1, :-1]])
        more[-1] = np.maximum(more[-1], rows[-1, :-1])
        np.maximum(step[:, 1:], more + MATCH, out=step[:, 1:], where=text == word)
        np.maximum(step[0], 0, out=step[0])
        rows = np.maximum.accumulate(step + slope, axis=1) - slope
        top = int(rows[-1].argmax())
        if rows[-1, top] > best:
            best, end = int(rows[-1, top]), top
    return best, end


def _hits(length: int, threshold: float) -> int:
    """So many neighbours (see ``pairs``) every alignment that reaches the threshold has in common, at distinct places.

    With m matches and e errors, 2 m - e >= 2 * threshold * length and m <= length. Of the m - 1 steps from a
    match to the next at most e / 2 hold two errors or more.
    """
    return math.ceil(threshold * length - 1e-9) - 1


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of neighbours and of all pairs with one word between, with the place of the first.

    Two matches with at most one error between them are such a pair both in the item and in the document.
    """
    if len(words) < 3:
        return grams(words, 2), np.arange(max(len(words) - 1, 0))
    outer = np.stack([words[:-2], words[2:]], 1).ravel()
    keys = np.concatenate([grams(words, 2), grams(outer, 2)[::2]])
    return keys, np.concatenate([np.arange(len(words) - 1), np.arange(len(words) - 2)])


def _windows(starts: np.ndarray, length: int, size: int, slack: int) -> list[tuple[int, int]]:
    """Stretches of the document around seeds. ``starts``: where each seed would have the item begin."""
    lo = np.maximum(np.sort(starts) - slack, 0)
    out: list[list[int]] = []
    for a in lo.tolist():
        b = min(a + length + 2 * slack, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def best_match(item: np.ndarray, words: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[float, int, int]:
    """Greatest share of the item's own score that a stretch reaches; first and last (exclusive) word of it.

    A stretch with too few pairs of the item for the threshold is not aligned. Where the threshold can be reached
    with fewer than ``MATCHED`` words, only alignments with so many (or all) words of the item count.
    """
    best, best_of = (0.0, 0, 0), align
    if math.ceil(len(item) * threshold - 1e-9) < (least := min(len(item), MATCHED)):
        best_of = lambda query, text: align_words(query, text, least)
    keys, places = pairs(item)
    # no alignment that reaches the threshold has more errors than this
    slack = max(math.ceil(2 * len(item) * (1 - threshold)), SEED)
    for a, b in _windows(starts, len(item), len(words), slack):
        if len(distinct(places[np.isin(keys, pairs(words[a:b])[0])])) < _hits(len(item), threshold):
            continue
        score, end = best_of(item, words[a:b])
        share = score / (MATCH * len(item))
        if share > best[0]:
            _, back = best_of(item[::-1], words[a : a + end][::-1])
            best = (share, a + end - back, a + end)
    return best


class Items:
    """The pairs of some benchmark items: sorted distinct numbers, and for each pair which it is, its item and place."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.words = {k: w for k, (_, t) in enumerate(rows) if len(w := _words(t))}
        self.ids = [rows[k][0] for k in self.words]
        # a single word is its own seed
        found = [pairs(w) if len(w) > 1 else (grams(w, 1), np.zeros(1, np.int64)) for w in self.words.values()]
        keys = np.concatenate([np.empty(0, U64), *(k for k, _ in found)])
        self.places = np.concatenate([np.empty(0, np.int64), *(p for _, p in found)])
        self.items = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        self.keys = distinct(keys)
        self.which = np.searchsorted(self.keys, keys)
        self.single = any(len(w) == 1 for w in self.words.values())


class Lookup:
    """Finds the pairs of a document that are among the wanted ones."""

    def __init__(self, wanted: np.ndarray, single: bool) -> None:
        self.wanted, self.single = wanted, single
        self.flag = np.zeros(1 << 20, bool)  # by the first 20 bits: rules nearly all pairs out
        self.flag[(wanted >> U64(44)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document, and which of the wanted pairs stands there."""
        keys, places = pairs(words)
        if self.single:
            keys, places = np.concatenate([keys, grams(words, 1)]), np.concatenate([places, np.arange(len(words))])
        at = np.flatnonzero(self.flag[(keys >> U64(44)).view(np.int64)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.wanted, keys[at]), len(self.wanted) - 1)
        same = self.wanted[which] == keys[at]
        return places[at[same]], which[same]


def _frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each pair of the items occurs, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = Lookup(keys, single), np.zeros(len(keys), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[distinct(look(_words(text))[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    keys, single = items.keys, items.single
    counted = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n"))
    out = np.zeros(len(keys), np.int64)
    for pair, n in counted.collect():  # a number for each pair of the block of items
        out[pair] = n
    return out


def rare_seeds(items: Items, frequency: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """True for the pairs (as ``items.which``) that are looked up: those at the rarest places of each item.

    Every alignment that reaches the threshold has pairs at ``_hits`` of the places, so it has one at any
    selection that leaves out fewer places than that: none is lost, however many words were replaced. A place
    whose pairs no document has is among the rarest, and the others of the selection are there for it. If the
    threshold allows no selection, all places are taken.
    """
    out = np.zeros(len(items.which), bool)
    edges = np.searchsorted(items.items, np.arange(len(items.ids) + 1))
    for k, w in enumerate(items.words.values()):
        mine = slice(edges[k], edges[k + 1])
        n = np.bincount(items.places[mine], frequency[items.which[mine]])
        rare = np.argsort(n, kind="stable")[: len(n) - max(_hits(len(w), threshold), 1) + 1]
        out[mine] = np.isin(items.places[mine], rare)
    return out & (frequency[items.which] > 0)


class Matcher:
    """Aligns a document with the items of a block around its rare seeds."""

    def __init__(self, items: Items, frequency: np.ndarray, threshold: float) -> None:
        seeds = np.flatnonzero(rare_seeds(items, frequency, threshold))
        seeds = seeds[np.argsort(items.which[seeds], kind="stable")]
        self.items, self.places = items.items[seeds], items.places[seeds]
        some = distinct(items.which[seeds])
        self.wanted, self.edges = items.keys[some], np.searchsorted(items.which[seeds], np.append(some, len(items.keys)))
        self.ids, self.words, self.single = items.ids, list(items.words.values()), items.single
        self.threshold, self.look = threshold, None

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) of each match."""
        self.look = self.look or Lookup(self.wanted, self.single)
        words, found = _words(text), []
        place, seed = self.look(words)
        if not len(place):
            return found
        # every item that has the seed
        n = self.edges[seed + 1] - self.edges[seed]
        at = np.repeat(self.edges[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, begin = self.items[at], np.repeat(place, n) - self.places[at]
        order = np.argsort(item, kind="stable")
        item, begin = item[order], begin[order]
        cuts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for k, starts in zip(item[cuts].tolist(), np.split(begin, cuts[1:])):
            # an item of fewer than three words must occur as it is
            least = self.threshold if len(self.words[k]) > 2 else 1.0
            score, first, end = best_match(self.words[k], words, distinct(starts), least)
            if score >= least:
                found.append((self.ids[k], score, first, end))
        return found


def matchers(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Matcher]:
    """One for each block of at most about ``BLOCK_BYTES`` of items, whatever the size of the benchmark."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    usable = benchmark.filter("text is not null").select("item_id", "text").distinct()
    for block in range(blocks):
        mine = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = Items([(r[0], r[1]) for r in mine.toLocalIterator()])
        if items.ids:
            yield Matcher(items, _frequencies(docs, items), threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrased or edited copy of it.

    Returns a row per pair: doc_id, item_id, score (share of the item's own alignment score, up to 1),
    first_word and end_word (the aligned words of the document, end exclusive). A document's pairs of
    words are looked up among the rare ones of all items; around its seeds the whole item is aligned. Only seeds travel: the
    items go to the tasks in blocks of bounded size, and no document is shuffled.

    Besides the share, at least ``MATCHED`` words of an item must be matched, or all words of a shorter one.
    Items without words fit nothing; an item of fewer than three words must occur whole and in order. Null
    and empty texts match nothing. Repeated documents give repeated rows; repeated item texts a row for each
    item id; an item id with several texts, or none (null), a row for each text that is matched. Empty tables give no rows; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, first_word int, end_word int"
    names = ["doc_id", "item_id", "score", "first_word", "end_word"]
    out = docs.sparkSession.createDataFrame([], schema)
    for matcher in matchers(docs, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(at, *m) for at, text in enumerate(batch.column("text").to_pylist()) for m in matcher(text)]
                at, *rest = zip(*found) if found else [()] * 5
                kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                columns = [pa.array(x, k) for x, k in zip(rest, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], names)

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a match, with all their columns. Each row is judged by its text; nothing is shuffled.

    Null and empty texts match nothing and stay. Items whose id repeats or is null count like any other.
    """
    text = docs.columns.index("text")
    for matcher in matchers(docs, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matcher(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
