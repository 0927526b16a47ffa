"""Language identification by mixtures: language proportions per document from n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.textops import U64, mix

#: Hashed letter trigrams; the table of the model has this many rows.
ROWS = 1 << 15
#: Added to each count, so that unseen trigrams have a probability.
SMOOTHING = 0.5
ITERATIONS = 6
BLOCK_CHARS = 1_500_000

_FLAG = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _FLAG.any():
        for a in range(0, 0x110000, 1 << 12):
            _FLAG[a : a + (1 << 12)] = [chr(c).isalpha() for c in range(a, min(a + (1 << 12), 0x110000))]
    return _FLAG


class Words:
    """Runs of letters of some texts in lower case: their trigrams (with word edges) and whose they are."""

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        inside = np.append(False, _letters()[points])
        begin = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:])  # exclusive
        clear = np.zeros(len(points) + 2, np.uint64)
        clear[1:-1] = np.where(inside[1:], points, 0)
        three = clear[:-2] << U64(42) | clear[1:-1] << U64(21) | clear[2:]
        at = np.flatnonzero(inside[1:])
        self.gram = (mix(three[at]) % U64(ROWS)).astype(np.int32)  # one for each letter
        size = np.array([len(t) + 1 for t in lowered], np.int64)
        self.text = np.searchsorted(np.cumsum(size), begin, side="right")  # of each word
        length = self.end - begin
        self.length, self.start = length, np.cumsum(length) - length


def _blocks(texts: list) -> Iterator[list]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for block in _blocks(texts):
                    counts = np.bincount(Words(block).gram, minlength=ROWS)
                    total[lang] = total.get(lang, 0) + counts
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    usable = docs.filter("lang is not null and text is not null").select("text", "lang")
    return usable.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages and log probabilities of letters given the two around them (ROWS x languages)."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({r[0] for r in counts})
        number = {lang: i for i, lang in enumerate(self.langs)}
        table = np.full((ROWS, len(self.langs)), SMOOTHING)
        for lang, gram, n in counts:
            table[gram, number[lang]] += n
        self.table = np.log(table / table.sum(0)).astype(np.float32) if self.langs else table.astype(np.float32)


def fit(docs: DataFrame) -> Model:
    """Count trigrams over all given rows; the table, bounded by ROWS and the number of languages, is collected."""
    return Model([tuple(r) for r in count_grams(docs).collect()])


def _mixture(
    likelihood: np.ndarray, text: np.ndarray, n: int, share: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of all texts at once: language shares of each text, and its log likelihood.

    ``likelihood``: words x languages, scaled to 1 at most; ``share``: 0 for languages that a text must not use.
    """
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    some = text[cuts]
    for _ in range(rounds):
        joint = likelihood * share[text]
        joint /= joint.sum(1, keepdims=True)
        share[some] = np.add.reduceat(joint, cuts)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
    total = np.zeros(n)
    total[some] = np.add.reduceat(np.log((likelihood * share[text]).sum(1)), cuts)
    return share, total


def proportions(model: Model, texts: list[str | None], penalty: float = 1.0) -> np.ndarray:
    """Language shares of each text (texts x languages); all 0 for a text without letters.

    A text's words come from a mixture of languages; a word's likelihood in a language is the product of its
    trigrams' probabilities. Expectation-maximisation estimates the shares. Then the languages of a text are
    chosen by penalised likelihood: the least is left out as long as this costs less than
    ``penalty * log(words) / 2``, and shares are estimated anew.
    """
    n, k = len(texts), len(model.langs)
    words = Words(texts)
    if not len(words.length) or not k:
        return np.zeros((n, k))
    log = np.add.reduceat(model.table[words.gram], words.start).astype(np.float64)
    # likelihoods relative to the best language, with a floor that keeps every language possible
    likelihood = np.exp(np.maximum(log - log.max(1, keepdims=True), -40.0))
    count = np.bincount(words.text, minlength=n)
    share = np.repeat(np.where(count > 0, 1.0 / k, 0.0)[:, None], k, axis=1)
    share, total = _mixture(likelihood, words.text, n, share, ITERATIONS)
    cost = penalty * np.log(np.maximum(count, 2)) / 2
    open_texts = count > 0
    for _ in range(k - 1):
        rows = np.flatnonzero(open_texts & ((share > 0).sum(1) > 1))
        if not len(rows):
            break
        least = np.where(share[rows] > 0, share[rows], np.inf).argmin(1)
        fewer = share[rows].copy()
        fewer[np.arange(len(rows)), least] = 0
        fewer /= np.maximum(fewer.sum(1, keepdims=True), 1e-30)
        number = np.full(n, -1)
        number[rows] = np.arange(len(rows))
        mine = number[words.text] >= 0
        fewer, without = _mixture(likelihood[mine], number[words.text[mine]], len(rows), fewer, 2)
        better = total[rows] - without < cost[rows]
        share[rows[better]], total[rows[better]] = fewer[better], without[better]
        open_texts[rows[~better]] = False
    return share


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept out of training."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % folds == fold


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and shares of every row, from its whole text alone.

    ``languages`` are those of the chosen set, greatest share first, with their ``shares``; ``lang_pred`` is the
    first and ``score`` its share. A null text, one without letters, and any text if nothing was learned are
    ``und`` with score 0. Equal shares go by name. Repeated rows give repeated rows; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in _blocks(batch.column("text").to_pylist()):
                share = proportions(model, block)
                order = np.argsort(-share, axis=1, kind="stable")
                for s, o in zip(share, order):
                    used = [i for i in o if s[i] > 0]
                    langs = [model.langs[i] for i in used]
                    rows.append((langs[0] if used else "und", float(min(s[used[0]], 1)) if used else 0.0, langs, [float(s[i]) for i in used]))
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names
            )

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>",
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all rows."""
    return predict(docs, fit(docs.filter(~held_out())))
