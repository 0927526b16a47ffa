"""Toxicity: a bidirectional GRU with attention pooling over overlapping windows, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.textops import ALPHANUMERIC, hash_spans, mix, release, U64, word_spans

#: Words of a window, and how far the next one begins after it.
WINDOW, STRIDE = 24, 12
HIDDEN, INPUT = 12, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 13
#: Bounds of the sample that the network is fitted on: labelled rows of each class, and bytes of a row's text.
TOXIC_ROWS, CLEAN_ROWS, TEXT_BYTES = 1500, 3000, 20_000
BLOCK_BYTES = 1_000_000
#: Training steps that small samples get as well.
STEPS = 400


class Words:
    """The words of some texts: distinct ones with their features, and each text's words as their numbers."""

    def __init__(self, texts: list[str | None]) -> None:
        joined = "\n".join(t or "" for t in texts).lower().encode("utf-8", "replace")
        data = np.frombuffer(joined, np.uint8)
        begin, end = word_spans(data, ALPHANUMERIC)
        size = np.array([len((t or "").lower().encode("utf-8", "replace")) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(begin, np.append(0, np.cumsum(size)))  # each text's first word
        hashes, at, self.word = np.unique(hash_spans(data, begin, end), return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        self.row = (hashes % U64(WORD_ROWS)).astype(np.int32)
        # letters in threes, with the word's edges (letters: how many such parts a word has)
        clear = np.zeros(len(data) + 2, np.uint8)
        clear[1:-1] = np.where(ALPHANUMERIC[data], data, 0)
        begin, self.letters = begin[at], end[at] - begin[at]
        stop = np.cumsum(self.letters)
        place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - self.letters), self.letters)
        three = clear[place].astype(U64) << U64(16) | clear[place + 1].astype(U64) << U64(8) | clear[place + 2].astype(U64)
        # and each word's beginning
        start = np.zeros(len(begin), np.uint64)
        for k in range(6):
            start = start << U64(8) | np.where(self.letters > k, clear[np.minimum(begin + 1 + k, len(data))], 0).astype(U64)
        char = np.insert(three, stop, start | U64(1 << 60))
        self.char = (mix(char) % U64(CHAR_ROWS)).astype(np.int32)
        self.letters = self.letters + 1
        self.char_at = np.cumsum(self.letters) - self.letters

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window x WINDOW) word numbers, -1 beyond a text's end, and each window's text. Every word is in one."""
        n = np.diff(self.first)
        first = self.first.astype(np.int32)
        count = np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), 1) * (n > 0)
        text = np.repeat(np.arange(len(n)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = (first[:-1][text] + STRIDE * step.astype(np.int32))[:, None] + np.arange(WINDOW, dtype=np.int32)
        inside = at < first[1:][text][:, None]
        at *= inside
        return np.where(inside, self.word[at] if len(self.word) else np.int32(-1), np.int32(-1)), text


def _parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "word": draw(WORD_ROWS, INPUT, scale=0.05),
        "char": draw(CHAR_ROWS, INPUT, scale=0.3),
        "into": draw(2, INPUT, 3 * HIDDEN, scale=INPUT**-0.5),
        "bias": np.zeros((2, 3 * HIDDEN), np.float32),
        "back": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "focus": draw(2 * HIDDEN, scale=0.3),
        "out": draw(2 * HIDDEN, scale=0.3),
        "base": np.zeros(1, np.float32),
    }


def _inputs(p: dict, words: Words, some: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Vectors of the distinct words ``some``: the word's own and the mean of its letter threes."""
    n = words.letters[some]
    stop = np.cumsum(n)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(words.char_at[some] - (stop - n), n)
    chars = words.char[at]
    mean = np.add.reduceat(p["char"][chars], stop - n) / n[:, None] if len(n) else np.zeros((0, INPUT), np.float32)
    return (p["word"][words.row[some]] + mean).astype(np.float32), (chars, n)


def _run(p: dict, known: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows. ``known``: projected words (2 x words+1 x 3H), the last one for places beyond the end."""
    rows, h = len(index), HIDDEN
    states = np.empty((WINDOW, rows, 2 * h), np.float32)
    for way in range(2):
        state, back = np.zeros((rows, h), np.float32), p["back"][way]
        for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
            x = known[way].take(index[:, t], axis=0)
            u = state @ back
            gates = np.tanh((x[:, : 2 * h] + u[:, : 2 * h]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            r, z = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep is not None:
                keep.append((way, t, state, r, z, new, u[:, 2 * h :]))
            state = new + z * (state - new)
            states[t, :, way * h : (way + 1) * h] = state
    focus = np.where(index.T == known.shape[1] - 1, np.float32(-1e9), states @ p["focus"])
    share = np.exp(focus - focus.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    if keep is not None:
        keep.append((states, share, pooled))
    return pooled @ p["out"] + p["base"][0]


def _project(p: dict, x: np.ndarray) -> np.ndarray:
    x = np.vstack([x, np.zeros((1, INPUT), np.float32)])
    return np.stack([x @ p["into"][w] + p["bias"][w] for w in range(2)])


def logits(p: dict, words: Words, windows: np.ndarray, block: int = 4096) -> np.ndarray:
    known = _project(p, _inputs(p, words, np.arange(len(words.row)))[0])
    index = np.where(windows < 0, known.shape[1] - 1, windows)
    return np.concatenate([np.zeros(0, np.float32), *(_run(p, known, index[i : i + block]) for i in range(0, len(index), block))])


def _step(p: dict, words: Words, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of some windows (back-propagation through time)."""
    some, inverse = np.unique(windows, return_inverse=True)
    inverse = inverse.reshape(windows.shape)
    pad = int(some[0] == -1)
    some = some[pad:]
    index = np.where(windows < 0, len(some), inverse - pad)
    x, (chars, n) = _inputs(p, words, some)
    known, keep, h = _project(p, x), [], HIDDEN
    logit = _run(p, known, index, keep)
    states, share, pooled = keep.pop()
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = (1 / (1 + np.exp(-logit)) - target).astype(np.float32) / len(target)
    g["base"][0], g["out"] = d.sum(), pooled.T @ d
    d_pooled = d[:, None] * p["out"]
    d_share = np.einsum("nh,tnh->tn", d_pooled, states)
    d_focus = share * (d_share - (share * d_share).sum(0))
    g["focus"] = np.einsum("tn,tnh->h", d_focus, states)
    d_states = share[:, :, None] * d_pooled + d_focus[:, :, None] * p["focus"]
    d_known, d_state = np.zeros_like(known), None
    for way, t, state, r, z, new, u in reversed(keep):
        if d_state is None or t == (WINDOW - 1 if way == 0 else 0):
            d_state = np.zeros_like(state)
        d_state = d_state + d_states[t, :, way * h : (way + 1) * h]
        d_new = d_state * (1 - z) * (1 - new * new)
        d_r, d_z = d_new * u * r * (1 - r), d_state * (state - new) * z * (1 - z)
        d_x = np.hstack([d_r, d_z, d_new])
        d_u = np.hstack([d_r, d_z, d_new * r])
        g["back"][way] += state.T @ d_u
        np.add.at(d_known[way], index[:, t], d_x)
        d_state = d_state * z + d_u @ p["back"][way].T
    d_word = np.zeros_like(x)
    for way in range(2):
        g["bias"][way] = d_known[way].sum(0)
        g["into"][way] = x.T @ d_known[way][:-1]
        d_word += d_known[way][:-1] @ p["into"][way].T
    np.add.at(g["word"], words.row[some], d_word)
    np.add.at(g["char"], chars, np.repeat(d_word / n[:, None].astype(np.float32), n, axis=0))
    return g


def _pairs(owner: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, item) pairs; items are below ``n``."""
    key = np.sort(owner.astype(np.int64) * n + item)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key // n, key % n


def _odds(owner: np.ndarray, item: np.ndarray, n: int, toxic: np.ndarray) -> np.ndarray:
    """Log odds of each item to occur in a toxic text, by the number of texts that have it (pairs are distinct)."""
    bad = np.bincount(item, weights=toxic[owner], minlength=n) + 1.0
    good = np.bincount(item, weights=1 - toxic[owner], minlength=n) + 1.0
    return np.log(bad / toxic.sum()) - np.log(good / (1 - toxic).sum())


def _telling_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """A first guess of how telling each distinct word is: by its own odds and those of its most telling letters.

    The last entry stands for places beyond a text's end.
    """
    owner, word = _pairs(np.repeat(np.arange(len(toxic)), np.diff(words.first)), words.word, len(words.row))
    own = _odds(owner, word, len(words.row), toxic)
    found = []
    cuts = np.searchsorted(owner, np.arange(0, len(toxic) + 300, 300))
    for a, b in zip(cuts, cuts[1:]):  # some texts at a time
        n = words.letters[word[a:b]]
        stop = np.cumsum(n)
        at = np.repeat(words.char_at[word[a:b]] - (stop - n), n) + np.arange(n.sum())
        found.append(_pairs(np.repeat(owner[a:b], n), words.char[at], CHAR_ROWS))
    char = _odds(*(np.concatenate(x) for x in zip(*found)), CHAR_ROWS, toxic)
    return np.append(np.maximum(1.5 * own, own / 2 + np.maximum.reduceat(char[words.char], words.char_at)), -99)


def train(texts: list[str], toxic: list[int], epochs: int = 6, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Fit the network on whole labelled texts.

    A label holds for some window of the text, not for all: a toxic text is represented by its most toxic
    window, first by the odds of its words and then by the network itself; a clean one by its worst and by
    random windows. In half of the windows most words but the most telling one are exchanged for words of clean
    texts, so that the network does not learn its sample by heart. Toxic texts without words or letters
    that others share are left out, since such labels are mistakes or can't be learned from. Adam on batches of 128 windows, for ``epochs`` epochs or at least ``STEPS`` steps. Last,
    scores of whole texts are calibrated.
    """
    rng, toxic = np.random.default_rng(seed), np.asarray(toxic, float)
    words = Words(texts)
    windows, text = words.windows()
    p = _parameters(rng)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    telling = _telling_words(words, toxic)
    guess, steps = telling[windows].max(1), 0
    # what a word and letters say that three toxic texts share and no clean one has
    enough = 1.5 * np.log(4 * (1 - toxic).sum() / toxic.sum())
    evidence = np.full(len(toxic), -99.0)
    np.maximum.at(evidence, text, guess)
    trusted = (toxic == 0) | (evidence >= enough)
    if not trusted[toxic == 1].any():
        trusted[:] = True
    # words of clean texts, to put in the place of others
    other = words.word[np.repeat(toxic == 0, np.diff(words.first))]
    epochs = max(epochs, -(-STEPS * 128 // max(1, 2 * len(texts))))
    for epoch in range(epochs):
        order = np.lexsort((guess, text))
        worst = order[np.append(text[order][1:] != text[order][:-1], True)]
        worst = worst[trusted[text[worst]]]
        some = rng.choice(len(windows), min(len(windows), 3 * len(worst)), replace=False)
        chosen = np.concatenate([worst, some[toxic[text[some]] == 0]])
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), 128):
            batch = chosen[at : at + 128]
            steps += 1
            some = windows[batch].copy()
            swap = (rng.random(some.shape) < rng.choice([0.0, 0.6], (len(some), 1))) & (some >= 0)
            swap[np.arange(len(some)), telling[some].argmax(1)] = False
            some[swap] = rng.choice(other, int(swap.sum()))
            for k, g in _step(p, words, some, toxic[text[batch]]).items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p[k] -= (rate * 0.12 ** (epoch / epochs)) * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-8)
        # the network itself picks the windows from the second of six parts on
        if (epoch + 1) * 6 // epochs > max(1, epoch * 6 // epochs):
            guess = logits(p, words, windows)
    top = np.full(len(toxic), -20.0)
    np.maximum.at(top, text, logits(p, words, windows))
    # one-dimensional logistic fit of the label on the greatest logit, by Newton's method with a weak prior
    scale, shift = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(scale * top + shift, -30, 30)))
        w = q * (1 - q) + 1e-6
        grad = np.array([(top * (q - toxic)).sum() + 0.05 * (scale - 1), (q - toxic).sum() + 0.05 * shift])
        hess = np.array([[(w * top * top).sum() + 0.05, (w * top).sum()], [(w * top).sum(), w.sum() + 0.05]])
        scale, shift = np.array([scale, shift]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return p | {"calibration": np.array([max(scale, 0.1), shift])}


def score_texts(p: dict, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text: that of its most toxic window; 0 for texts without words."""
    words = Words(texts)
    windows, text = words.windows()
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, logits(p, words, windows))
    scale, shift = p["calibration"]
    return np.where(np.isinf(top), 0.0, 1 / (1 + np.exp(-np.clip(scale * np.maximum(top, -1e3) + shift, -40, 40))))


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether a row is kept out of training."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, **options) -> dict[str, np.ndarray] | float:
    """Train on a bounded sample of the labelled rows that aren't held out; see the bounds above.

    Rows are drawn by a hash of their id. If the sample lacks a class there is nothing to tell apart: the
    share of toxic rows is returned instead (0 without any).
    """
    usable = labels.filter(~held_out()).filter("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct()
    drawn = [
        usable.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for kind, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    drawn = drawn[0].union(drawn[1])  # bounded, hence broadcast
    sample = (
        docs.select("doc_id", "text")
        .filter(F.octet_length("text").between(1, TEXT_BYTES))
        .join(F.broadcast(drawn), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TOXIC_ROWS + CLEAN_ROWS)
        .select("text", F.col("toxic").cast("int").alias("toxic"))
        .coalesce(1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        fitted = {"share": np.array(np.mean(toxic) if toxic else 0.0)}
        if len(set(toxic)) == 2:
            fitted = train(texts, toxic, **options)
        rows = [(k, v.dtype.str, list(v.shape), v.tobytes()) for k, v in fitted.items()]
        release()
        kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["name", "kind", "shape", "data"])

    # the sample is bounded, so one task holds it; only the parameters reach the driver
    rows = sample.mapInArrow(run, "name string, kind string, shape array<int>, data binary").collect()
    fitted = {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in rows}
    return fitted if "word" in fitted else float(fitted.get("share", 0.0))


def _blocks(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts in blocks of about ``BLOCK_BYTES``."""
    block, size = [], 0
    for text in column.to_pylist():
        block.append(text)
        size += len(text or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scores(model, column: pa.Array) -> np.ndarray:
    parts = [np.full(len(b), model) if isinstance(model, float) else score_texts(model, b) for b in _blocks(column)]
    return np.concatenate([np.zeros(0), *parts])


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of every row.

    A text's words are cut into windows of 24 that overlap by half; all are scored and the worst one counts,
    so length does not hide anything. Null and empty texts, and those without letters or digits, score 0.
    Repeated rows give repeated rows; other columns are left out. One pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(model, batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])
        release()

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """The rows that score below 0.5, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) < 0.5))
        release()

    return docs.mapInArrow(run, docs.schema)
