"""Best-fit decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cohort.llm.textops import release
from cohort.sizing import checkpoint

CAPACITY = 2048
#: Rows that one task numbers at most, about.
PER_PART = 20_000
#: Text that is tokenised at once.
BLOCK_BYTES = 3_000_000

#: Characters whose lower case depends on others, and marks that join the character before them.
CONTEXTUAL = r"[\x{0130}\x{03a3}\x{0300}-\x{036f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}]|<\|"
#: Small letters that the tokenizer keeps as they are.
SMALL = "a-zß-öø-ÿ"
#: A small letter and the sign or digit after it, which the tokenizer splits from it.
LETTER_END = f"([{SMALL}])([!-@\\[-`{{-~])"


class WordIds:
    """Token ids of texts by way of their blank-separated words.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its
    words in turn; and it splits letters from signs and digits, so a blank between them changes nothing and
    makes for fewer words. Words are kept once they are known, up to ``limit`` words; then all are dropped.
    """

    MARK = "|"

    def __init__(self, path: str | None, limit: int = 400_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        (self.mark,) = self._ids(self.MARK)
        self.small = re.compile(f"[{SMALL}]+")
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {i: spell(chr(i))[0][0] for i in range(128, 256) if self.small.fullmatch(chr(i))}
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.begin, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: pa.Array) -> None:
        """Add new words: those of small letters alone go to the tokenizer's model, which gets others in its parts.

        Of the others, those without the mark are encoded together, a thousand at a time, with marks between.
        """
        tokenize, small, spelt = self.tokenizer.model.tokenize, self.small.fullmatch, self.spelt
        ids, plain, odd = {}, [], []
        for word in words.to_pylist():
            if small(word):
                ids[word] = [t.id for t in tokenize(word if word.isascii() else word.translate(spelt))]
            else:
                ids[word] = []  # keeps the order
                (odd if self.MARK in word else plain).append(word)
        for block in (plain[i : i + 1000] for i in range(0, len(plain), 1000)):
            text = f" {self.MARK} ".join(block)
            (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            got = got.ids
            at = [-1, *(i for i, x in enumerate(got) if x == self.mark), len(got)]
            if len(at) != len(block) + 1:  # a special token's text, or another sign that becomes the mark
                odd += block
            else:
                ids.update((w, got[a + 1 : b]) for w, a, b in zip(block, at, at[1:]))
        ids.update((w, self._ids(w)) for w in odd)
        length = np.fromiter(map(len, ids.values()), np.int64, len(ids))
        pool = np.fromiter(chain.from_iterable(ids.values()), np.uint32, int(length.sum()))
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(length) - length)
        self.length, self.pool = np.append(self.length, length), np.append(self.pool, pool)
        self.known = pa.concat_arrays([self.known, words])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        ids, lengths = self.flat(texts)
        return np.split(ids, np.cumsum(lengths)[:-1])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.known) > self.limit:
            self._clear()
        # lower case first means fewer words; it is the tokenizer's own, but for signs that look to their neighbours
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lowered = pc.replace_substring_regex(pc.utf8_lower(texts), LETTER_END, r"\1 \2")
        lowered = pc.if_else(pc.match_substring_regex(texts, CONTEXTUAL), texts, lowered)
        split = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        entry = pc.index_in(words.dictionary, value_set=self.known)
        new = words.dictionary.filter(entry.is_null())
        entry = entry.fill_null(-1).to_numpy().astype(np.int64)
        entry[entry < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self._learn(new)
        at = entry[words.indices.to_numpy()]
        n = self.length[at]
        ends = np.cumsum(n)
        ids = self.pool[np.arange(int(n.sum())) + np.repeat(self.begin[at] - (ends - n), n)]
        # where each text's last word ends
        cuts = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(cuts)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise documents and cut those longer than a sequence: doc_id, piece, start, length, ids_crc32.

    A document is its ids and an end mark 0; a null or empty text is the end mark alone. Texts are handled a
    few megabytes at a time.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size) // BLOCK_BYTES
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(begins, np.append(begins[1:], len(group))):
                part = batch.slice(a, b - a)
                ids, own = encode.flat(part.column("text"))
                own = own + 1  # and the end mark
                ends = np.cumsum(own)
                buffer = np.zeros(ends[-1], "<u4")
                buffer[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own - 1)] = ids
                count = -(-own // capacity)
                at = np.repeat(np.arange(len(own)), count)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(own[at] - start, capacity)
                view, first = memoryview(buffer).cast("B"), (ends - own)[at] + start
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist())]
                columns = [pa.array(x, k) for x, k in zip((piece, start, length, crc), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *columns], names)
        del encode
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class RoomTree:
    """Segment tree over the remaining capacities of open bins; each leaf counts the bins with that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open bin has, in logarithmic time."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[length]`` equal pieces of each length, longest first, each into the tightest open bin.

    Equal pieces meet equal bins many times over, so they are placed a run at a time; the packing is the one
    that placing them singly gives. Returns runs (length, first rank, number, first bin, pieces a bin,
    offset): piece ``first rank + i`` goes to bin ``first bin + i // pieces a bin``. A bin's room at least
    halves with each visit, so there are at most about 45 runs a length, whatever the number of pieces.
    """
    tree, groups, runs, bins = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            groups.setdefault(room, []).append((first, number))
            tree.add(room, number)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, number = bins, -(-left // each)
                bins += number
            else:
                first, number = groups[room].pop()
                tree.add(room, -number)
                each = room // length
            full = min(number, left // each)
            used = full * each
            put(room - each * length, first, full)
            rest = left - used if full < number else 0
            if rest:  # fewer than fill a bin
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), number - full - (rest > 0))
            runs.append((length, rank, used + rest, first, each, capacity - room))
            rank, left = rank + used + rest, left - used - rest
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only the counts of
    the at most ``capacity`` different lengths reach the driver, and the plan of runs that goes back to the
    tasks is as bounded. Pieces of one length are numbered in parts, so that a length which a third of all
    rows share is spread over many tasks. Repeated rows are packed like any other; an empty table gives no
    rows; other columns are left out.
    """
    cut = checkpoint(pieces(docs, capacity, tokenizer))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    parts = max(1, max(counts.values(), default=0) // PER_PART)
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("length", "_part")
        .count()
        .select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    runs = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch.pop("_rank") + batch.pop("_before")).to_numpy(np.int64)
            length = batch["length"].to_numpy(np.int64)
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            within = rank - run[:, 1]
            yield batch.assign(sequence_id=run[:, 3] + within // run[:, 4], offset=run[:, 5] + within % run[:, 4] * length)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, "_rank", "_before").mapInPandas(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
