"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

A shard is a run of documents that one task reads, of bounded size. Its index has one row for each term: the
postings (document and count) compressed in blocks of 128, each block's last document and its largest share of a
score, and the largest over the list. A search takes the rows of the wanted terms, shard by shard. The lists'
bounds over all shards part a query's lists: documents only in the lesser ones can't reach the score of the 20th
best so far, so only the essential lists are read through, and the block maxima of the others reject candidates
before their blocks are decompressed. The shards' best are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.textops import ALPHANUMERIC, _LOWER, hash_spans, word_spans
from cohort.sizing import checkpoint, shared_folder

#: Postings in a block.
BLOCK = 128
#: Text of a shard, about, and text that is split into terms at once.
SHARD_BYTES, SPLIT_BYTES = 16_000_000, 1_000_000
#: Queries that meet a shard at once, about.
QUERIES = 2_000
#: Terms of all queries, repeats included, up to which they go to the index instead of the index to them (16 bytes each).
BROADCAST_TERMS = 500_000
#: Documents that a search looks at between two updates of its threshold, at first and at most.
WINDOW, WIDEST = 256, 4096

TOP = 20


def _chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, about ``size`` bytes at a time, with the number of the first."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // size
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(group))):
        yield int(a), texts.slice(a, b - a).to_pylist()


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some texts as 64-bit numbers, and the number of the text each stands in."""
    data = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    starts, ends = word_spans(data, ALPHANUMERIC)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hash_spans(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def counted(terms: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, owner) pairs, by term, then owner, with their counts."""
    order = np.lexsort((owner, terms))
    terms, owner = terms[order], owner[order]
    first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1]))) if len(terms) else order
    return terms[first], owner[first], np.diff(np.append(first, len(terms)))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the top bit set on all but a value's last: the bytes, and each value's number of them."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def values_of(data: np.ndarray) -> np.ndarray:
    ends = data < 128
    if ends.all():
        return data.astype(np.int64)
    starts = np.flatnonzero(np.append(True, ends[:-1]))
    shift = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a unit of weight brings a document: (1000000000 tf) div (1000 tf + 12 m)."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


INDEX = """shard long, term long, df long, top long, last array<int>, cut array<int>, most array<long>, data binary,
    ids array<long>, m array<long>"""
_TYPES = [
    *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int64())] * 2
]
_NAMES = ["shard", "term", "df", "top", "last", "cut", "most", "data", "ids", "m"]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def shard_rows(shard: int, ids: pa.Array, lengths: np.ndarray, parts: list, n: int, total: int) -> Iterator[pa.RecordBatch]:
    """The index of one shard: a row for each term, and one of the documents with their length norms."""
    term, doc, tf = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(term, kind="stable")  # the parts are in document order
    term, doc, tf = term[order], doc[order], tf[order]
    m = 75 + 25 * lengths * n // total
    g = share(tf, m[doc])
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(first, len(term)))
    rank = np.arange(len(term)) - np.repeat(first, df)
    begins = np.flatnonzero(rank % BLOCK == 0)
    step = np.diff(doc, prepend=0)
    step[begins] = doc[begins]
    data, size = varints(np.stack([step, tf], 1).ravel())
    at = np.append(0, np.cumsum(size[::2] + size[1::2]))
    block_of = np.searchsorted(begins, first)  # each term's first block
    term_of = np.searchsorted(first, begins, side="right") - 1
    last = doc[np.append(begins[1:], len(doc)) - 1]
    offsets = np.append(at[first], at[-1]).astype(np.int32)
    columns = [
        pa.array(np.full(len(first), shard)),
        pa.array(term[first].view(np.int64)),
        pa.array(df),
        pa.array(np.maximum.reduceat(g, first)),
        _lists(last, block_of, pa.int32()),
        _lists(at[begins] - at[first][term_of], block_of, pa.int32()),
        _lists(np.maximum.reduceat(g, begins), block_of, pa.int64()),
        pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
        *[pa.nulls(len(first), pa.list_(pa.int64()))] * 2,
    ]
    yield pa.RecordBatch.from_arrays(columns, _NAMES)
    own = [[shard], [None], [None], [None], [None], [None], [None], [None], [ids.to_pylist()], [m.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(own, _TYPES)], _NAMES)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, texts in _chunks(batch.column(0), SPLIT_BYTES):
                inside = ALPHANUMERIC[np.frombuffer(b" ".join([b"", *texts]), np.uint8)]
                starts = np.flatnonzero(inside[1:] & ~inside[:-1])
                owner = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), starts, side="right")
                n, total = n + len(np.unique(owner)), total + len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents (integer doc_id, text); a user may write it as Parquet and search it later.

    Documents without a term (null and empty texts among them) are in no list. Repeated rows are documents of
    their own, a null doc_id is kept. Terms are told apart by 64-bit numbers. Other columns are left out.
    """
    n, total = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids, lengths, parts, size, held = [], [], [], 0, 0
        for batch in batches:
            for a, texts in _chunks(batch.column("text"), SPLIT_BYTES):
                term, owner = terms_of(texts)
                if not len(term):
                    continue
                here, owner = np.unique(owner, return_inverse=True)  # documents with terms
                ids.append(batch.column("doc_id").take(pa.array(here + a)))
                lengths.append(np.bincount(owner))
                term, owner, tf = counted(term, owner)
                parts.append((term, owner + held, tf))
                held, size = held + len(here), size + sum(map(len, texts))
                if size >= shard_bytes:
                    yield from shard_rows(shard, pa.concat_arrays(ids), np.concatenate(lengths), parts, n, total)
                    shard, ids, lengths, parts, size, held = shard + 1, [], [], [], 0, 0
        if parts:
            yield from shard_rows(shard, pa.concat_arrays(ids), np.concatenate(lengths), parts, n, total)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """The terms of each query (item, term, times) under a number made of its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _chunks(batch.column("text"), SPLIT_BYTES):
                term, owner, times = counted(*terms_of(texts))
                numbers = batch.column("item").take(pa.array(owner + a))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(term.view(np.int64)), pa.array(times)], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times long")


class Postings:
    """The lists of one shard; what has been decompressed is kept for the shard's other queries."""

    def __init__(self, last, cut, most, data, m) -> None:
        self.last, self.cut, self.most, self.data, self.m = last, cut, most, data, m
        self.blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.none = np.empty(0, np.int64), np.empty(0, np.int64)

    def block(self, i: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of one block."""
        if (i, b) not in self.blocks:
            cut = self.cut[i]
            end = cut[b + 1] if b + 1 < len(cut) else len(self.data[i])
            values = values_of(np.frombuffer(self.data[i], np.uint8)[cut[b] : end])
            docs = np.cumsum(values[::2])
            self.blocks[i, b] = docs, share(values[1::2], self.m[docs])
        return self.blocks[i, b]

    def span(self, i: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``begin`` to ``end`` and their shares; only the blocks that hold them are decompressed."""
        if i not in self.lists:
            a = int(np.searchsorted(self.last[i], begin))
            b = min(int(np.searchsorted(self.last[i], end - 1)) + 1, len(self.cut[i]))
            if a == b:
                return self.none
            parts = [self.block(i, k) for k in range(a, b)]
            found = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))
            if b - a == len(self.cut[i]):
                self.lists[i] = found
        else:
            found = self.lists[i]
        a, b = np.searchsorted(found[0], (begin, end))
        return found[0][a:b], found[1][a:b]


def best(lists: Postings, chosen: np.ndarray, weight: np.ndarray, top: np.ndarray, order: np.ndarray, k: int = TOP):
    """The ``k`` best documents (numbers in the shard, scores) of one query.

    ``chosen`` are its lists, ``weight`` what a share counts there, ``top`` the largest share in any shard;
    ``order`` ranks documents of equal score.
    """
    bound = weight * top
    by = np.argsort(bound, kind="stable")
    chosen, weight, upto = chosen[by], weight[by], np.cumsum(bound[by])
    docs, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
    begin, width = 0, WINDOW
    while begin < len(lists.m):
        end = min(begin + width, len(lists.m))
        width = min(2 * width, WIDEST)
        lesser = int(np.searchsorted(upto, least))  # all of these lists together stay below the least score
        if lesser == len(chosen):
            break
        sums = np.zeros(end - begin, np.int64)
        for i, w in zip(chosen[lesser:], weight[lesser:]):
            held, g = lists.span(i, begin, end)
            sums[held - begin] += w * g
        found = np.flatnonzero(sums)
        got, found = sums[found], found + begin
        if lesser:
            able = got + upto[lesser - 1] >= least
            got, found = got[able], found[able]
        if lesser and len(found):
            blocks = np.stack([np.searchsorted(lists.last[i], found) for i in chosen[:lesser]])
            rest = np.stack([w * np.append(lists.most[i], 0)[b] for i, w, b in zip(chosen, weight, blocks)])
            open_ = rest.sum(0)
            for j in range(lesser - 1, -1, -1):
                able = got + open_ >= least
                if not able.all():
                    got, found, open_, blocks, rest = got[able], found[able], open_[able], blocks[:, able], rest[:, able]
                for b in np.unique(blocks[j][rest[j] > 0]):
                    here = np.flatnonzero(blocks[j] == b)
                    held, g = lists.block(chosen[j], int(b))
                    at = np.minimum(np.searchsorted(held, found[here]), len(held) - 1)
                    got[here] += np.where(held[at] == found[here], weight[j] * g[at], 0)
                open_ = open_ - rest[j]
        able = got >= least
        docs, scores = np.append(docs, found[able]), np.append(scores, got[able])
        if len(docs) >= k:
            first = np.lexsort((order[docs], -scores))[:k]
            docs, scores = docs[first], scores[first]
            least = int(scores[-1])
        begin = end
    return docs, scores


def _search_shard(k: int):
    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table.column("term"))).to_pylist()[0]
        rows = table.filter(pc.is_valid(table.column("term"))).combine_chunks()
        ids = pa.array(own["ids"], pa.int64())
        order = np.argsort(np.argsort(pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(), kind="stable"))
        columns = [[np.array(v) for v in rows.column(c).to_pylist()] for c in ("last", "cut", "most")]
        lists = Postings(*columns, rows.column("data").to_pylist(), np.array(own["m"], np.int64))
        asked = rows.column("asked").combine_chunks()
        flat = asked.flatten()
        at = np.repeat(np.arange(len(rows)), pc.list_value_length(asked).to_numpy())
        item, times = (flat.field(c).to_numpy() for c in ("item", "times"))
        weight, top = rows.column("w").to_numpy()[at] * times, rows.column("bound").to_numpy()[at]
        by = np.argsort(item, kind="stable")
        out = [], [], []
        for some in np.split(by, np.flatnonzero(np.diff(item[by])) + 1) if len(by) else []:
            docs, scores = best(lists, at[some], weight[some], top[some], order, k)
            out[0].append(np.full(len(docs), item[some[0]]))
            out[1].append(docs)
            out[2].append(scores)
        items, docs, scores = (np.concatenate([np.empty(0, np.int64), *x]) for x in out)
        return pa.table({"item": items, "doc_id": ids.take(pa.array(docs)), "score": scores})

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, queries: int = QUERIES) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores follow the doc_id, null first. Each distinct (item_id, text) is a
    query of its own, null ids too; one without terms, or with none that a document holds, gives no rows.
    Queries meet the shards in blocks of about ``queries``; of an item's candidates each task passes on ``k``.
    """
    asked = items.select("item_id", "text").distinct()
    asked = checkpoint(asked.withColumn("item", F.xxhash64("item_id", "text")))
    blocks = max(1, -(-asked.count() // queries))
    terms = query_terms(asked)
    n = index.filter(F.col("term").isNull()).agg(F.sum(F.size("ids"))).first()[0] or 0
    lists = index.filter(F.col("term").isNotNull()).drop("ids", "m")
    found = lists.select("term", "df", "top").join(terms.select("term").distinct(), "term", "left_semi")
    weights = found.groupBy("term").agg(
        F.floor(1000 * F.log(F.lit(2 * n + 2.0) / (2 * F.sum("df") + 1))).cast("long").alias("w"), F.max("top").alias("bound")
    )
    # each term with the queries of a block that ask for it
    asking = terms.join(weights.filter("w > 0"), "term").withColumn("block", F.pmod("item", F.lit(blocks)))
    asking = checkpoint(asking.groupBy("block", "term", "w", "bound").agg(F.collect_list(F.struct("item", "times")).alias("asked")))
    if (asking.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_TERMS:
        asking = F.broadcast(asking)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = index.filter(F.col("term").isNull()).withColumn("block", every)
    wanted = lists.join(asking, "term").unionByName(own.select("shard", "block", "ids", "m"), allowMissingColumns=True)
    hits = wanted.groupBy("shard", "block").applyInArrow(_search_shard(k), "item long, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index all documents and search them for all items. The index is written to the shared folder."""
    path = f"{shared_folder(docs.sparkSession)}/search-index-{uuid.uuid4().hex}"
    build(docs).write.parquet(path)
    return search(docs.sparkSession.read.parquet(path), items, k)
