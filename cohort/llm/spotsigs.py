"""SpotSigs fingerprints and their comparison (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Anchors: the commonest function words of the languages (fixed values).
ANCHORS = (
    "the of and to in is that for it was on are with as be at by this had not but from or have an they which one you were a "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "de la le et les des en un du une que est pour qui dans par plus pas sur au avec ce il sont "
    "el y los se del las por con no su para como al lo más sus pero ha me si"
).split()
#: Content words of a chain.
CHAIN = 2
#: One in so many content words is an anchor too.
SPARE = 4
#: Rows that a bucket of neighbours has about, and how many buckets there are at most.
BUCKET_ROWS, BUCKETS = 500, 4096


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct spot signatures of a text, as 32-bit numbers.

    Words are runs of letters and digits in lower case. Anchors are common words; content words are all
    others. Each anchor starts a chain of the ``chain`` content words that follow it, and anchor and chain
    make a signature. The anchors are taken with their places: the j-th one (from 0) at place p has p - j
    content words before it, so its chain is a slice of the content words. A chain that the text's end cuts
    short counts if it has a word. Lists and tables have few common words, so one in ``SPARE`` content words,
    by its hash, is an anchor as well. Where no anchor starts a chain, every word starts one with the words
    after it; a text without letters or digits is one signature; an empty one has none.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _signatures(words, text, chain)


def _signatures(words: Column, text: Column, chain: int) -> Column:
    is_anchor = lambda w: w.isin(*ANCHORS)
    placed = F.filter(
        F.transform(words, lambda w, i: F.when(is_anchor(w), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull()
    )
    content = F.filter(words, lambda w: ~is_anchor(w))
    # one struct holds what the chains need, so that each part is computed once
    parts = F.struct(words.alias("words"), placed.alias("placed"), content.alias("content"), text.alias("text"))

    def of(p: Column) -> Column:
        spots = F.filter(
            F.transform(
                p["placed"],
                lambda s, j: F.when(
                    s["i"] - j < F.size(p["content"]), F.hash(s["w"], F.slice(p["content"], s["i"] - j + 1, F.lit(chain)))
                ),
            ),
            lambda h: h.isNotNull(),
        )
        spare = F.filter(
            F.transform(
                p["content"],
                lambda w, i: F.when(
                    (F.hash(w).bitwiseAND(SPARE - 1) == 0) & (i + 1 < F.size(p["content"])),
                    F.hash(w, F.slice(p["content"], i + 2, F.lit(chain))),
                ),
            ),
            lambda h: h.isNotNull(),
        )
        runs = F.transform(p["words"], lambda w, i: F.hash(F.lit(""), F.slice(p["words"], i + 1, F.lit(chain + 1))))
        whole = F.when(p["text"] != "", F.array(F.hash(p["text"]))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.array(F.concat(spots, spare)), lambda s: F.when(F.size(s) > 0, s).when(F.size(p["words"]) > 0, runs).otherwise(whole)
        )[0]

    return F.array_sort(F.array_distinct(F.transform(F.array(parts), of)[0]))


def fingerprint(signature: Column) -> Column:
    """The signatures as a string; equal texts have equal ones."""
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    # where the sizes differ much little can be shared, but a likeness is wanted for every pair
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _bounds(docs: DataFrame) -> list[int]:
    """Ids at which buckets of neighbouring documents begin: at most ``BUCKETS`` numbers."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.count()
    n = max(1, min(BUCKETS, rows // BUCKET_ROWS))
    found = docs.agg(F.min(key).alias("m"), F.percentile_approx(key, [i / n for i in range(n)], 10 * BUCKETS).alias("q")).first()
    return sorted({found["m"], *found["q"]}) if rows else []


def _order():
    """Documents of a bucket in order, the first one of the next bucket last."""
    return Window.partitionBy("_bucket").orderBy("_extra", F.asc_nulls_first("doc_id"), "text")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, _bucket and _extra: the text of the next document by ascending doc_id, after the last the first.

    Equal ids go by text, null ids come first, a null text counts as empty. Buckets of neighbouring ids are
    cut at ids that occur, so each bucket's last document is followed by the first one of the next bucket.
    That one is sent to both (marked ``_extra`` in the first), and each bucket is ordered by itself: texts are
    shuffled once.
    """
    bounds = _bounds(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not bounds:
        bounds = [0]
    n = len(bounds)
    at = F.from_json(F.lit(str(bounds)), "array<bigint>")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length(), -1, -1)])
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.try_element_at(at, (low + step).cast("int")) <= key), low + step).otherwise(low),
    )
    placed = docs.withColumn("_key", key).withColumn("_b", below - 1)
    opens = F.element_at(at, F.col("_b") + 1) == F.col("_key")
    mine = F.struct(F.col("_b").alias("b"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("_b") - 1, F.lit(n)).alias("b"), F.lit(True).alias("extra"))
    to = F.inline(F.when(opens, F.array(mine, before)).otherwise(F.array(mine)))
    dealt = placed.select("doc_id", "text", to).withColumnsRenamed({"b": "_bucket", "extra": "_extra"})
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    A document's edited text has the last half of its code points replaced by the first as many (or all) of
    the next document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next (likeness to the edited text and to the next document) and length_class (see
    ``length_class``). Null texts are empty; a repeated row is a document of its own; the only document of a
    table is its own next one; an empty table gives no rows. Other columns are left out.
    """
    pairs = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    texts = pairs.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("next_text")
    found = texts.withColumns(
        {
            "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256),
            "own": signatures(F.col("text")),
            "other": signatures(F.col("edited")),
        }
    ).drop("edited")
    # the same buckets in the same order: no further shuffle
    following = found.withColumn("next", F.lead("own").over(_order())).filter(~F.col("_extra"))
    return following.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        length_class(F.size("own")).alias("length_class"),
    )


def length_class(size: Column, threshold: float = 0.75) -> Column:
    """Partition of a set by its size. Sets that can reach the threshold lie in one class or in adjacent ones."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + F.lit(1e-9)).cast("int")).otherwise(-1)


def similar_pairs(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of different fingerprints (a < b, their smallest doc_ids) with their Jaccard similarity.

    Equal signature sets are one class, represented by the smallest doc_id. Classes are partitioned by set
    length: only adjacent length classes can be similar. Inside, candidates share one of the rarest
    signatures, as many as a similar pair cannot avoid sharing; pairs whose sizes rule the threshold out are
    pruned before sets are compared. Candidates grow with the pairs that share a rare signature, not with the
    group. Documents without signatures, and null ids, are left out.
    """
    sets = docs.select("doc_id", signatures(F.col("text")).alias("s")).filter(F.size("s") > 0)
    classes = sets.groupBy("s").agg(F.min("doc_id").alias("id")).filter("id is not null")
    size = F.size("s")
    items = classes.select("id", size.alias("n"), length_class(size, threshold).alias("class"), F.explode("s").alias("sig"))
    often = items.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(often, "sig").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    left = prefix.select("sig", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("class").alias("cx"))
    right = prefix.select("sig", "class", F.col("id").alias("y"), F.col("n").alias("ny"))
    close = F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold
    pairs = (
        left.join(right, ["sig", "class"])
        .filter(close & ((F.col("cx") < F.col("class")) | (F.col("x") < F.col("y"))))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    return (
        pairs.join(classes.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(classes.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .withColumn("similarity", likeness(F.col("sa"), F.col("sb")))
        .filter(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
