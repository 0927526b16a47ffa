"""Personal data: base patterns, and bootstrapped extraction of further identifiers from their contexts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.sizing import checkpoint

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive runs give the same matches and keep the search linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A pattern is trusted if it names a kind in so large a share of its places, and in so many different instances.
CONFIDENCE, SUPPORT = 0.8, 3
ROUNDS = 3

DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>|"
#: An at sign in words and the domain after it, which may spell its dots out.
AT_WORD = re.compile(r" ?(?:\(at\)|\[at\]) ?", re.I | re.A)
SPELLED = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++", re.I | re.A)
#: A token of a number with blanks in it, and what may stand before its first one.
PIECE = re.compile(r"[0-9().\[\]/+-]+")
LEAD = re.compile(r"[\"'`,;:!?{}<>|]*+(?:[A-Za-z_-]++[=:])?")
TAIL = "\"'`,;:!?{}<>|."
KEYED = re.compile(r"([A-Za-z_-]+[=:])(.+)", re.S)


def _emails(text: str) -> list[tuple[int, int]]:
    """A match is an at sign, the run before it (not into the match before) and a domain after it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start. Failing matches are dropped."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255" for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def looks_like(value: str) -> list[int]:
    """Kinds that the shape of an unseen identifier allows."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    out = []
    if letters and ("@" in value or AT_WORD.search(value)):
        out.append(0)
    if digits >= 4 and (value.count(".") == 3 or value.count(":") >= 4) and not re.search(r"[g-zG-Z]", value):
        out.append(1)
    if not letters and 12 <= digits <= 19:
        out.append(2)
    if not letters and 7 <= digits <= 15:
        out.append(3)
    return out


def _contexts(left: list[str], right: str, key: str) -> list[str]:
    """Lexical patterns around an instance; the slot is ``*``."""
    one, two = (left[-1:] or [""])[0], " ".join(left[-2:])
    out = [f"{one} *", f"{two} *", f"{one} * {right}"]
    return list(dict.fromkeys([f"{key}*"] if key else [p for p in out if p.strip("* ")]))


def _unbracketed(text: str, begin: int, end: int) -> tuple[int, int]:
    """A span without brackets around the whole and without those that have no partner."""
    while begin < end:
        part = text[begin:end]
        if part[0] in "([" and part.find(")" if part[0] == "(" else "]") in (-1, len(part) - 1):
            begin += 1
        elif part[-1] in ")]" and part.count(part[-1]) > part.count("(" if part[-1] == ")" else "["):
            end -= 1
        elif part[-1] in " \t\xa0-/.+([":
            end -= 1
        else:
            break
    return begin, end


def split_spans(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifiers over several tokens: numbers with blanks on one line, and addresses with (at) or [at]."""
    out, free = [], 0
    for m in AT_WORD.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < m.start() and (domain := SPELLED.match(text, m.end())):
            out.append((begin, domain.end()))
            free = domain.end()
    i = 0
    while i < len(tokens):
        begin = LEAD.match(text, *tokens[i]).end()
        end, j, start = begin, i, begin
        while j < len(tokens):
            token = text[start : tokens[j][1]]
            body = token.rstrip(TAIL)
            if not PIECE.fullmatch(body) or j == i and not DIGITS.search(body):
                break
            end, j = start + len(body), j + 1
            if body != token or j == len(tokens) or text[tokens[j - 1][1] : tokens[j][0]].strip(" \t\xa0"):
                break
            start = tokens[j][0]
        if j > i + 1:
            a, b = _unbracketed(text, begin, end)
            if looks_like(text[a:b]):
                out.append((a, b))
        i = max(j, i + 1)
    return out


def mentions(text: str | None, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind or -1, start, end, instance, patterns) of base entities and of what else is shaped like an identifier.

    That are single tokens, and runs of tokens that together have the shape; the context of a run is outside it.
    """
    if not text or not spans and not DIGITS.search(text) and "@" not in text and not AT_WORD.search(text):
        return []
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    word = lambda i: text[slice(*tokens[i])].strip(EDGE).lower()[:64] if 0 <= i < len(tokens) else ""
    out, taken, ends = [], sorted((a, b, k) for k, a, b in spans), 0
    # no base entity lies in or reaches into a run: the one that begins last before its end is the nearest
    reach = list(accumulate((b for _, b, _ in taken), max))
    begins = [a for a, _, _ in taken]
    for a, b in split_spans(text, tokens):
        before = bisect_left(begins, b)
        if not before or reach[before - 1] <= a:
            taken.append((a, b, -1))
    taken.sort()

    def single(i: int) -> None:
        a, b = tokens[i]
        token = text[a:b]
        if DIGITS.search(token) or "@" in token or AT_WORD.search(token):
            lead = len(token) - len(token.lstrip(EDGE))
            value, key = token.strip(EDGE), ""
            if m := KEYED.fullmatch(value):
                key, rest = m[1].lower(), m[2].lstrip(EDGE)
                lead, value = lead + len(value) - len(rest), rest
            if value and looks_like(value):
                patterns = _contexts([word(i - 2), word(i - 1)], word(i + 1), key)
                out.append((-1, a + lead, a + lead + len(value), value, patterns))

    at, i = 0, 0
    while i < len(tokens):
        a, b = tokens[i]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:  # an entity begins in or reaches into this token
            begin, ends, last = taken[at][0], taken[at][1], i
            while last + 1 < len(tokens) and tokens[last + 1][0] < ends:
                last += 1
            key = KEYED.fullmatch(text[a:begin].lstrip(EDGE) + "*")
            patterns = _contexts([word(i - 2), word(i - 1)], word(last + 1), key[1].lower() if key else "")
            while at < len(taken) and taken[at][0] < max(ends, tokens[last][1]):
                begin, ends, kind = taken[at]
                out.append((kind, begin, ends, text[begin:ends], patterns))
                at += 1
            # the further tokens of a run can be identifiers of their own
            run = kind < 0 and last > i
            for i in range(i + 1, last + 1) if run else ():
                single(i)
            i = last + 1
            continue
        single(i)
        i += 1
    return out


def _mentions(docs: DataFrame) -> DataFrame:
    """A row per mention and text: key, kind, start, end, instance, shapes, patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "start", "end", "instance", "shapes", "patterns"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        for batch in batches:
            rows = [
                (key, k, a, b, hashlib.md5(x.encode("utf-8", "replace")).hexdigest(), looks_like(x), p)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, a, b, x, p in mentions(text, base_spans(text))
            ]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.md5(F.encode("text", "UTF-8")).alias("key"), "text").mapInArrow(
        run, "key string, kind int, start int, end int, instance string, shapes array<int>, patterns array<string>"
    )


def trusted_patterns(
    found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT
) -> DataFrame:
    """(pattern, kind) pairs of high confidence, by scores that pass between patterns and instances.

    Instances of the base patterns count fully for their kind. In each round a pattern's score for a kind is
    the mean of its instances' scores, if at least ``support`` different instances are known; an instance's
    score is that of its best trusted pattern. All steps are aggregates and joins on a pattern or an instance,
    summed up before they are shuffled.
    """
    edges = checkpoint(
        found.select("kind", "instance", "shapes", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("seed"), F.first("shapes").alias("shapes"))
    )
    scores = edges.filter("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    good = None
    for _ in range(rounds):
        good = (
            edges.select("pattern", "instance")
            .join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("known"))
            .filter(F.col("known") >= support)
            .join(size, "pattern")
            .select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score"))
            .filter(F.col("score") >= confidence)
        )
        good = checkpoint(good)
        new = (
            edges.filter("seed < 0")
            .join(good, "pattern")
            .filter(F.array_contains("shapes", F.col("kind")))
            .groupBy("instance", "kind")
            .agg(F.max("score").alias("score"))
        )
        scores = checkpoint(scores.filter("score = 1.0").unionByName(new).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return good


def added_spans(docs: DataFrame, **options) -> DataFrame:
    """(key, added) for texts in which trusted patterns find identifiers that the base patterns don't; key: md5."""
    usable = docs.filter(F.col("text").rlike(r"(?i)[0-9@]|\(at\)|\[at\]")).select("text")
    # a copy says nothing new about a pattern
    found = checkpoint(_mentions(usable).dropDuplicates(["key", "start", "end", "kind"]))
    good = trusted_patterns(found, **options)
    return (
        found.filter("kind < 0")
        .drop("kind")
        .withColumn("pattern", F.explode("patterns"))
        .join(good, "pattern")
        .filter(F.array_contains("shapes", F.col("kind")))
        .groupBy("key", "start", "end")
        .agg(F.max(F.struct("score", "kind")).alias("best"))
        .groupBy("key")
        .agg(F.collect_set(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added"))
        # a token inside a run that is an identifier says nothing more
        .withColumn("added", F.filter("added", lambda s: ~F.exists("added", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))))
    )


def _with_added(docs: DataFrame, **options) -> DataFrame:
    added = added_spans(docs, **options).withColumnsRenamed({"key": "__pii_key", "added": "__pii_added"})
    keyed = docs.withColumn("__pii_key", F.md5(F.encode("text", "UTF-8")))
    return keyed.join(added, "__pii_key", "left").select(*docs.columns, "__pii_added")


def find(docs: DataFrame, **options) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added.

    The counts and the digest are of the base spans; ``spans`` holds all, ``added`` the number of those that
    the bootstrapped patterns add. A null or empty text has none (the digest is that of the empty string).
    Repeated rows give repeated rows; equal texts have equal spans. Other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # all columns but the added spans are made in one pass over the texts; only they meet the added ones
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "key"]
    plain = docs.select("doc_id", "text", F.md5(F.encode("text", "UTF-8")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = [base_spans(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([sum(s[0] == k for s in spans) for spans in all_spans], pa.int64()) for k in range(len(KINDS))]
            base = [joined(s) for s in all_spans]
            digest = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(digest, pa.string()), pa.array(base, pa.string()), batch.column("key")], names
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    base = plain.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, base string, key string")
    both = base.join(added_spans(docs, **options), "key", "left")
    # put the added spans in their places: by kind as listed, then start
    parts = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).cast("int").alias("kind"),
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end"),
        ),
    )
    more = F.transform(
        F.col("added"), lambda s: F.struct((s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    text = F.array_join(
        F.transform(
            F.array_sort(F.concat(parts, more)),
            lambda s: F.concat_ws(":", F.array(*map(F.lit, KINDS))[s["kind"] - 1], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return both.select(
        *names[:6],
        F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).alias("added"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, and ``n_chars`` (if there) set anew.

    Spans that overlap are replaced as one, by the kind of the first. Null texts stay null; texts without
    personal data stay as they are.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, added in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in added or ()]
                out, last = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b in spans):
                    if a >= last:
                        out += [text[last:a], f"[{KINDS[k].upper()}]"]
                    last = max(last, b)
                texts.append("".join(out) + text[last:] if out else text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = _with_added(docs, **options).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
