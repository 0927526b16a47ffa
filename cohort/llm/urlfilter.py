"""URL rules as a bit-parallel wildcard automaton (multiword Shift-And)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Stands between host and path in a canonical URL; a star in a host doesn't cross it.
EDGE = 0
ONE = np.uint64(1)


class Rule(NamedTuple):
    """``host`` and ``path`` are globs (``*`` any run, ``?`` one character). The path is a prefix of the URL's.

    With ``subdomains`` the host also fits below any further labels.
    """

    verdict: str
    host: str
    path: str
    subdomains: bool = True

    @property
    def name(self) -> str:
        return self.host + self.path


#: The stated rules.
RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]

#: What decides where no stated rule fits: hosts that serve adverts or count visits, and pages without prose.
FALLBACK = [
    Rule("block", "ads.*", "", False),
    Rule("block", "*.ads.*", "", False),
    Rule("block", "adserver.*", "", False),
    Rule("block", "tracker.*", "", False),
    Rule("block", "*", "/login", False),
    Rule("block", "*", "/cgi-bin/", False),
    Rule("block", "*", "*/wp-admin/", False),
]


class Automaton(NamedTuple):
    start: np.ndarray  # words
    step: np.ndarray  # 256 x words: states that a byte leads into
    stay: np.ndarray  # 256 x words: states that a byte leaves as they are
    accept: np.ndarray  # pattern -> state
    rule: np.ndarray  # pattern -> rule


def compile_rules(rules: list[Rule]) -> Automaton:
    """Pack all rules into one row of bits: a start state per pattern, then a state per byte that isn't a star."""
    step, stay, starts, accept, owner = [], [], [], [], []

    def state(takes: set[int]) -> None:
        step.append(takes)
        stay.append(set())

    anything, inside = set(range(256)), set(range(256)) - {EDGE}
    for number, rule in enumerate(rules):
        for host in [rule.host, "*." + rule.host] if rule.subdomains else [rule.host]:
            starts.append(len(step))
            state(set())
            for part, any_byte in ((host, inside), (None, None), (rule.path + "*", anything)):
                if part is None:
                    state({EDGE})
                    continue
                for byte in part.encode():
                    if byte == ord("*"):
                        stay[-1] |= any_byte
                    else:
                        state(any_byte if byte == ord("?") else {byte})
            accept.append(len(step) - 1)
            owner.append(number)
    width = -(-len(step) // 64)
    masks = np.zeros((2, 256, width), np.uint64)
    for kind, sets in enumerate((step, stay)):
        for i, takes in enumerate(sets):
            for byte in takes:
                masks[kind, byte, i // 64] |= ONE << np.uint64(i % 64)
    start = np.zeros(width, np.uint64)
    for i in starts:
        start[i // 64] |= ONE << np.uint64(i % 64)
    return Automaton(start, masks[0], masks[1], np.array(accept, int), np.array(owner, int))


def fits(automaton: Automaton, urls: list[bytes], rules: int) -> np.ndarray:
    """For each URL and rule, whether it fits. Bytes are taken one by one for all URLs at once."""
    length = np.array([len(u) for u in urls], int)
    order = np.argsort(-length, kind="stable")
    data = np.frombuffer(b"".join(urls), np.uint8)
    offset = (np.cumsum(length) - length)[order]
    states = np.tile(automaton.start, (len(urls), 1))
    active = len(urls)
    for t in range(int(length.max(initial=0))):
        active = int(np.searchsorted(-length[order], -t))  # those that are longer than t
        byte, now = data[offset[:active] + t], states[:active]
        moved = now << ONE
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        states[:active] = moved & automaton.step[byte] | now & automaton.stay[byte]
    at = automaton.accept
    hit = states[:, at // 64] >> (at % 64).astype(np.uint64) & ONE == ONE
    out = np.zeros((len(urls), rules), bool)
    np.logical_or.at(out, (order[:, None], automaton.rule[None, :]), hit)
    return out


def host_and_path(url: str = "url") -> dict[str, "F.Column"]:
    """Columns ``host`` and ``path``: both empty if the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(F.col(url), r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": lowered, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def judge(
    df: DataFrame, rules: list[Rule] = RULES, fallback: list[Rule] = FALLBACK, default: str = "allow", url: str = "url"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Of the rules that fit, the one with the longest name wins; equally long ones in the order given. If none
    fits, ``rule`` is null and the longest fitting fallback decides, else ``default``. A null, empty or
    unparsable URL has an empty host and path and fits no rule with a host. Columns with these four names are
    replaced, all others stay. One pass, no shuffle; memory follows the Arrow batch.
    """
    df = df.drop("host", "path", "rule", "verdict")
    both = [*rules, *fallback]
    automaton = compile_rules(both)
    rank = sorted(range(len(both)), key=lambda i: (i >= len(rules), -len(both[i].name), i))
    names = np.array([*(r.name for r in rules), *[None] * len(fallback), None], object)[[*rank, len(both)]]
    verdicts = np.array([*(r.verdict for r in both), default], object)[[*rank, len(both)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = [f"{h}\0{p}".encode("utf-8", "replace") for h, p in zip(batch["host"], batch["path"])]
            hit = np.column_stack([fits(automaton, urls, len(both))[:, rank], np.ones(len(urls), bool)])
            first = hit.argmax(1)
            yield batch.assign(rule=names[first], verdict=verdicts[first])

    split = df.withColumns(host_and_path(url))
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return split.mapInPandas(run, schema)
