"""Secret scans: an inverted index of trigrams, split by document, picks the texts that each rule has to read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

_MAX_STRINGS = 32  # exact strings that a part of a pattern may stand for before it counts as anything


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    min_length: int = 0
    group: int = 0  # whose length min_length is about

    def find(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if len(m.group(self.group)) >= self.min_length]


BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]+", min_length=24),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_password", r"[a-z]+://[^\s:/@]+:[^\s:/@]+@[^\s/]+"),
]

# A trigram query is a trigram, ("and", ...) or ("or", ...) over queries; ("and",) holds always.
ALWAYS = ("and",)


def _both(queries: list) -> tuple | str:
    flat = [q for q in dict.fromkeys(queries) if q != ALWAYS]
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _grams(s: str) -> tuple | str:
    s = s.lower()
    return _both([s[i : i + 3] for i in range(len(s) - 2)])


def _either(queries: list) -> tuple | str:
    flat = list(dict.fromkeys(queries))
    return ALWAYS if ALWAYS in flat else flat[0] if len(flat) == 1 else ("or", *flat)


def _strings(parts: list) -> set[str] | None:
    """The strings that parts of a parsed pattern stand for, or None if there are too many."""
    out = {""}
    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            some = {chr(arg)}
        elif name == "IN":
            some = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    some.add(chr(x))
                elif str(kind) == "RANGE" and x[1] - x[0] < _MAX_STRINGS:
                    some.update(map(chr, range(x[0], x[1] + 1)))
                else:
                    return None
        elif name == "SUBPATTERN":
            some = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(b) for b in arg[1]]
            some = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4 and (one := _strings(arg[2])) is not None:
            some, run = set(), {""}
            for k in range(int(arg[1]) + 1):
                some |= run if k >= arg[0] else set()
                run = {a + b for a in run for b in one}
        else:
            return None
        if some is None or len(out) * len(some) > _MAX_STRINGS:
            return None
        out = {a + b for a in out for b in some}
    return out


def _query(parts: list) -> tuple | str:
    """What every match of the parts holds: runs of parts with few strings give trigrams, others what lies inside."""
    queries, run = [], []

    def close() -> None:
        if run:
            queries.append(_either([_grams(s) for s in _strings(run)]))
        run.clear()

    for part in parts:
        if _strings([*run, part]) is not None:
            run.append(part)
            continue
        close()
        op, arg = part
        if _strings([part]) is not None:
            run.append(part)
        elif str(op) == "SUBPATTERN":
            queries.append(_query(arg[3]))
        elif str(op) == "BRANCH":
            queries.append(_either([_query(b) for b in arg[1]]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            queries.append(_query(arg[2]))
    close()
    return _both(queries)


def trigram_query(rule: Rule) -> tuple | str:
    """A Boolean query over lower-case trigrams that every text with a match of the rule meets."""
    return _query(list(re._parser.parse(rule.pattern, rule.flags)))


def _terms(query: tuple | str) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(_terms, query[1:]))


def _meets(query: tuple | str, postings: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The texts of an index that meet a query: intersections and unions of sorted lists, the shortest list first."""
    if isinstance(query, str):
        return postings.get(query, rows[:0])
    each = sorted((_meets(q, postings, rows) for q in query[1:]), key=len)
    if query[0] == "or":
        return reduce(np.union1d, each)
    return reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), each) if each else rows


class TrigramIndex:
    """Postings of the trigrams of texts, ASCII letters in lower case: for each trigram the texts that hold it, in order.

    Only trigrams that some query asks for have a list. One pass over the
    bytes finds them all.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.number = np.zeros(1 << 24, np.uint8 if len(terms) < 256 else np.uint16)
        for k, t in enumerate(terms, 1):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = k

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"\n\n".join(texts), np.uint8)
        if not self.terms or len(data) < 3:
            return {}
        ends = np.cumsum([len(t) + 2 for t in texts])
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        term = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(term)
        pairs = np.unique(term[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        kinds, first = np.unique(pairs // len(texts), return_index=True)
        return {self.terms[k - 1]: x for k, x in zip(kinds.tolist(), np.split(pairs % len(texts), first[1:]))}


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r)) for r in rules]
        # a trigram over a line's end or beyond ASCII says nothing here
        terms = set().union(*(_terms(q) for _, _, q in self.rules))
        if any(not t.isascii() or "\n" in t for t in terms):
            raise ValueError("a rule must contain a trigram with a line feed or beyond ASCII")
        self.index = TrigramIndex(sorted(terms))

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        postings = self.index.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        rows, spans = np.arange(len(texts)), [[] for _ in texts]
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in _meets(query, postings, rows):
                spans[i] += [(start, k, end) for start, end in rule.find(texts[i], compiled)]
        return [[(self.rules[k][0].kind, start, end) for start, k, end in sorted(s)] for s in spans]


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", out: str = "secrets", index_docs: int = 256) -> DataFrame:
    """Adds out: array of (kind, start, end), by start and then the order of the rules; code points, end exclusive.

    The index is split by document: each task indexes index_docs texts at a
    time, intersects and unites the postings that a rule's query names, and
    runs the rule over the texts that remain. A rule whose pattern has no
    trigram that it must contain reads all texts.
    Matches of one rule don't overlap. Null texts are empty and have no
    secrets. All input columns stay; one of the name of out is replaced.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.tolist()
            found = [s for k in range(0, len(texts), index_docs) for s in scanner.scan(texts[k : k + index_docs])]
            yield pd.Series([[{"kind": a, "start": b, "end": c} for a, b, c in s] for s in found], dtype=object)

    return docs.withColumn(out, scan(text_or_empty(text_col)))


def mask_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """Replaces every span by the mark, from the last span to the first; overlapping spans become one mark."""
    spans = F.coalesce(F.col(spans_col), F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    first = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = text_or_empty(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["done"], gap).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return docs.withColumn(text_col, F.aggregate(spans, first, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets over documents by all rules: counts and a digest of the base rules' spans, and all spans."""
    docs = scan_secrets(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = [r.kind for r in BASE_RULES]
    in_base = F.filter("secrets", lambda s: s["kind"].isin(base))
    return docs.select("doc_id", *map(_count, base), F.sha2(_joined(in_base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
