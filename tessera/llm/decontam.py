"""Benchmark decontamination with a generalised suffix automaton of normalised test items."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bounded_batches, mix

WINDOW = 13
#: Words of items in one automaton. More items are split over several, one pass over the documents each.
BLOCK_WORDS = 50_000
_TABLE_BITS = 22


class Automaton:
    """Suffix automaton of several word sequences, which marks the states of their windows.

    Of each state: len, link and next as usual; marks, the item windows that end there with their
    lengths; up, the nearest state with marks on the way to the root.
    """

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int = WINDOW):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.vocabulary: dict[str, int] = {}
        self.marks: dict[int, dict[int, set[str]]] = {}
        items = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min((min(window, len(ids)) for _, ids in items), default=window)
        for item, ids in items:
            n = min(window, len(ids))
            for end, (state, _) in enumerate(self.walk(ids)):
                if end + 1 >= n:
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    self.marks.setdefault(state, {}).setdefault(n, set()).add(item)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.up = [0] * len(self.link)
        for s in order[1:]:
            self.up[s] = self.link[s] if self.link[s] in self.marks else self.up[self.link[s]]

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c: next[p][c], or a copy of it for the shorter strings."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """After each word the state of the longest suffix that occurs in an item, and its length."""
        state = length = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def hits(self, words: list[str]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each occurrence of a window."""
        for end, (state, length) in enumerate(self.walk(self.vocabulary.get(w, -1) for w in words), 1):
            at = state if state in self.marks else self.up[state]
            while at:
                for n, items in self.marks[at].items():
                    if n <= length:
                        yield end - n, end, items
                at = self.up[at]


class Filter:
    """Word runs of a text that may hold a window: all neighbouring word pairs are pairs of some item."""

    def __init__(self, texts: list[str], least: int):
        w = Words(pa.array(texts, pa.string()))
        inner = np.ones(max(len(w.hashes) - 1, 0), bool)
        inner[w.of_row[1:-1][(w.of_row[1:-1] > 0) & (w.of_row[1:-1] < len(w.hashes))] - 1] = False
        self.least = least
        keys = self._pairs(w.hashes)[inner] if least > 1 else w.hashes
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True

    @staticmethod
    def _pairs(h: np.ndarray) -> np.ndarray:
        return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[keys >> np.uint64(64 - _TABLE_BITS)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), max(len(self.keys) - 1, 0))
        out = np.zeros(len(keys), bool)
        if len(self.keys):
            out[at[self.keys[place] == keys[at]]] = True
        return out

    def runs(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(row, first word, end) of the runs of a batch, long enough for the shortest window."""
        if not len(w.hashes):
            return
        if self.least > 1:
            known = self._known(self._pairs(w.hashes)) if len(w.hashes) > 1 else np.zeros(0, bool)
            edge = w.of_row[(w.of_row > 0) & (w.of_row < len(w.hashes))] - 1
            known[edge] = False
            more = 1
        else:
            known, more = self._known(w.hashes), 0
        step = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            if self.least == 1:  # runs of single words may pass a row's end
                cuts = [a, *w.of_row[(w.of_row > a) & (w.of_row < b)], b]
            else:
                cuts = [a, b]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e + more - s >= self.least:
                    yield int(np.searchsorted(w.of_row, s, "right") - 1), int(s), int(e + more)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    block, n = [], 0
    for row in items.toLocalIterator():
        size = 1 + len(row["text"]) // 2
        if block and n + size > most * 3:
            yield block
            block, n = [], 0
        block.append((row["item_id"], row["text"]))
        n += size
    if block:
        yield block


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, spans (array of [first word, end) that windows cover, merged) and items (sorted ids).

    Words are runs of ASCII letters and digits and of other characters than ASCII, A-Z lower-cased.
    A window is `window` consecutive words of an item, or a whole shorter item; items without words
    have none. Null texts have no words. docs' own columns stay; n_words, spans and items replace
    columns of those names. Items are read one by one and built into automata of a bounded size, each
    broadcast for a pass over the documents, so neither side's size meets a limit.
    """
    out = docs.drop("n_words", "spans", "items").withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<struct<start:int,end:int>>")).withColumn("items", F.array().cast("array<string>"))
    bounded_batches(docs.sparkSession)
    some = False
    blocks = _blocks(items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text"), block_words)
    for block in blocks:  # the driver holds one at a time
        out = _pass(out, block, window)
        some = True
    return out if some else _pass(out, [], window)


#: Automata of this Python worker, which serves one task after another, by the number of their block.
_built: dict[str, tuple[Automaton, Filter]] = {}


def _automaton(name: str, block: list[tuple[str, str]], window: int) -> tuple[Automaton, Filter]:
    if name not in _built:
        w = Words(pa.array([t for _, t in block], pa.string()))
        automaton = Automaton([(i, [w.word(k) for k in range(w.of_row[j], w.of_row[j + 1])]) for j, (i, _) in enumerate(block)], window)
        if len(_built) >= 4:
            _built.pop(next(iter(_built)))
        _built[name] = automaton, Filter([t for _, t in block], automaton.least)
    return _built[name]


def _pass(docs: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, window))
    schema = to_arrow_schema(docs.schema)

    def find(batch: pa.RecordBatch) -> list:
        from tessera.llm import decontam  # the module, whose automata outlive this task

        automaton, runs = decontam._automaton(*held.value)
        w = Words(batch.column("text"))
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str]] = {}
        for row, a, b in runs.runs(w):
            base = a - int(w.of_row[row])
            for s, e, items in automaton.hits([w.word(k) for k in range(a, b)]):
                spans.setdefault(row, []).append((base + s, base + e))
                found.setdefault(row, set()).update(items)
        columns = {f.name: batch.column(f.name) for f in schema}
        columns["n_words"] = pa.array(np.diff(w.of_row), pa.int64())
        if spans:
            old, ids = columns["spans"].to_pylist(), columns["items"].to_pylist()
            for row, more in spans.items():
                old[row] = merged([*((x["start"], x["end"]) for x in old[row]), *more])
                ids[row] = sorted(found[row].union(ids[row]))
            columns["spans"] = pa.array([[x if isinstance(x, dict) else {"start": x[0], "end": x[1]} for x in r] for r in old], schema.field("spans").type)
            columns["items"] = pa.array(ids, schema.field("items").type)
        return [columns[f.name].cast(f.type) if columns[f.name].type != f.type else columns[f.name] for f in schema]

    return docs.mapInArrow(batches(find, schema), docs.schema)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judged(docs: DataFrame, part: int = 20) -> DataFrame:
    """docs of overlaps() with n_hit, n_items, items_sha256 and contaminated: hit words are a part-th of all, or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return docs.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words")))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    w = Words(pa.array([text], pa.string()))
    out, at = [], 0
    for s, e in spans:
        out.append(w.raw[at : w.starts[s]].tobytes())
        at = int(w.ends[e - 1])
    return b"".join([*out, w.raw[at:].tobytes()]).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, items: DataFrame, longest: int | None = None, part: int = 20) -> DataFrame:
    """docs' own columns, without contaminated rows; spans of over `longest` words are cut from the rest, if it is given.

    Rows keep their text if nothing is cut; a null text stays.
    """
    names = docs.columns
    own = {c: c if c == "text" else f"_c{i}" for i, c in enumerate(names)}  # so that no name clashes
    kept = judged(overlaps(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()]), items), part).where("not contaminated")
    back = [F.col(a).alias(c) for c, a in own.items()]
    if longest is None:
        return kept.select(*back)

    @F.pandas_udf("string")
    def without(texts, spans):  # noqa: ANN001
        import pandas as pd

        return pd.Series([t if t is None or not (x := [(y["start"], y["end"]) for y in s if y["end"] - y["start"] > longest]) else cut(t, x) for t, s in zip(texts, spans, strict=True)])

    return kept.withColumn("text", without("text", "spans")).select(*back)


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
