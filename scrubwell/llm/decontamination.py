"""Benchmark decontamination: suffix arrays over shards of the training text, searched for every benchmark suffix.

A shard is a run of documents in one task. Words of the benchmark have numbers, all others are 0, so no match crosses an
unknown word or a document's end. The shard's suffix array sorts the positions at which a benchmark window may begin (its
first words occur at the begin of one) by the next ``window`` words; binary search finds, for every suffix of every
benchmark item, the range of positions that start with the same ``window`` words. Occurrences that continue each other
are the longest verbatim matches, reported with both places.

An item of fewer words than ``window`` matches as a whole; one without words matches nothing. NULL and empty texts have
no words and are clean. Item ids are compared as text, NULL as ``null``; rows of one item id count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces, text_bytes
from scrubwell.llm.words import split_words

WINDOW = 10
# Words of a shard, beyond which its suffix array is built; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
# Words of the benchmark that travel to the tasks at a time; a larger benchmark is searched block after block.
BLOCK_WORDS = 1 << 19

MATCH = "struct<item_id:string, item_word:bigint, doc_word:bigint, words:bigint>"
_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class TestBlock:
    """Part of the benchmark, ready to be searched for: its vocabulary and the windows of its items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        numbers = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        starts = [(i, at, min(window, len(n))) for i, n in enumerate(numbers) for at in range(max(1, len(n) - window + 1)) if n]
        self.item, self.offset, self.length = (np.array([s[k] for s in starts], dtype=np.int64) for k in range(3))
        self.words = np.zeros((len(starts), window), dtype=np.int64)
        for row, (i, at, length) in zip(self.words, starts, strict=True):
            row[:length] = numbers[i][at : at + length]
        self.bits = max(1, len(self.vocabulary).bit_length())
        beyond = np.where(np.arange(window) < self.length[:, None], self.words, (1 << self.bits) - 1)
        self.low, self.high = self.pack(self.words), self.pack(beyond)
        # Which first words a window begins with, by how many of them there are (three at most).
        self.begins = {}
        for n in range(1, min(3, window) + 1):
            heads = self.words[np.minimum(self.length, min(3, window)) == n, :n]
            if len(heads):
                table = np.zeros(1 << 20, dtype=bool)
                table[self.mixed([heads[:, k] for k in range(n)])] = True
                self.begins[n] = table

    @staticmethod
    def mixed(words: list[np.ndarray]) -> np.ndarray:
        """A 20-bit hash of some words at each position."""
        out = np.zeros(len(words[0]), dtype=np.uint64)
        for w in words:
            out = (out + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out >> np.uint64(44)

    def pack(self, words: np.ndarray) -> list[np.ndarray]:
        """Rows of word numbers as few integer columns that sort alike."""
        per = 62 // self.bits
        columns = []
        for at in range(0, words.shape[1], per):
            key = np.zeros(len(words), dtype=np.int64)
            for k in range(at, min(at + per, words.shape[1])):
                key = key << self.bits | words[:, k]
            columns.append(key)
        return columns

    def suffix_array(self, shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions that may begin a window, sorted by their next words, and those words packed."""
        padded = np.concatenate([shard, np.zeros(self.window, dtype=shard.dtype)])
        may = np.zeros(len(shard), dtype=bool)
        for n, table in self.begins.items():
            may |= table[self.mixed([padded[k : k + len(shard)] for k in range(n)])]
        at = np.flatnonzero(may & (shard > 0))
        keys = self.pack(padded[at[:, None] + np.arange(self.window)])
        order = np.lexsort(keys[::-1])
        return at[order], [k[order] for k in keys]

    def search(self, keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key the first place whose key is not below it (or, ``after``, is above it), by bisection."""
        low = np.zeros(len(wanted[0]), dtype=np.int64)
        high = np.full(len(wanted[0]), len(keys[0]), dtype=np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(keys[0]) - 1)
            below = np.full(len(low), after)
            for have, want in zip(reversed(keys), reversed(wanted), strict=True):
                have = have[middle]
                below = (have < want) | (have == want) & below
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def occurrences(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of window and position of the shard."""
        at, keys = self.suffix_array(shard)
        if not len(at) or not len(self.item):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first, last = self.search(keys, self.low, False), self.search(keys, self.high, True)
        n = last - first
        which = np.repeat(np.arange(len(n)), n)
        return which, at[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestBlock]:
    items, n = [], 0
    for name, text in benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("null")), benchmark[text_col].cast("string")).toLocalIterator():
        words = split_words((text or "").encode())
        items.append((name, words))
        n += len(words)
        if n >= block_words:
            yield TestBlock(items, window)
            items, n = [], 0
    yield TestBlock(items, window)


def _search_shard(block: TestBlock, parts: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard with what was found in them, added to what earlier blocks found."""
    words = [w for _, own in parts for w in own]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    shard = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    for start, own in zip(starts, words, strict=True):
        shard[start : start + len(own)] = own
    which, at = block.occurrences(shard)
    length = block.length[which]
    # Cover: earlier spans and the new occurrences.
    change = np.zeros(len(shard) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    row = 0
    for batch, own in parts:
        for spans in batch.column("spans").to_pylist():
            for span in spans or ():
                change[starts[row] + span["start"]] += 1
                change[starts[row] + span["end"]] -= 1
            row += 1
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(covered))
    begins, ends = edges[::2], edges[1::2]
    # Longest matches: occurrences on one diagonal that follow each other.
    order = np.lexsort((at, at - block.offset[which], block.item[which]))
    which, at, length = which[order], at[order], length[order]
    item, diagonal = block.item[which], at - block.offset[which]
    follows = (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (at[1:] == at[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~follows])) if len(at) else np.zeros(0, dtype=np.int64)
    tails = np.concatenate([heads[1:], [len(at)]])[: len(heads)] - 1
    owner = np.searchsorted(starts, at[heads], side="right") - 1
    spans_of: dict[int, list] = {}
    for begin, end, doc in zip(begins, ends, np.searchsorted(starts, begins, side="right") - 1, strict=True):
        spans_of.setdefault(int(doc), []).append({"start": int(begin - starts[doc]), "end": int(end - starts[doc])})
    found: dict[int, list] = {}
    for doc, head, tail in zip(owner, heads, tails, strict=True):
        match = (block.names[item[head]], int(block.offset[which[head]]), int(at[head] - starts[doc]), int(at[tail] - at[head] + length[tail]))
        found.setdefault(int(doc), []).append(dict(zip(("item_id", "item_word", "doc_word", "words"), match, strict=True)))
    row = 0
    for batch, own in parts:
        numbers = range(row, row + len(own))
        row += len(own)
        columns = {
            "n_words": pa.array([len(w) for w in own], pa.int64()),
            "spans": pa.array([spans_of.get(i, []) for i in numbers], pa.list_(_SPAN)),
            "matches": pa.array([(old or []) + found.get(i, []) for i, old in zip(numbers, batch.column("matches").to_pylist(), strict=True)], pa.list_(_MATCH)),
        }
        yield pa.RecordBatch.from_arrays([columns.get(c, None) if c in columns else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def _searcher(sent: Broadcast, shard_words: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        number = block.vocabulary.get
        parts, n = [], 0
        for batch in pieces(batches):
            own = [np.array([number(w, 0) for w in split_words(t)], dtype=np.int64) for t in text_bytes(batch)]
            parts.append((batch, own))
            n += sum(map(len, own))
            if n >= shard_words:
                yield from _search_shard(block, parts)
                parts, n = [], 0
        if parts:
            yield from _search_shard(block, parts)

    return search


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: list[str] | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Each document with the benchmark text in it. No shuffle: documents stream through the tasks.

    Columns: ``row`` (the document's columns, or those in ``keep``), ``n_words``, ``spans`` (stretches of words that lie in
    an occurrence of a window, merged), ``matches`` (longest verbatim matches: item, word in the item, word in the
    document, words). A task holds one shard and one block of the benchmark.
    """
    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    out = docs.select(
        row, docs[text_col].cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast(f"array<{MATCH}>").alias("matches"),
    )
    for block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        out = out.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block), shard_words), out.schema)
    return out.drop("text")


def leak_digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of words hit and items found, with a digest of the items."""
    items: Column = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row")[doc_id].alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without an occurrence of a benchmark window, with their own columns."""
    return find_leaks(docs, benchmark, **options).filter(F.size("spans") == 0).select("row.*")
