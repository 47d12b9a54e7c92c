"""How the tokens of two tokenizers line up: a byte-level BPE (A) and a piece model with byte fallback (B).

Both encode a blank and the text, so both token sequences tile the same bytes. Intervals are coalesced: all tokens, A
and B, are sorted by where they start, and a group ends where a start reaches the running maximum of the ends. Inside
the groups every A token is linked with the B tokens whose bytes it overlaps. How many documents hold a pair of ids
linked is counted corpus-wide, and each document's links are rated by those counts.

Every text is encoded once. Its distinct pairs are written to the shared folder beside its figures, packed; counting and
rating read them back. Tasks add up the pairs of their documents before pairs are shuffled. The counts of the most
frequent pairs, ``HOT_PAIRS`` at most, travel to the tasks, which rate with them on the spot; links of rarer pairs, of
which few documents each hold one, are rated by a join on the pair.

Texts that are NULL or empty, or that a tokenizer does not give back byte for byte, have no tokens: all figures are 0
and ``groups`` is the empty string. Long texts are cut at blanks after other characters, where tokens of both end. A
table without rows gives none, and repeated rows are documents each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.functions.storage import fresh_path
from scrubwell.llm.batches import pieces, texts
from scrubwell.llm.byte_bpe import GROUP, LONG_WORD, MEMORY, SEGMENT, Encoder, SharedVocabulary

# Pairs whose counts are broadcast: 17 bytes each.
HOT_PAIRS = 1 << 20
# Distinct pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1 << 21
# Bins per doubling of a count, by which the hot pairs are chosen.
BINS = 8

# Fixed values of the piece format.
_BLANK = "▁"
_BYTE = re.compile("<0x([0-9A-F]{2})>")

_chunks = re.compile(" +[^ ]*").findall
_cut = re.compile("[^ ](?= )").search


class PieceEncoder:
    """Ids by a sentencepiece model, chunk by chunk: blanks and what follows up to the next blank."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        spelled = [_BYTE.fullmatch(n) if self.model.is_byte(i) else None for i, n in enumerate(names)]
        self.tokens = [bytes([int(m[1], 16)]) if m else n.replace(_BLANK, " ").encode() for m, n in zip(spelled, names, strict=True)]
        # No piece has a blank after another character and blanks are kept as they are: then no merge crosses into a chunk.
        probe = self.model.encode("  a  b \n c ")
        kept = b"".join(self.tokens[i] for i in probe) == b"   a  b \n c "
        self.by_chunk = kept and not any(_BLANK in n.lstrip(_BLANK) for n in names)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def split(self, segment: str) -> list[str]:
        return _chunks(segment) if self.by_chunk else [segment]

    def learn(self, chunks: set[str]) -> list[str]:
        """Finds the ids of these chunks, which start with the blank that the model adds; those whose bytes differ are
        ``odd``. Returns the new ones that are too long to be remembered."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known = {c: self.known[c] for c in chunks if c in self.known}
            self.odd &= chunks
        found = self.model.encode([c[1:] for c in new], num_threads=1) if new else []
        if " " in new:  # a lone blank ends a text; the model adds none to an empty text, so it is taken from behind a word
            word, both = self.model.encode(["a", "a "], num_threads=1)
            found[new.index(" ")] = both[len(word) :]
        counts = np.array([len(ids) for ids in found], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum()))
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update(zip(new, (data[e - 4 * n : e] for e, n in zip(ends, counts.tolist(), strict=True)), strict=True))
        spelled = [c.encode() for c in new]
        widths = np.diff(np.append(0, np.cumsum(self.lengths[flat]))[np.append(0, np.cumsum(counts))])
        if widths.tolist() != [len(c) for c in spelled] or b"".join([self.tokens[i] for i in flat.tolist()]) != b"".join(spelled):
            for chunk, ids, wanted in zip(new, found, spelled, strict=True):
                if b"".join([self.tokens[i] for i in ids]) != wanted:
                    self.odd.add(chunk)
        return [c for c in new if len(c) > LONG_WORD]


_PIECE_ENCODERS: dict[str, PieceEncoder] = {}


def _piece_encoder(model: bytes) -> PieceEncoder:
    """The encoder for a model; a worker process keeps it, so later tasks find its chunks known."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _PIECE_ENCODERS:
        _PIECE_ENCODERS[key] = PieceEncoder(model)
    return _PIECE_ENCODERS[key]


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and in that order whether a group begins: where a start reaches all ends before it."""
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    return order, np.append(True, start[order][1:] >= reached[:-1])[: len(order)]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B intervals that share bytes; both sides ascend without overlaps among themselves."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(n)), n), np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - low, n)


class _Figures:
    """What is known of one document so far."""

    __slots__ = ("faithful", "n", "text", "pairs")

    def __init__(self):
        self.faithful, self.n, self.text, self.pairs = True, np.zeros(4, dtype=np.int64), [], []


class Aligner:
    """Aligns texts, many segments at a time."""

    def __init__(self, a: Encoder, b: PieceEncoder):
        self.a, self.b = a, b
        self.lengths = [np.array([len(t) for t in side], dtype=np.int64) for side in (a.v.tokens, b.tokens)]
        numbers = range(max(map(len, self.lengths)))
        self.names = np.array([f"{i}{mark}".encode() for i in numbers for mark in ",|;"], dtype=object)
        self.width = np.int64(len(b.tokens))

    def segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SEGMENT:
            cut = _cut(text, start + SEGMENT)
            if cut is None:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:]

    def run(self, all_texts: list[str]) -> list[_Figures]:
        out = [_Figures() for _ in all_texts]
        group, held = [], 0
        for document, text in enumerate(all_texts):
            for segment in self.segments(" " + text) if text else ():
                group.append((document, segment))
                held += len(segment)
                if held > GROUP:
                    self._align(group, out)
                    group, held = [], 0
        if group:
            self._align(group, out)
        return out

    def _encoded(self, group: list[tuple[int, str]], out: list[_Figures]) -> list[tuple[int, bytes, bytes]]:
        words, chunks = [self.a.split(s) for _, s in group], [self.b.split(s) for _, s in group]
        long_words, long_chunks = self.a.learn(words), self.b.learn(set().union(*chunks))
        found = []
        for (document, _), own_words, own_chunks in zip(group, words, chunks, strict=True):
            if self.b.odd and not self.b.odd.isdisjoint(own_chunks):
                out[document].faithful = False
            else:
                ids = b"".join(map(self.a.words.__getitem__, own_words)), b"".join(map(self.b.known.__getitem__, own_chunks))
                found.append((document, *ids))
        for word in long_words:
            del self.a.words[word]
        for chunk in long_chunks:
            del self.b.known[chunk]
        self.b.odd.difference_update(long_chunks)
        return found

    def _align(self, group: list[tuple[int, str]], out: list[_Figures]) -> None:
        found = self._encoded(group, out)
        if not found:
            return
        documents = np.array([d for d, _, _ in found], dtype=np.int64)
        ids, segment, start, end = [], [], [], []
        for side in (0, 1):
            own = [f[side + 1] for f in found]
            ids.append(np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64))
            segment.append(np.repeat(np.arange(len(found)), [len(x) // 4 for x in own]))
            width = self.lengths[side][ids[side]]
            end.append(np.cumsum(width))
            start.append(end[side] - width)
        side = np.repeat(np.array([0, 1], dtype=np.int8), [len(ids[0]), len(ids[1])])
        order, head = coalesce(np.concatenate(start), np.concatenate(end), side)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(head)  # the group of every token

        per = lambda at: np.bincount(at, minlength=len(found))
        of_all = np.concatenate(segment)
        at_a, at_b = overlaps(start[0], end[0], start[1], end[1])
        figures = np.stack([per(segment[0]), per(segment[1]), per(of_all[order[head]]), per(segment[0][at_a])], axis=1)

        listed = np.lexsort((side, number))  # group after group, its A tokens, then its B tokens
        sides, numbers = side[listed], number[listed]
        mark = np.where(np.append(sides[1:] != sides[:-1], True), np.where(sides == 0, 1, 2), 0)
        mark[:-1][numbers[1:] != numbers[:-1]] = 2
        written = self.names[np.concatenate(ids)[listed] * 3 + mark]
        stops = np.cumsum(figures[:, 0] + figures[:, 1])

        keys = (ids[0][at_a] * self.width + ids[1][at_b]).astype(np.int64)
        keyed = documents[segment[0][at_a]]
        order = np.lexsort((keys, keyed))
        keys, keyed = keys[order], keyed[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (keyed[1:] != keyed[:-1]))[: len(keys)])
        times = np.diff(first, append=len(keys))
        keys, keyed = keys[first], keyed[first]
        for i, (document, begin, stop) in enumerate(zip(documents.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True)):
            out[document].n += figures[i]
            out[document].text.append(b"".join(written[begin:stop]))
        bounds = np.flatnonzero(np.diff(keyed, prepend=-1, append=-1))
        for document, begin, stop in zip(keyed[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[document].pairs.append((keys[begin:stop], times[begin:stop]))


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, the lowest first; the higher planes, mostly zeros, compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several lists with their counts added up, ascending."""
    if len(pairs) == 1:
        return pairs[0]
    keys, which = np.unique(np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.int64)]), return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, which, np.concatenate([t for _, t in pairs] or [np.zeros(0, np.int64)]))
    return keys, n


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``keep``), ``serial`` (a number of the row), ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and B by group, or with ``digest`` its
    SHA-256), ``pairs`` and ``times`` (distinct linked pairs as ``a * vocabulary of B + b``, and their links, packed)."""
    spark = docs.sparkSession
    shared = SharedVocabulary(spark, byte_tokenizer, plain=True)
    with open(piece_model, "rb") as file:  # a few MB, fixed by the vocabulary
        model = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.encoder(), _piece_encoder(model.value))
        serial = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            found = aligner.run(texts(batch, "__text"))
            columns = [batch.column("row"), pa.array(range(serial, serial + len(found)), pa.int64())]
            serial += len(found)
            good = [f if f.faithful else _Figures() for f in found]
            columns += [pa.array([int(f.n[i]) for f in good], pa.int64()) for i in range(len(_FIGURES))]
            if digest:
                columns.append(pa.array([_sha(f.text) if f.text else "" for f in good], pa.string()))
            else:
                columns.append(pa.array([b"".join(f.text)[:-1].decode() for f in good], pa.string()))
            joined = [_joined(f.pairs) for f in good]
            columns.append(pa.array([pack(np.diff(k, prepend=0)) for k, _ in joined], pa.binary()))
            columns.append(pa.array([pack(n) for _, n in joined], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    source = docs.select(row, docs[text_col].cast("string").alias("__text"))
    numbers = [F.lit(0).cast("bigint").alias(c) for c in ("serial", *_FIGURES)]
    schema = source.select("row", *numbers, F.lit("").alias("groups"), *[F.lit("").cast("binary").alias(c) for c in ("pairs", "times")]).schema
    names = schema.names
    return source.mapInArrow(run, schema)


def _sha(parts: list[bytes]) -> str:
    """Digest of the parts without the last character."""
    sha = hashlib.sha256()
    for part in parts[:-1]:
        sha.update(part)
    sha.update(parts[-1][:-1])
    return sha.hexdigest()


def pair_counts(aligned: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """``pair`` and ``n``, the number of rows that hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        waiting = 0
        for batch in pieces(batches):
            for data in batch.column("pairs").to_pylist():
                fresh.append(np.cumsum(unpack(data)))
                waiting += len(fresh[-1])
            if waiting > held:
                keys, n = _joined([(keys, n), *[(k, np.ones(len(k), np.int64)) for k in fresh]])
                fresh, waiting = [], 0
            if len(keys) > held:
                yield from _count_rows(keys, n)
                keys, n = keys[:0], n[:0]
        yield from _count_rows(*_joined([(keys, n), *[(k, np.ones(len(k), np.int64)) for k in fresh]]))

    return aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _count_rows(keys: np.ndarray, n: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + rows]), pa.array(n[at : at + rows])], names=["pair", "n"])


def _hot_floor(counts: DataFrame, most: int) -> float:
    """The logarithm from which on at most ``most`` pairs have a count as high."""
    bins = counts.groupBy(F.floor(F.log2("n") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
    floor, total = 64 * BINS, 0
    for row in sorted(bins.collect(), reverse=True):  # a row per bin, 8 for each doubling
        total += row["pairs"]
        if total > most:
            return floor
        floor = row["bin"]
    return 0


def rate_links(spark: SparkSession, aligned: DataFrame, width: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` without its packed columns, with ``n_best`` (links whose count is the highest of their A id) and
    ``count_sum`` (counts of all links). ``aligned`` is read twice and should be stored; ``width`` is the vocabulary of B."""
    path = fresh_path(spark, "pair-counts")
    counted = pair_counts(aligned)
    best = F.floor(F.col("pair") / width).alias("a")
    counted.write.option("compression", "zstd").parquet(path)
    counted = spark.read.schema("pair bigint, n bigint").parquet(path)
    tops = counted.groupBy(best).agg(F.max("n").alias("top"))  # a row per token of A
    rated = counted.withColumn("a", best).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    floor = _hot_floor(counted, hot_pairs)
    hot = F.floor(F.log2("n") * BINS) >= floor
    table = rated.filter(hot).toArrow()  # hot_pairs rows at most
    order = np.argsort(table.column("pair").to_numpy())
    arrays = tuple(np.asarray(table.column(c))[order] for c in ("pair", "n", "is_best"))
    sent = spark.sparkContext.broadcast(arrays)
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, bests = sent.value
        for batch in pieces(batches):
            n_best, count_sum, cold, cold_times = [], [], [], []
            for packed, packed_times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                keys, times = np.cumsum(unpack(packed)), unpack(packed_times)
                at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), dtype=bool)
                at = at[known]
                n_best.append(int(times[known][bests[at]].sum()))
                count_sum.append(int((times[known] * counts[at]).sum()))
                cold.append(keys[~known])
                cold_times.append(times[~known])
            columns = [*[batch.column(c) for c in kept], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (cold, cold_times)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum", "cold", "cold_times"])

    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")
    schema = aligned.select(*kept, zero.alias("n_best"), zero.alias("count_sum"), empty.alias("cold"), empty.alias("cold_times")).schema
    here = aligned.mapInArrow(run, schema)
    if floor == 0:  # all pairs are hot, so none is left
        return here.drop("cold", "cold_times")
    path = fresh_path(spark, "rated")
    here.write.option("compression", "zstd").parquet(path)
    here = spark.read.schema(here.schema).parquet(path)
    links = here.select("serial", F.explode(F.arrays_zip("cold", "cold_times")).alias("l")).select("serial", "l.cold", "l.cold_times")
    joined = links.join(rated.filter(~hot), F.col("cold") == F.col("pair"))
    more = joined.groupBy("serial").agg(
        F.sum(F.when(F.col("is_best"), F.col("cold_times")).otherwise(0)).alias("__best"), F.sum(F.col("cold_times") * F.col("n")).alias("__sum")
    )
    both = here.drop("cold", "cold_times").join(more, "serial", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("__best", zero), "count_sum": F.col("count_sum") + F.coalesce("__sum", zero)}
    return both.withColumns(added).drop("__best", "__sum")


def alignment(docs: DataFrame, byte_tokenizer: str, piece_model: str, hot_pairs: int = HOT_PAIRS, **options) -> DataFrame:
    """``align``, stored once, with the ratings of ``rate_links``."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    path = fresh_path(spark, "alignment")
    made = align(docs, byte_tokenizer, piece_model, **options)
    made.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    return rate_links(spark, stored, SentencePieceProcessor(model_file=piece_model).vocab_size(), hot_pairs)
