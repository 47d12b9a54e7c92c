"""Near-duplicate documents by ProbMinHash sketches, banding and verification.

Shingles are five consecutive words (fewer words form one shingle); words are runs of letters, digits and non-ASCII
characters with A-Z lowered. A shingle weighs ``1 + ln(occurrences)``. The sketch gives every shingle a Poisson process
whose rate is its weight; each arrival falls on a random register, which keeps the shingle that came first. Two
sketches agree in a register with the probability Jaccard similarity of the weighted shingles. A shingle is done with
once its next arrival is later than the last register's first, so most of them are after one or two arrivals.

Documents of equal words are one class from the start, found by digest. Classes that share a band are candidates; a pair
is linked if the Jaccard similarity of its distinct shingles is at least ``similarity``, computed on the whole texts.
Documents without words (NULL and empty texts among them) are in no group. Repeated rows are copies like any other:
one row of a group is kept, that of the smallest id (NULL before all). A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.llm.batches import ids_and_texts, pieces, row_digest, text_bytes
from scrubwell.llm.graphs import components, stored
from scrubwell.llm.words import split_words

SHINGLE = 5
SIMILARITY = 0.8
# 24 bands of 8 registers: a pair of similarity 0.8 shares a band with probability 0.988, one of 0.9 with 0.999998, one of
# 0.5 with 0.09, one of 0.3 with 0.0016.
BANDS, ROWS = 24, 8
# Rounds of comparing a bucket's members with a centre before those left are compared by their rarest shingles.
STAR_ROUNDS = 3
# Holders of a shingle that meet as many others in one group of that comparison.
BLOCK = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("serial", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))]
)
SKETCH = "doc_id bigint, row bigint, serial bigint, digest binary, n int, bands array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], hashes: dict) -> np.ndarray:
    """64-bit hashes of all shingles of a text, in order."""
    own = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(own))
    out = np.full(len(own) - width + 1 if width else 0, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _STEP + own[k : k + len(out)])
    return out


def sketches(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """The ProbMinHash registers of all documents: per register the element whose process arrived first.

    ``owner`` says which document an element belongs to. All documents advance together, one arrival of each
    unfinished element at a time.
    """
    first = np.full(documents * registers, np.inf)
    which = np.zeros(documents * registers, dtype=np.uint64)
    last = np.full(documents, np.inf)
    arrived = np.zeros(len(elements))
    offset = np.uint64(0)
    while len(elements):
        offset = np.uint64(int(offset) + int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        drawn = _mix(elements + offset)
        arrived = arrived - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weights
        on_time = arrived < last[owner]
        elements, weights, owner, arrived, drawn = (x[on_time] for x in (elements, weights, owner, arrived, drawn))
        place = (_mix(drawn + _STEP) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        slot = owner * registers + place.astype(np.int64)
        np.minimum.at(first, slot, arrived)
        won = first[slot] == arrived
        which[slot[won]] = elements[won]
        last = first.reshape(documents, registers).max(axis=1)
    return which.reshape(documents, registers)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, digest of the row, a serial number, digest of its words, number of distinct shingles and
    a key per band. Documents without words have no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        serial = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            words = [split_words(t) for t in text_bytes(batch)]
            found = [np.unique(shingle_hashes(w, hashes), return_counts=True) for w in words]
            counts = [len(e) for e, _ in found]
            owner = np.repeat(np.arange(len(words)), counts)
            weights = 1.0 + np.log(np.concatenate([n for _, n in found]))
            registers = sketches(np.concatenate([e for e, _ in found]), weights, owner, len(words), bands * rows)
            keys = np.zeros((len(words), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(rows):
                keys = _mix(keys * _STEP + registers.reshape(len(words), bands, rows)[:, :, k])
            columns = [
                batch.column("doc_id"), batch.column("row"), np.arange(serial, serial + len(words)),
                [hashlib.md5(b" ".join(w)).digest() if w else None for w in words], counts,
                [list(k) if w else [] for k, w in zip(keys.view(np.int64), words, strict=True)],
            ]
            serial += len(words)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, _SKETCH, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SKETCH)

    source = ids_and_texts(docs, id_col, text_col)
    return source.select("doc_id", row_digest(F.col("doc_id"), F.col("text")).alias("row"), "text").mapInArrow(run, SKETCH)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough, compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        centre, centre_set = None, None
        for batch in pieces(batches, 64):
            keep = []
            rights = batch.column("b").to_pylist()
            for text_a, b, text_b in zip(text_bytes(batch, "text_a"), rights, text_bytes(batch, "text_b"), strict=True):
                if b != centre:  # rows come sorted by their centre
                    centre, centre_set = b, np.unique(shingle_hashes(split_words(text_b), hashes))
                own = np.unique(shingle_hashes(split_words(text_a), hashes))
                both = len(np.intersect1d(own, centre_set, assume_unique=True))
                keep.append(both >= similarity * (len(own) + len(centre_set) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _near_enough(a: str, b: str, similarity: float):
    """Numbers of distinct shingles that admit the similarity."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``row``, ``class_id`` (the smallest id of its group), ``class_size``, ``kept``.

    Shuffled are keys of 24 bytes per band and distinct text, and once the texts that share a band with another. In a
    bucket, members are first compared with its centre, the one that shares most bands: as many pairs as members. A centre
    has then met everyone and leaves the bucket; a bucket is done when all that are left in it are connected. After some
    rounds, what is still apart meets by a prefix filter over its whole texts, which finds every pair that is similar
    enough, so no link between different texts that share a bucket is lost.
    """
    made = stored(sketch(docs, bands, rows, id_col, text_col), "sketches")
    me = F.struct("doc_id", "row", "serial")
    classes = made.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(me).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    keys = classes.select("digest", "n", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = stored(keys.join(shared, "key"), "members")
    degree = members.groupBy("digest").agg(F.sum("size").alias("degree"))
    members = stored(members.join(degree, "digest").select("key", "digest", "n", "degree"), "members")

    first = classes.join(degree.select("digest"), "digest", "left_semi").select("digest", "first.doc_id", "first.row")
    source = ids_and_texts(docs, id_col, text_col)
    source = source.select(F.col("doc_id").alias("__id"), row_digest(F.col("doc_id"), F.col("text")).alias("__row"), "text")
    found = source.join(first, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row")))
    texts = stored(found.groupBy("digest").agg(F.first("text").alias("text")), "texts")

    links, seen, state = None, None, members.withColumn("component", F.col("digest"))
    for number in range(STAR_ROUNDS + 1):
        if number < STAR_ROUNDS:
            centres = stored(_centres(state), "centres")
            pairs = _star_pairs(state, centres, similarity)
        else:
            pairs = _prefix_pairs(stored(_prefixes(state, texts, similarity), "prefixes"), similarity)
        if seen is not None:
            either = (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high"))
            pairs = pairs.join(seen, either, "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
            seen = done if seen is None else seen.union(done)
            new = stored(_verified(pairs, texts, similarity), "links")
            links = new if links is None else links.union(new)
        if number == STAR_ROUNDS:
            break
        left = state.drop("component").join(centres.select("key", "centre.digest"), ["key", "digest"], "left_anti")
        if links is not None:
            left = left.join(stored(components(links, "a", "b"), "labels").withColumnRenamed("node", "digest"), "digest", "left")
            left = left.withColumn("component", F.coalesce("component", "digest"))
        else:
            left = left.withColumn("component", F.col("digest"))
        left = stored(left, "members")
        apart = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        state = stored(left.join(apart.select("key"), "key"), "apart")
        if state.isEmpty():
            break
    if links is None:
        roots = classes.withColumn("root", F.col("digest"))
    else:
        labels = stored(components(links, "a", "b"), "labels")
        roots = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("component", "digest"))
    groups = roots.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("copies").alias("class_size"))
    of_class = stored(roots.select("digest", "root").join(groups, "root").select("digest", "keeper", "class_size"), "groups")
    grouped = made.select("doc_id", "row", "serial", "digest").join(of_class, "digest", "left")
    return grouped.select(
        "doc_id", "row", F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce(F.col("keeper").eqNullSafe(me) | F.col("keeper").isNull(), F.lit(True)).alias("kept"),
    )


def _centres(state: DataFrame) -> DataFrame:
    """The member of highest degree of each bucket."""
    return state.groupBy("key").agg(F.max(F.struct("degree", "digest", "n", "component")).alias("centre"))


def _star_pairs(state: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """Members with the centre of their bucket, if they are not connected with it yet."""
    joined = state.join(centres, "key").filter(F.col("component") != F.col("centre.component"))
    fit = joined.filter(_near_enough("n", "centre.n", similarity))
    return fit.select(F.col("digest").alias("a"), F.col("centre.digest").alias("b")).distinct()


def _prefixes(state: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each distinct text of ``state`` that another of them holds: ``key``, ``digest``, ``n``,
    ``component``, its place ``at`` in the text's order, and whether it is among the ``short`` prefix.

    Shingles are ordered by the number of these texts that hold them, then by hash. Two texts of the similarity share one of
    their first ``n - ceil(s n) + 1`` shingles, and that one is among the first ``n - ceil(2 s n / (1 + s)) + 1`` of the text
    with fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 64):
            own = [np.unique(shingle_hashes(split_words(t), hashes)).view(np.int64) for t in text_bytes(batch)]
            for digest, values in zip(batch.column("digest").to_pylist(), own, strict=True):
                for start in range(0, len(values), 100_000):
                    part = pa.array(values[start : start + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(part), pa.binary()), part], names=["digest", "key"])

    left = stored(state.select("digest", "n", "component").distinct(), "left")
    shingles = stored(texts.join(left.select("digest"), "digest").select("digest", "text").mapInArrow(run, "digest binary, key bigint"), "shingles")
    held = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
    counted = shingles.join(stored(held.filter("holders > 1"), "shared"), "key").join(left, "digest")
    # Shingles that no other text holds come first; they never meet, so they are only counted.
    own = counted.groupBy("digest").agg(F.count(F.lit(1)).alias("common"))
    at = F.row_number().over(Window.partitionBy("digest").orderBy("holders", "key")) + F.col("n") - F.col("common")
    length = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    placed = counted.join(own, "digest").withColumn("at", at).filter(F.col("at") <= length(F.lit(similarity)))
    short = F.col("at") <= length(F.lit(2 * similarity / (1 + similarity)))
    return placed.select("key", "digest", "n", "component", "at", short.alias("short"))


def _prefix_pairs(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Pairs that share a shingle of their prefixes, are not connected yet and can still be similar enough.

    Of a pair, the text with fewer shingles (of equal ones either) has the shared shingle in its short prefix, and one is
    outside the largest component of the shingle's holders. Those outside, and all holders, are dealt into blocks, and each
    two blocks meet on their own, so that a frequent shingle is the work of many tasks.
    """
    sizes = prefixes.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.max("short").alias("short"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("size"), F.max("short").alias("short")
    )
    blocks = lambda size: F.ceil(size / F.lit(BLOCK)).cast("int")
    largest = largest.filter("short").select(
        "key", F.col("top.component").alias("top"), blocks(F.col("size") - F.col("top.members")).alias("lefts"), blocks(F.col("size")).alias("rights")
    ).filter("lefts > 0")
    dealt = prefixes.join(stored(largest, "largest"), "key").withColumn("hash", F.xxhash64("digest"))
    place = lambda number: F.pmod("hash", number).cast("int")
    numbers = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    side = lambda s: [F.col(old).alias(f"{new}{s}") for old, new in (("digest", ""), ("n", "n_"), ("component", "c_"), ("at", "at_"), ("short", "short_"))]
    left = dealt.filter("component <> top").select("key", *side("a"), place("lefts").alias("x"), numbers("rights").alias("y"))
    inside = (F.col("component") == F.col("top")).alias("inside")
    right = dealt.select("key", *side("b"), inside, numbers("lefts").alias("x"), place("rights").alias("y"))
    once = F.col("inside") | (F.col("a") < F.col("b"))
    fewer = (F.col("short_a") & F.expr("n_a <= n_b")) | (F.col("short_b") & F.expr("n_b <= n_a"))
    # Before the first shared shingle there is none, behind it as many as the shorter rest.
    most = 1 + F.least(F.expr("n_a - at_a"), F.expr("n_b - at_b"))
    enough = most >= similarity / (1 + similarity) * F.expr("n_a + n_b") - 1e-9
    joined = left.join(right, ["key", "x", "y"]).filter((F.col("c_a") != F.col("c_b")) & once & fewer & enough)
    return joined.filter(_near_enough("n_a", "n_b", similarity)).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with its own columns."""
    decided = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "decided")
    fate = decided.groupBy("doc_id", "row").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.min("kept").alias("all_kept"))
    fate = stored(fate.filter("NOT all_kept"), "fates")
    id_, text = docs[id_col].cast("bigint"), docs[text_col].cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), id_.alias("__id"), row_digest(id_, text).alias("__row"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row"))
    left = rows.join(fate.filter("NOT kept"), same, "left_anti")
    repeated = fate.filter("kept")  # rows that occur more than once, one of which stays
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["__id", "__row"])
        left = left.join(repeated, same, "left_anti").union(once)
    return left.select("whole.*")
