"""Repeated lines across documents: overlapping pairs by shared lines, patience diff, common blocks cut from the later one.

A line is what stands between line ends, without blanks around it; lines of fewer than ``min_chars`` characters take part in
no search, though they go with a block that surrounds them. The documents' order is their id, NULL first, then content.

A line that several documents hold pairs each later document with the first that holds it, so a line of half of all
documents gives one pair each and never all pairs. A short line goes with the long one next before or after it: the stretch
from that to the short line is a seed of its own, so that a block of two later documents meets the first that holds all of
it, even if other documents held its long lines before. Per pair the rarest of the shared lines is noted. Both documents'
lines are aligned by patience diff: lines that occur once in either, in the longest order that both share, divide the texts;
between them it goes on, and ends of equal lines are matched. An aligned run of lines is a block; blocks with a line of
``min_chars`` or more are deleted from the later document. An alignment has one order and takes a line once, so what it
leaves is aligned again: blocks that stand in another order, or more often, in the later document go too. So a document loses
what a comparison with every earlier document would delete. The first document to hold a line keeps it, whatever is deleted
elsewhere.

Lines are compared by 64-bit digests. NULL texts stay NULL and empty texts empty. Equal rows are equal documents in order,
of which the first keeps its text. A table without rows gives none.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces
from scrubwell.llm.graphs import stored

MIN_CHARS = 20


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in both stretches, in the longest common order."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    matches = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
    ends: list[int] = []  # smallest last place in b of an order of each length
    last: list[int] = []  # the match that has it
    before: list[int] = []
    for k, (_, j) in enumerate(matches):
        n = bisect_left(ends, j)
        before.append(last[n - 1] if n else -1)
        ends[n : n + 1] = [j]
        last[n : n + 1] = [k]
    out: list[tuple[int, int]] = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(matches[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of aligned equal lines, in order."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = _anchors(a, b, a0, a1, b0, b1)
        edges = [(a0 - 1, b0 - 1), *found, (a1, b1)]
        out += found
        if found:
            open_ += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _windows(a: list[int], b: list[int], seeds: set[int]) -> Iterator[tuple[int, int, int]]:
    """For each seed line in ``b``: where ``a`` has it with most of the lines that follow up to the next seed, as place in
    ``a``, place in ``b`` and number of lines."""
    steps: dict[tuple[int, int], tuple[int, int]] = {}  # a tree of the runs in a from each seed: (run before, line) to run, place
    run = -1
    for i, x in enumerate(a):
        if x in seeds:
            run = steps.setdefault((-1, x), (len(steps), i))[0]
        elif run >= 0:
            run = steps.setdefault((run, x), (len(steps), i))[0]
    j = 0
    while j < len(b):
        n = 1
        if b[j] in seeds:
            step = steps[-1, b[j]]
            while j + n < len(b) and b[j + n] not in seeds and (longer := steps.get((step[0], b[j + n]))):
                step, n = longer, n + 1
            yield step[1] - n + 1, j, n
        j += n


def _aligned(a: list[int], b: list[int], places: list[int], long_in_b: list[bool]) -> set[int]:
    """Places in ``b`` of the blocks with a long line when ``a`` is aligned with the lines of ``b`` at ``places``."""
    out: set[int] = set()
    block: list[int] = []
    before = None
    for i, k in [*patience(a, [b[j] for j in places]), (-1, -1)]:
        j = places[k] if k >= 0 else -2
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            out.update(block if any(long_in_b[x] for x in block) else ())
            block = []
        block.append(j)
        before = (i, j)
    return out


def common_blocks(a: list[int], b: list[int], long_in_b: list[bool]) -> list[int]:
    """Places in ``b`` of aligned blocks that hold a long line.

    An alignment has one order and takes a line of ``a`` once, so it is peeled: what is left of ``b`` is aligned again, as long
    as that takes half of its lines of ``min_chars`` that ``a`` holds. Blocks that still cross or repeat each other are then
    aligned one by one, each with the stretch of ``a`` that shares most lines with it, forwards and backwards.
    """
    held = set(a)
    seeds = {x for x, long in zip(b, long_in_b, strict=True) if long and x in held}
    out: set[int] = set()
    left, n_seeds = [j for j, x in enumerate(b) if x in held], 2 * len(b)
    while (now := sum(b[j] in seeds for j in left)) and 2 * now <= n_seeds:
        out |= _aligned(a, b, left, long_in_b)
        left, n_seeds = [j for j in left if j not in out], now
    if not left:
        return sorted(out)
    last = len(b) - 1
    for back in (False, True):
        turned = slice(None, None, -1 if back else 1)
        own, earlier, long = b[turned], a[turned], long_in_b[turned]
        for i, j, n in _windows(earlier, own, seeds):
            places = range(j, j + n)
            if any((last - k if back else k) not in out for k in places):
                found = _aligned(earlier[i : i + n], own[j : j + n], list(range(n)), long[j : j + n])
                out |= {last - j - k if back else j + k for k in found}
    return sorted(out)


def _runs(lines: list[int], long: list[bool]) -> set[int]:
    """64-bit digests of the stretches from a long line to each short line after it, up to the next long one."""
    out, run = set(), None
    for x, is_long in zip(lines, long, strict=True):
        if is_long:
            run = x
        elif run is not None:
            run = xxhash.xxh3_64_intdigest(struct.pack("<qq", run, x)) - (1 << 63)
            out.add(run)
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document with what is deleted from it: ``row`` (the document's columns, or those in ``keep``), ``n_lines``,
    ``deleted`` (places of lines, from 0), ``rarest`` (in how many documents the rarest line of its overlaps occurs, NULL
    without overlap) and ``kept_text``.

    Shuffled are digests: one per document and line, then both documents' lines per pair; whole texts only to put the
    deletions to them.
    """
    id_, text = docs[id_col].cast("bigint"), docs[text_col].cast("string")
    split = F.transform(F.split(text, "\n", -1), lambda line: F.trim(line))
    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    base = docs.select(row, id_.alias("id"), text.alias("text"), F.xxhash64(text).alias("content"), split.alias("lines"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            numbers = pa.array(range(serial, serial + batch.num_rows), pa.int64())
            serial += batch.num_rows
            runs = []
            for own, long in zip(batch.column("lines").to_pylist(), batch.column("long").to_pylist(), strict=True):
                own, long = own or [], long or []
                some = any(long) and not all(long)
                runs.append([*_runs(own, long), *(~x for x in _runs(own[::-1], long[::-1]))] if some else [])
            arrays = [*batch.columns, numbers, pa.array(runs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "serial", "runs"])

    long_ = F.transform("lines", lambda line: F.length(line) >= min_chars)
    lined = base.select("row", "id", "content", "text", F.transform("lines", lambda line: F.xxhash64(line)).alias("lines"), long_.alias("long"))
    numbered = lined.withColumns({"serial": F.lit(0).cast("bigint"), "runs": F.array().cast("array<bigint>")})
    lined = stored(lined.mapInArrow(number, numbered.schema), "lines")

    place = F.struct("id", "content", "serial")  # order of documents; NULL ids first
    seeds = lined.select(place.alias("place"), F.explode(F.array_distinct(F.filter("lines", lambda line, i: F.get("long", i)))).alias("line"))
    seeds = seeds.select("place", "line", F.lit(False).alias("is_run"))
    seeds = seeds.union(lined.select(place, F.explode("runs"), F.lit(True)))
    firsts = seeds.groupBy("line", "is_run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    held = seeds.join(stored(firsts, "first-holders"), ["line", "is_run"]).filter("place <> first")
    pairs = stored(held.groupBy("place", "first").agg(F.min(F.when(~F.col("is_run"), F.col("holders"))).alias("rarest")), "pairs")
    side = lined.select(F.col("serial"), "lines", "long")
    early = side.select(F.col("serial").alias("first_serial"), F.col("lines").alias("early"))
    wide = pairs.select(F.col("place.serial").alias("serial"), F.col("first.serial").alias("first_serial"), "rarest")
    wide = wide.join(early, "first_serial").join(side, "serial").select("serial", "rarest", "early", "lines", "long")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("early", "lines", "long")), strict=True)
            deleted = [common_blocks(*r) for r in rows]
            arrays = [batch.column("serial"), batch.column("rarest"), pa.array(deleted, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["serial", "rarest", "deleted"])

    aligned = wide.mapInArrow(align, "serial bigint, rarest bigint, deleted array<int>")
    # A document has no more partners than lines and stretches.
    cut = aligned.groupBy("serial").agg(F.min("rarest").alias("rarest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))
    # Always by shuffle: how many documents lose lines has no bound, and the plan should not change with it.
    joined = lined.select("row", "text", "serial").join(stored(cut, "deletions").hint("merge"), "serial", "left")
    deleted = F.coalesce("deleted", F.array().cast("array<int>"))
    own = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), deleted), lambda i: F.get(own, i))
    return joined.select(
        "row", F.coalesce(F.size(own), F.lit(0)).alias("n_lines"), deleted.alias("deleted"), "rarest",
        F.when(F.size(deleted) > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("kept_text"),
    )
