"""How filters interact: what every filter removes in every order, per part of the corpus.

Each document is reduced to a mask of the filters it fails. Documents of one part and mask are a cell, and the whole
corpus is at most ``2 ** filters`` cells a part, however many documents it holds. A cell then folds across the array of
all orders with ``aggregate`` and ``transform``: step after step it is kept, removed, or found redundant, which gives a
struct of weighted counts per order and step. The structs of a part's cells are merged by elementwise sums.

Spark expressions only. Texts are split once, where they are read; shuffled are rows of some 60 bytes per document (the
text as its SHA-256). Copies of a text are counted before they meet, so a group of any size costs as many rows as it
has parts and labels. NULL and empty texts are the same text; a NULL part is the empty string. A document whose id is
NULL, or is the smallest of its group, is not a copy, and nothing is a copy of a NULL id; rows that repeat the smallest
id are not copies of each other. Labels of an id that occurs repeatedly count if any of them is 1; without a label a
document is neither good nor toxic. A table without rows has no parts, so the result is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the filters, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
WORD = r"[^\x20\x09-\x0D]+"
MARK = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def content_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself; ``text`` must not be NULL."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = lambda w: (
        F.size(w) < MIN_WORDS,
        100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
        100 * capitals.cast("bigint") > MAX_CAPITAL_PERCENT * F.length(text).cast("bigint"),
        text.rlike(MARK),
    )
    bits = lambda w: sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed(w))), F.lit(0))
    return F.transform(F.array(words), bits)[0]  # one array of words serves both filters that read it


def document_masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cells ``(part, mask, n, good, toxic)``: how many documents of a part fail exactly the filters of the mask."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    facts = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        content_mask(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(one("quality"), one("toxic")).withColumnsRenamed({"quality": "good"})
    known = facts.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])

    kind = ["digest", "part", "own", "good", "toxic"]
    by_id = known.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
    )
    # a row per part, label and text: however often a text occurs, its window is as short as that
    both = by_kind.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    single = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    copy_bit = 1 << FILTERS.index("E")
    split = F.array(
        F.struct(F.col("own").alias("mask"), single.alias("n")),
        F.struct((F.col("own") + copy_bit).alias("mask"), (F.col("n") - single).alias("n")),
    )
    cells = both.select("part", "good", "toxic", F.inline(split)).filter("n > 0")
    weighted = lambda c: F.sum(F.col(c) * F.col("n")).alias(c)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighted("good"), weighted("toxic"))


def _steps(orders: Column, n_filters: int) -> Column:
    """The fold of one cell across all orders: a struct of weighted counts per order and step, in order."""
    zero = F.lit(0).cast("bigint")

    def step(before: Column, position: Column) -> Column:
        bit = F.element_at(bits, position + 1)
        fails = F.col("mask").bitwiseAND(bit) != 0
        alive, now = before["alive"], before["alive"] & fails
        weigh = lambda holds, count: F.when(holds, F.col(count)).otherwise(zero)
        counts = F.struct(
            weigh(alive & ~fails, "n").alias("kept"), weigh(now, "n").alias("removed"),
            weigh(~alive & fails, "n").alias("redundant"), weigh(F.col("mask") == bit, "n").alias("unique_fails"),
            weigh(now, "good").alias("good_lost"), weigh(now, "toxic").alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(before["out"], F.array(counts)).alias("out"))

    bits = F.array(*[F.lit(1 << i) for i in range(n_filters)])
    empty = F.array().cast("array<struct<%s>>" % ",".join(f"{c}:bigint" for c in COUNTS))
    start = F.struct(F.lit(True).alias("alive"), empty.alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["out"])))


def audit(cells: DataFrame, filters: Sequence[str] | str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, with the counts of that step's filter and its Shapley total.

    ``cells`` has ``part``, ``mask`` (bit *i*: fails ``filters[i]``), ``n``, ``good`` and ``toxic``. ``shapley`` is what the
    filter removes in all orders together, at whatever step. The orders are a constant of the plan: factorial in the
    number of filters, of which 7 are the most accepted.
    """
    k = len(filters)
    if not 0 < k <= 7:
        raise ValueError(f"{k} filters; from 1 to 7 can be put in every order")
    numbered = list(permutations(range(k)))
    orders = F.expr("array(%s)" % ", ".join(f"array({', '.join(map(str, o))})" for o in numbered))
    folded = cells.select("part", _steps(orders, k).alias("steps"))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    lists = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # 2 ** k lists at most
    rest = F.slice("cells", 2, F.size("cells") - 1)
    summed = lists.select("part", F.aggregate(rest, F.col("cells")[0], lambda a, b: F.zip_with(a, b, add)).alias("steps"))

    flat = F.flatten(orders)
    removed = F.zip_with("steps", flat, lambda s, f: F.struct(f.alias("filter"), s["removed"].alias("removed")))
    total = lambda f: F.aggregate(
        F.filter("pairs", lambda p: p["filter"] == f), F.lit(0).cast("bigint"), lambda a, p: a + p["removed"]
    )
    totals = summed.select("part", "steps", removed.alias("pairs")).select(
        "part", "steps", F.array(*[total(F.lit(i)) for i in range(k)]).alias("totals")
    )
    named = F.lit(list(filters))
    names = F.transform(orders, lambda order: F.array_join(F.transform(order, lambda i: F.element_at(named, i + 1)), ""))
    out = totals.select("part", F.posexplode("steps").alias("at", "s"), "totals")
    own = F.element_at(flat, F.col("at") + 1)
    return out.select(
        "part", F.element_at(names, F.floor(F.col("at") / k).cast("int") + 1).alias("filter_order"), (F.col("at") % k + 1).alias("step"),
        *[F.col("s")[c].alias(c) for c in COUNTS], F.element_at("totals", own + 1).alias("shapley"),
    )
