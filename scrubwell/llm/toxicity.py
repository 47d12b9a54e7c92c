"""Toxic documents by weak supervision: many voters, a generative model of how far to trust them, a linear classifier.

1. A bounded sample of labelled documents yields lexicons: words and word stems that occur in toxic documents far more
   often than chance would have it (likelihood ratio).
2. Voters say toxic, clean or nothing about every document: halves of the learned lexicons, a fixed list, the number of
   different hits, and patterns of address, emphasis and shouting.
3. How often each combination of votes occurs is counted over all documents (and apart for the labelled sample). On these
   counts a generative model is fitted by expectation maximisation: the class gives the votes, and voters depend on each
   other along a tree that is grown where votes are correlated within a class. So voters that repeat each other count once.
4. A logistic regression on lexicon terms and patterns is trained on the model's posterior labels, and scores each text.

Only labels of rows with ``crc32(doc_id) % 3 != 1`` are ever read. Several labels of one document count as toxic if one of
them is. NULL and empty texts get the score of a text without any term. Without labels, the fixed list and the patterns
remain. A table without rows gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces, text_bytes
from scrubwell.llm.graphs import stored
from scrubwell.llm.minhash import WordHashes, shingle_hashes
from scrubwell.llm.words import split_words

# Bounds of what is learned from: labelled documents, and documents that train the classifier.
MAX_LABELLED = 20_000
MAX_TRAINING = 20_000
# The likelihood ratio (of a term's rate in toxic documents) that terms of the lexicons must reach.
EVIDENCE = 25.0
THRESHOLD = 0.7

# Common English insults.
INSULTS = (
    "bastard clown coward creep crap cretin degenerate despicable dimwit disgusting dumb dumbass filth filthy fool garbage "
    "idiot idiotic imbecile jerk loser moron moronic pathetic pig rat retard scum scumbag stupid trash ugly vermin vile "
    "worthless wretch"
).split()
STEMS = (4, 5, 6, 7)
_ADDRESS = re.compile(rb"\b(?:you|u)(?:'re|r)?\s+(?:are\s+)?(?:all\s+)?(?:a|an|such|so|just|nothing)\b|\bshut up\b|\bgo to hell\b", re.I)
_EMPHASIS = re.compile(rb"!{2,}|\?!|!\?")
PATTERNS = ("?address", "?emphasis", "?shouting")
# Shares of a text's words that are lexicon words, in steps.
RATES = {"?rate 0.25%": 0.0025, "?rate 0.5%": 0.005, "?rate 0.75%": 0.0075, "?rate 1%": 0.01, "?rate 1.5%": 0.015, "?rate 2%": 0.02, "?rate 4%": 0.04}
MARKS = (*PATTERNS, *RATES)
VOTERS = ("learned words", "stems a", "stems b", "fixed list", "several words", "many words", "address", "emphasis or shouting")
# From this share of its words on, a group of lexicon words counts.
VOTING_RATE = 0.005


def is_training(doc_id: Column) -> Column:
    """Whether a row's label may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _word_terms(word: bytes) -> list[str]:
    """The word, and its stems marked as such."""
    text = word.decode("utf-8", "ignore")
    return [text, *(f"{text[:n]}~" for n in STEMS if len(text) > n)]


class _Terms(dict):
    """Terms of a word, restricted to a lexicon if there is one; remembered within bounds."""

    def __init__(self, lexicon: frozenset[str] | None = None):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        terms = _word_terms(word)
        value = self[word] = tuple(terms if self.lexicon is None else [t for t in terms if t in self.lexicon])
        return value


def text_terms(text: bytes, terms: _Terms) -> tuple[set[str], int, list[tuple[str, ...]]]:
    """Distinct terms and marks of a whole text, its number of words, and the terms of each word that has any."""
    words = split_words(text)
    hits = [own for own in map(terms.__getitem__, words) if own]
    found = set().union(*hits)
    found.update(name for name, rate in RATES.items() if hits and len(hits) >= rate * len(words))
    if _ADDRESS.search(text):
        found.add(PATTERNS[0])
    if _EMPHASIS.search(text):
        found.add(PATTERNS[1])
    capitals = len(text) - len(text.translate(None, bytes(range(65, 91))))
    if len(words) >= 5 and capitals > 0.3 * len(text):
        found.add(PATTERNS[2])
    return found, len(words), hits


def votes(found: set[str], n_words: int, hits: list[tuple[str, ...]], learned: frozenset[str]) -> int:
    """The voters' verdicts as a number in base 3: 0 nothing, 1 clean, 2 toxic; texts of a few words get no clean ones."""
    stem_half = lambda t: t.endswith("~") and 1 + sum(t[:4].encode()) % 2
    enough = VOTING_RATE * n_words
    of_words, of_a, of_b = (sum(any(t in learned and stem_half(t) == k for t in own) for own in hits) for k in (False, 1, 2))
    verdicts = [
        of_words and of_words >= enough, of_a and of_a >= enough, of_b and of_b >= enough, not found.isdisjoint(_FIXED),
        len(set(hits)) >= 3 and len(hits) >= 2 * enough, hits and len(hits) >= 3 * enough, PATTERNS[0] in found, not found.isdisjoint(PATTERNS[1:]),
    ]
    code = 0
    for toxic in verdicts:
        code = code * 3 + (2 if toxic else 1 if n_words >= 5 else 0)
    return code


_FIXED = frozenset(INSULTS)
_COUNTS = pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
_VOTES = pa.schema([("code", pa.int64()), ("mark", pa.int64()), ("n", pa.int64())])
_POSTERIOR = pa.schema([("terms", pa.list_(pa.string())), ("p", pa.float64())])


@dataclass
class LabelModel:
    """Votes given the class: each voter depends on the class and on one other voter, its parent in a tree."""

    prior: float
    order: list[int]
    parent: list[int]
    tables: list[np.ndarray]
    accuracy: list[float] = field(default_factory=list)
    correlation: np.ndarray | None = None

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of toxic for combinations of votes."""
        v = unpack_votes(codes)
        odds = np.full(len(v), math.log(self.prior) - math.log1p(-self.prior))
        for i in self.order:
            above = v[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(v), dtype=int)
            odds += np.log(self.tables[i][1, above, v[:, i]]) - np.log(self.tables[i][0, above, v[:, i]])
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60)))


def unpack_votes(codes: np.ndarray) -> np.ndarray:
    powers = 3 ** np.arange(len(VOTERS) - 1, -1, -1)
    return np.asarray(codes, dtype=np.int64)[:, None] // powers % 3


def _tree(v: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[int]]:
    """The tree of greatest mutual information between voters within a class (Chow and Liu)."""
    k = v.shape[1]
    gain = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            for w in weights:
                joint = np.full((3, 3), 1e-9)
                np.add.at(joint, (v[:, i], v[:, j]), w)
                p = joint / weights.sum()
                independent = p.sum(1, keepdims=True) * p.sum(0, keepdims=True) / p.sum()
                gain[i, j] += (p * np.log(p / independent)).sum()
    gain += gain.T
    parent, order, reach = [-1] * k, [0], {j: 0 for j in range(1, k)}
    while reach:
        j = max(reach, key=lambda x: gain[x, reach[x]])
        parent[j] = reach.pop(j)
        order.append(j)
        for x in reach:
            if gain[x, j] > gain[x, reach[x]]:
                reach[x] = j
    return order, parent


def fit_label_model(codes: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over counted combinations of votes; labelled documents keep their class."""
    v = unpack_votes(codes)
    voted = np.maximum((v > 0).sum(1), 1)
    q = np.clip((v == 2).sum(1) / voted, 0.02, 0.98)
    model = None
    for step in range(rounds):
        weights = np.stack([unlabelled * (1 - q) + clean, unlabelled * q + toxic]) + 1e-12
        if step % 10 == 0:
            order, parent = _tree(v, weights)
        tables = []
        for i in range(v.shape[1]):
            table = np.full((2, 3, 3), 0.1)
            above = v[:, parent[i]] if parent[i] >= 0 else np.zeros(len(v), dtype=int)
            for y in (0, 1):
                np.add.at(table[y], (above, v[:, i]), weights[y])
            tables.append(table / table.sum(axis=2, keepdims=True))
        prior = float(np.clip(weights[1].sum() / weights.sum(), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, order, parent, tables)
        q = model.posterior(codes)
    for i in range(v.shape[1]):
        right = weights[1][v[:, i] == 2].sum() + weights[0][v[:, i] == 1].sum()
        model.accuracy.append(float(right / max(weights[:, v[:, i] > 0].sum(), 1e-9)))
    within = np.zeros((v.shape[1],) * 2)
    for w in weights:
        centred = v - (v * w[:, None]).sum(0) / w.sum()
        within += (centred * w[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(within), 1e-12))
    model.correlation = within / spread[:, None] / spread[None, :]
    return model


@dataclass
class ToxicityModel:
    """What scoring needs: a weight per term of the lexicons, which are learned from the bounded labelled sample."""

    weights: dict[str, float]
    intercept: float
    label_model: LabelModel


def _sampled(key: Column, purpose: str, share: float) -> Column:
    """Whether a digest of ``key`` is among the lowest ``share`` of its 63 bits."""
    lowest = F.shiftrightunsigned(F.xxhash64(key, F.lit(purpose)), 1)
    return lowest <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))


def _labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int) -> DataFrame:
    """About ``bound`` labelled documents at most, chosen by digest of the id: text and toxic (0 or 1)."""
    one = labels.filter(is_training(F.col("doc_id")) & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
    one = one.agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    share = min(1.0, bound / max(1, one.count()))
    chosen = one.filter(_sampled(F.col("label_id"), "sample", share))
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic")  # ``bound`` rows of 12 bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            least = [int(shingle_hashes(split_words(t), hashes).min(initial=(1 << 64) - 1)) >> 1 for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "least"])

    # Copies and most near copies share their least shingle; one of them speaks for all, else their words would look telling.
    return texts.mapInArrow(sign, "text string, toxic int, least bigint").dropDuplicates(["toxic", "least"]).drop("least")


def _learn_terms(sample: DataFrame, evidence: float) -> list[str]:
    """Terms of toxic documents, from numbers of documents per term and class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = _Terms(), (Counter(), Counter())

        def drained() -> pa.RecordBatch:
            names = list({*counts[0], *counts[1]})
            values = {"term": names, "clean": [counts[0][t] for t in names], "toxic": [counts[1][t] for t in names]}
            out = pa.RecordBatch.from_pydict(values, schema=_COUNTS)
            for c in counts:
                c.clear()
            return out

        for batch in pieces(batches):
            for text, toxic in zip(text_bytes(batch), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(text_terms(text, terms)[0])
            if len(counts[0]) > 100_000:
                yield drained()
        yield drained()

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return []
    by_term = sample.mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    # Likelihood ratio of two rates against one.
    rate = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    a, b, n0, n1 = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(n[0])), F.lit(float(n[1]))
    apart = rate(a, n0) + rate(b, n1) + rate(n0 - a, n0) + rate(n1 - b, n1)
    alike = rate(a + b, n0 + n1) + rate(n0 + n1 - a - b, n0 + n1)
    scored = by_term.select("term", "a", "b", (2 * (apart - alike)).alias("g"))
    wanted = scored.filter((F.col("g") >= evidence) & (b / n1 > 4 * a / n0))
    return [r["term"] for r in wanted.collect()]


def _vote_counts(texts: DataFrame, learned: frozenset[str], label: str | None = None) -> Counter:
    """How often each combination of votes occurs (with a label: per label). At most 3 ** voters of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = _Terms(learned | _FIXED), Counter()
        for batch in pieces(batches):
            marks = batch.column(label).to_pylist() if label else [0] * batch.num_rows
            for text, mark in zip(text_bytes(batch), marks, strict=True):
                counts[votes(*text_terms(text, terms), learned), mark] += 1
        keys = list(counts)
        values = {"code": [c for c, _ in keys], "mark": [m for _, m in keys], "n": [counts[k] for k in keys]}
        yield pa.RecordBatch.from_pydict(values, schema=_VOTES)

    counted = texts.mapInArrow(count, "code bigint, mark bigint, n bigint").groupBy("code", "mark").agg(F.sum("n").alias("n"))
    return Counter({(r["code"], r["mark"]): r["n"] for r in counted.collect()})


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING,
    evidence: float = EVIDENCE,
) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id and a 0/1 column)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(_labelled_sample(docs, labels, label_col, max_labelled), "labelled")
    learned = frozenset(_learn_terms(sample, evidence)) - {*MARKS}
    every, marked = _vote_counts(docs.select("text"), learned), _vote_counts(sample, learned, "toxic")
    codes = np.array(sorted({c for c, _ in [*every, *marked]}), dtype=np.int64)
    clean, toxic = (np.array([marked[c, y] for c in codes], dtype=float) for y in (0, 1))
    rest = np.maximum(np.array([every[c, 0] for c in codes], dtype=float) - clean - toxic, 0.0)
    if not len(codes):
        return ToxicityModel({}, -4.0, LabelModel(0.01, [], [], []))
    model = fit_label_model(codes, rest, clean, toxic)

    # Posterior labels of a bounded sample; a document counts for both classes, by its probability.
    share = min(1.0, max_training / max(1, sum(every.values())))
    more = docs.filter(_sampled(F.col("doc_id"), "training", share))
    vocabulary = sorted(learned | _FIXED | {*MARKS})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(learned | _FIXED)
        for batch in pieces(batches):
            found = [text_terms(t, terms) for t in text_bytes(batch)]
            p = model.posterior(np.array([votes(*f, learned) for f in found], dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"terms": [sorted(f[0]) for f in found], "p": p}, schema=_POSTERIOR)

    labelled = stored(more.select("text").union(sample.select("text")).mapInArrow(label, "terms array<string>, p double"), "posterior")
    if labelled.isEmpty():
        return ToxicityModel({}, -4.0, model)
    as_class = lambda y, weight: F.struct(F.lit(y).alias("label"), weight.alias("weight"))
    both = labelled.select("terms", F.explode(F.array(as_class(1.0, F.col("p")), as_class(0.0, 1 - F.col("p")))).alias("as"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "features")
    rows = vectors.setBinary(True).transform(both.select("terms", "as.label", "as.weight").filter("weight > 0.000001"))
    fitted = LogisticRegression(maxIter=60, regParam=3e-4, weightCol="weight", standardization=False).fit(rows)
    weights = {t: float(w) for t, w in zip(vocabulary, fitted.coefficients.toArray(), strict=True)}
    return ToxicityModel(weights, float(fitted.intercept), model)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``) and ``score``, the probability of toxic. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        terms = _Terms(frozenset(weights) - {*MARKS})
        for batch in pieces(batches):
            sums = [intercept + math.fsum(weights.get(t, 0.0) for t in text_terms(x, terms)[0]) for x in text_bytes(batch)]
            scores = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], names=["row", "score"])

    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    source = docs.select(row, docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, source.select("row", F.lit(0.0).alias("score")).schema)


def predictions(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ids, whether their label was held out, scores and verdicts."""
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), F.coalesce(~is_training(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents scored below ``threshold``, with their own columns."""
    return score(docs, train(docs, labels, **options)).filter(F.col("score") < threshold).select("row.*")
