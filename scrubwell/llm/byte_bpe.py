"""Byte-level BPE encoding and decoding: speculate on the longest tokens, verify every adjacent pair, merge what fails.

Words are the pieces of the pre-tokenizer. For a batch of new words, all words walk a trie of the vocabulary together
and take the longest token at each place. Such a proposal is the tokenizer's result exactly if every token is what
merging its own bytes gives and no merge would have fired across any boundary of two tokens. The last is decided for
all distinct pairs at once: undoing the merges of both tokens latest first shows every two pieces that ever met at the
boundary, and one of them fired if its rank is lower than those of the merges that used the pieces up. Only words with
a failing pair are merged step by step.

Words are encoded once per batch and remembered by the worker process within bounds. Texts are cut between words into
segments of bounded size, so a text of any length takes little memory beyond its ids. NULL and empty texts have no ids,
a table without rows gives none, and repeated rows are encoded each for itself. Strings of the file's added tokens
inside a text are those tokens, as the library has it, unless ``plain`` asks for ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces, texts
from scrubwell.llm.tokenizer import read_spec

# Fixed values of the format: the pre-tokenizer's pattern, the same for ASCII texts, and the characters for which the
# pattern means the same in every version of Unicode since they were all assigned long ago.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_SETTLED = "\u0000-՗֐-ۿऀ-௿Ḁ-₎₠-⯿　-꒏가-힣\U0001f300-\U0001f5ff"
NEVER = np.int64(1) << 62
# Characters of a segment, and of the segments whose words are encoded together.
SEGMENT = 1 << 16
GROUP = 1 << 20
# Longer words walk the trie alone and are not remembered.
LONG_WORD = 64
MEMORY = 250_000

_unicode_words = regex.compile(PATTERN).findall
_ascii_words = re.compile(_ASCII, re.A).findall
_unsettled = re.compile(f"[^{_SETTLED}]").search
_word_start = re.compile(r"\S(?=\s)")


class Vocabulary(NamedTuple):
    """What encoding needs of a tokenizer file, in a few MB that its vocabulary bounds."""

    tokens: list  # bytes by id
    special: dict  # ids of added tokens by their text
    byte_ids: np.ndarray  # id by byte
    left: np.ndarray  # the two tokens that a token was merged from, and the rank of that merge; -1 for bytes
    right: np.ndarray
    rank: np.ndarray
    merge_keys: np.ndarray  # left * size + right, sorted, beside the merges' ranks and results
    merge_ranks: np.ndarray
    merge_ids: np.ndarray
    trie_keys: np.ndarray  # node * 256 + byte, sorted; the child of entry i is node i + 1
    accepts: np.ndarray  # by node, the token that ends there, or -1


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters mean themselves, the
    others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _fires(v: Vocabulary, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether some merge across the boundary of tokens ``x`` and ``y`` comes before those that made them, and before a
    merge of rank ``limit`` of the two."""
    fired = np.zeros(len(x), dtype=bool)
    lane = np.arange(len(x))
    used_x, used_y = limit.copy(), limit.copy()  # ranks of the merges that use the pieces up
    size = np.int64(len(v.rank))
    if not len(v.merge_keys):
        return fired
    while len(lane):
        at, known = _find(v.merge_keys, x * size + y)
        ranks = np.where(known, v.merge_ranks[at], NEVER)
        now = (ranks < used_x) & (ranks <= used_y)  # of two alike, the merge further left is first
        now &= ranks < NEVER
        fired[lane[now]] = True
        rank_x, rank_y = v.rank[x], v.rank[y]
        go = ~now & (np.maximum(rank_x, rank_y) >= 0)
        lane, x, y, used_x, used_y, rank_x, rank_y = (c[go] for c in (lane, x, y, used_x, used_y, rank_x, rank_y))
        first = rank_x > rank_y
        used_x, used_y = np.where(first, rank_x, used_x), np.where(first, used_y, rank_y)
        x, y = np.where(first, v.right[x], x), np.where(first, y, v.left[y])
    return fired


def token_bytes(spec: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file, added tokens too."""
    parsed = json.loads(spec)
    of_char = _byte_of_char()
    named = {i: bytes(map(of_char.__getitem__, t)) for t, i in parsed["model"]["vocab"].items()}
    named |= {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
    return [named.get(i, b"") for i in range(max(named) + 1)]


def vocabulary(spec: str, plain: bool = False) -> Vocabulary:
    """Reads a tokenizer file's content. ``ValueError`` if it is no byte-level BPE as described above."""
    parsed = json.loads(spec)
    model, splitter = parsed["model"], parsed.get("pre_tokenizer") or {}
    added = parsed.get("added_tokens", [])
    if (
        model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("byte_fallback")
        or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or parsed.get("normalizer")
        or (splitter.get("type"), splitter.get("add_prefix_space"), splitter.get("use_regex")) != ("ByteLevel", False, True)
        or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    ):
        raise ValueError("only byte-level BPE without normalizer, unknown token or white space options is supported")
    bytes_of = _byte_of_char()
    ids = {bytes(map(bytes_of.__getitem__, t)): i for t, i in model["vocab"].items()}
    tokens = token_bytes(spec)
    size = len(tokens)
    if any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")

    left, right, rank = (np.full(size, -1, dtype=np.int64) for _ in range(3))
    merges, ambiguous = {}, set()
    for number, merge in enumerate(model["merges"]):
        a, b = (ids[bytes(map(bytes_of.__getitem__, t))] for t in (merge.split(" ") if isinstance(merge, str) else merge))
        made = ids[tokens[a] + tokens[b]]
        merges[a * size + b] = (number, made)  # as in the library, a merge named twice has the later rank
        if rank[made] >= 0:
            ambiguous.add(made)
        left[made], right[made], rank[made] = a, b, number
    keys = np.array(sorted(merges), dtype=np.int64)
    ranks = np.array([merges[k][0] for k in keys.tolist()], dtype=np.int64)
    results = np.array([merges[k][1] for k in keys.tolist()], dtype=np.int64)
    byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
    v = Vocabulary(tokens, {}, byte_ids, left, right, rank, keys, ranks, results, np.zeros(0, np.int64), np.zeros(1, np.int64))

    # A token may be proposed if merging its own bytes gives it: so do its parts, formed before, and nothing fires between.
    made = np.flatnonzero(rank >= 0)
    sound = np.zeros(size, dtype=bool)
    sound[byte_ids] = True
    good = (rank[left[made]] < rank[made]) & (rank[right[made]] < rank[made]) & ~np.isin(made, sorted(ambiguous))
    good[good] = ~_fires(v, left[made][good], right[made][good], rank[made][good])
    for i in made[np.argsort(rank[made])][good[np.argsort(rank[made])]].tolist():
        sound[i] = sound[left[i]] and sound[right[i]]
    heads = sorted({t[:k] for t, i in ids.items() if sound[i] for k in range(len(t) + 1)}, key=lambda t: (len(t), t))
    node = {t: n for n, t in enumerate(heads)}
    edges = np.array([node[t[:-1]] * 256 + t[-1] for t in heads[1:]], dtype=np.int64)
    accepts = np.array([ids[t] if t in ids and sound[ids[t]] else -1 for t in heads], dtype=np.int64)
    special = {} if plain else {t["content"]: t["id"] for t in added}
    return v._replace(special=special, trie_keys=edges, accepts=accepts)


class Encoder:
    """Encodes texts with a vocabulary; keeps the ids of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.words: dict[str, bytes] = {}
        self.merges = dict(zip(v.merge_keys.tolist(), zip(v.merge_ranks.tolist(), v.merge_ids.tolist(), strict=True), strict=True))
        self.children = {k: n + 1 for n, k in enumerate(v.trie_keys.tolist())}
        special = sorted(v.special, key=len, reverse=True)
        self.special = re.compile("(%s)" % "|".join(map(re.escape, special))).split if special else None
        self.library = None

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return _ascii_words(text)
        if _unsettled(text) is None:
            return _unicode_words(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[list[str] | int]:
        """A text as lists of words and ids of special tokens. Long texts are cut before white space that follows other
        characters, where a word ends in any case."""
        for part in self.special(text) if self.special else [text]:
            if part in self.v.special:
                yield self.v.special[part]
                continue
            start = 0
            while len(part) - start > SEGMENT:
                cut = _word_start.search(part, start + SEGMENT)
                if cut is None:
                    break
                yield self.split(part[start : cut.end()])
                start = cut.end()
            if start < len(part):
                yield self.split(part[start:] if start else part)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens from the left of all words: token ids, and the word each belongs to, in order."""
        v = self.v
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        lane = np.arange(len(words))
        start = ends - [len(w) for w in words]
        at, node, best, best_end = start.copy(), np.zeros_like(start), np.full_like(start, -1), start.copy()
        out_tokens, out_words = [], []
        while len(lane):
            place, known = _find(v.trie_keys, node * 256 + data[at])
            known &= at < ends[lane]
            at = at + known
            node = np.where(known, place + 1, 0)
            token = v.accepts[node]
            longer = known & (token >= 0)
            best, best_end = np.where(longer, token, best), np.where(longer, at, best_end)
            if not known.all():
                stop = ~known
                out_tokens.append(best[stop])
                out_words.append(lane[stop])
                at = np.where(stop, best_end, at)
                go = ~(stop & (best_end == ends[lane]))
                lane, at, node, best, best_end = (c[go] for c in (lane, at, node, best, best_end))
        tokens, owners = np.concatenate(out_tokens), np.concatenate(out_words)
        order = np.argsort(owners, kind="stable")
        return tokens[order], owners[order]

    def _propose_alone(self, word: bytes) -> list[int]:
        children, accepts, out, start = self.children, self.v.accepts, [], 0
        while start < len(word):
            node, at = 0, start
            while at < len(word) and (node := children.get(node * 256 + word[at])) is not None:
                at += 1
                if accepts[node] >= 0:
                    best, end = int(accepts[node]), at
            out.append(best)
            start = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by its merges, lowest rank first, of equal ones the leftmost."""
        size = len(self.v.rank)
        ids = self.v.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merges.get(made * size + ids[after[j]]):
                    heapq.heappush(queue, (m[0], i, m[1], made, ids[after[j]]))
            if (k := before[i]) >= 0 and (m := self.merges.get(ids[k] * size + made)):
                heapq.heappush(queue, (m[0], k, m[1], ids[k], made))
        return [i for i in ids if i >= 0]

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """As ``merge`` for many words, which all take their next merge at the same time."""
        v, size = self.v, np.int64(len(self.v.rank))

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, known = _find(v.merge_keys, a * size + b)
            return np.where(known, v.merge_ranks[at], NEVER), at

        out: list[bytes] = [b""] * len(words)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks, made = look(ids, np.append(ids[1:], 0))
        ranks[np.flatnonzero(np.diff(word, append=-1))] = NEVER  # the last piece of a word has none to merge with
        while len(ids):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(heads, append=len(ids))
            least = np.minimum.reduceat(ranks, heads)
            finished = least == NEVER
            if finished.any():
                joined = ids.astype("<u4").tobytes()
                for w, a, n in zip(word[heads[finished]].tolist(), heads[finished].tolist(), lengths[finished].tolist(), strict=True):
                    out[w] = joined[4 * a : 4 * (a + n)]
                stay = np.repeat(~finished, lengths)
                ids, word, ranks, made = ids[stay], word[stay], ranks[stay], made[stay]
                lengths, least = lengths[~finished], least[~finished]
            here = np.flatnonzero(ranks == np.repeat(least, lengths))
            here = here[np.diff(word[here], prepend=-1) != 0]  # the leftmost of each word
            ids[here] = v.merge_ids[made[here]]
            stay = np.ones(len(ids), dtype=bool)
            stay[here + 1] = False
            here -= np.arange(len(here))  # one place fewer per word before
            ids, word, ranks, made = ids[stay], word[stay], ranks[stay], made[stay]
            ends_here = np.diff(word, append=-1) != 0
            inner = here[~ends_here[here]]
            ranks[here[ends_here[here]]] = NEVER
            ranks[inner], made[inner] = look(ids[inner], ids[inner + 1])
            behind = here[(here > 0) & (word[here - 1] == word[here])] - 1
            ranks[behind], made[behind] = look(ids[behind], ids[behind + 1])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        spelled = [w.encode() for w in words]
        short = [i for i, w in enumerate(spelled) if len(w) <= LONG_WORD]
        tokens, owners = self.propose([spelled[i] for i in short]) if short else (np.zeros(0, np.int64),) * 2
        owners = np.array(short, dtype=np.int64)[owners]
        for i in (i for i, w in enumerate(spelled) if len(w) > LONG_WORD):
            alone = self._propose_alone(spelled[i])
            tokens, owners = np.append(tokens, alone), np.append(owners, np.full(len(alone), i))
        beside = np.flatnonzero(owners[1:] == owners[:-1])
        pairs, which = np.unique(tokens[beside] * len(self.v.rank) + tokens[beside + 1], return_inverse=True)
        fired = _fires(self.v, pairs // len(self.v.rank), pairs % len(self.v.rank), np.full(len(pairs), NEVER))
        failing = set(owners[beside[fired[which]]].tolist())
        bounds = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
        joined = tokens.astype("<u4").tobytes()
        out: list[bytes] = [b""] * len(words)
        for i, a, b in zip(owners[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = joined[4 * a : 4 * b]
        together = [i for i in failing if len(spelled[i]) <= LONG_WORD]
        for i, ids in zip(together, self.merge_together([spelled[i] for i in together]), strict=True):
            out[i] = ids
        for i in failing.difference(together):
            out[i] = np.array(self.merge(spelled[i]), dtype="<u4").tobytes()
        return out

    def learn(self, lists: Iterable[list[str]]) -> list[str]:
        """Makes sure that the ids of all these words are known; returns the new ones too long to be remembered."""
        wanted = set().union(*lists)
        new = [w for w in wanted if w not in self.words]
        if len(self.words) + len(new) > MEMORY:
            self.words = {w: self.words[w] for w in wanted if w in self.words}
        if new:
            self.words.update(zip(new, self.encode_words(new), strict=True))
        return [w for w in new if len(w) > LONG_WORD]

    def forget_long(self, lists: Iterable[list[str]]) -> None:
        for word in long:
            del self.words[word]

    def encode_all(self, all_texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Words are looked up when a group of segments is full, so the last text of a group
        may be part words, part ids."""
        group: list[list] = []
        held = 0
        for text in all_texts:
            group.append([])
            for segment in self.segments(text):
                group[-1].append(segment)
                held += 1 if isinstance(segment, int) else sum(map(len, segment))
                if held > GROUP:
                    *done, unfinished = self._looked_up(group)
                    yield from (np.frombuffer(ids, dtype="<u4") for ids in done)
                    group, held = [[unfinished]], 0
        yield from (np.frombuffer(ids, dtype="<u4") for ids in self._looked_up(group))

    def _looked_up(self, group: list[list]) -> list[bytes]:
        lists = [s for segments in group for s in segments if isinstance(s, list)]
        long = self.learn(lists)
        known = self.words.__getitem__
        ids = lambda s: s if isinstance(s, bytes) else s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(known, s))
        out = [b"".join(map(ids, segments)) for segments in group]
        for word in long:
            del self.words[word]
        return out


_ENCODERS: dict[str, Encoder] = {}


class SharedVocabulary:
    """A vocabulary on its way to the tasks. A worker process keeps its encoder, so later tasks find their words known."""

    def __init__(self, spark: SparkSession, tokenizer: str, plain: bool = False):
        spec = read_spec(tokenizer)
        self.key = hashlib.sha256(f"{plain}{spec}".encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast(vocabulary(spec, plain))

    def encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS[self.key] = Encoder(self.sent.value)
        return _ENCODERS[self.key]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, plain: bool = False) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``keep``) and ``ids``, those of the whole text. Nothing is shuffled.

    ``tokenizer`` is a file of the tokenizers library; ``plain`` takes the strings of added tokens as ordinary text.
    """
    shared = SharedVocabulary(docs.sparkSession, tokenizer, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in pieces(batches):
            found = list(encoder.encode_all(texts(batch, "__text")))
            ids = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate(found).view("<i4"), pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids], names=["row", "ids"])

    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    source = docs.select(row, docs[text_col].cast("string").alias("__text"))
    schema = source.select("row", F.array().cast("array<int>").alias("ids")).schema
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of all ids one after the other, special tokens too, as text; what is
    no UTF-8 becomes U+FFFD. NULL ids give the empty text; an id outside the vocabulary, or a NULL one, gives nothing."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(token_bytes(read_spec(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array([*sent.value, b""], dtype=object)
        for batch in pieces(batches):
            ids = batch.column(ids_col)
            ids = ids if pa.types.is_list(ids.type) else ids.cast(pa.list_(pa.int64()))
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.where((flat >= 0) & (flat < len(tokens) - 1), flat, len(tokens) - 1)
            ends = np.cumsum(lengths)
            out = [b"".join(tokens[flat[end - n : end]]).decode("utf-8", "replace") for n, end in zip(lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit("")).schema)


def code_digests(coded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, per row of ``decode(encode(...))``."""
    named = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select(
        F.col("row")[doc_id].alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(named, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
