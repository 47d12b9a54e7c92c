"""Token ids from a file of the tokenizers library, as fast as its vocabulary's structure permits."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np

# Fixed values of the format: a pre-tokenizer that drops white space and never joins characters across it.
_SPACELESS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Small letters of Latin-1, and the characters for which the patterns below do what the tokenizer does: white space that both
# know, printable ASCII and Latin-1 letters, which composition leaves alone and which have one small letter each.
_SMALL = "a-zß-öø-ÿ"
_ODD = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿ]")
# The pattern above on lower-cased text of those characters; what is most frequent is tried first.
_WORD = re.compile(f"[{_SMALL}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_SMALL}0-9]+")
# Characters of texts that are encoded together, unless one text has more.
TOGETHER = 1 << 20


class _Numbers(dict):
    """A number per key, given when it is first asked for; ``new`` collects those. ``old`` holds the generation before, from
    which keys that are asked for again return."""

    def __init__(self, old: dict[str, int]):
        super().__init__()
        self.old, self.new, self.next = old, [], len(old)

    def __missing__(self, key: str) -> int:
        number = self.old.get(key)
        if number is None:
            number = self.next
            self.next += 1
            self.new.append(key)
        self[key] = number
        return number


class _Memory:
    """Ids by key, all in one array. At half of ``limit`` keys they become the old generation, and those of the one before
    that nobody asked for are dropped; so rare words never pile up and frequent ones stay."""

    def __init__(self, limit: int):
        self.limit = limit // 2
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars = _Numbers({}), 0
        self.flat, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, keys: Iterable[str], n: int, make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``n`` keys one behind the other, and how many there are up to each; ``make`` gives ids and lengths of
        keys that are new."""
        numbers = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, n)
        if new := self.numbers.new:
            self.numbers.new = []
            ids, lengths = make(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
            self.chars += sum(map(len, new))
        found = self._gather(numbers)
        if self.chars > 64 * self.limit:  # keys of unusual length, which need not stay
            self._forget()
        elif len(self.numbers) >= self.limit:
            kept = list(self.numbers)
            own = np.fromiter(self.numbers.values(), np.int64, len(kept))
            lengths = self.lengths[own]
            self.flat, ends = self._gather(own)
            self.starts, self.lengths, self.chars = ends - lengths, lengths, sum(map(len, kept))
            self.numbers = _Numbers(dict(zip(kept, range(len(kept)), strict=True)))
        return found

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        place = np.repeat(self.starts[numbers] - ends + lengths, lengths)
        place += np.arange(len(place))
        return self.flat[place], ends


class WholeTexts:
    """Encodes text by text; right for every tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        return map(self.encode, texts)


class SpacelessWords(WholeTexts):
    """Encodes texts word by word, each distinct word once.

    White space yields no token and no merge crosses the pre-tokenizer's words, so the ids of a text are those of its words
    in order. Stretches of common characters are split here; pieces between blanks with any other character, or with a special
    token, go through the whole tokenizer. Words are numbered; those that are new in a group of texts go to the merges in one
    call. Ids are gathered by numpy from one array.
    """

    def __init__(self, tokenizer, limit: int, special: Iterable[str], suffix: str | None):
        super().__init__(tokenizer)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.bare = Tokenizer(tokenizer.model)  # merges alone, of words between blanks
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        # The ids that end a word, if the vocabulary marks them; what a word consists of cannot look like the mark.
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.special = sorted(special)
        self.other = re.compile("|".join([_ODD.pattern, *map(re.escape, self.special)]))
        self.words = _Memory(limit)

    def _split(self, text: str) -> list[str]:
        """The words of a text, lower-cased; pieces that only the whole tokenizer knows, as they are after a blank."""
        if not _ODD.search(text) and not any(s in text for s in self.special):
            return _WORD.findall(text.lower())
        text, out, done = text.replace("\n", " "), [], 0
        for found in self.other.finditer(text):
            if found.start() < done:
                continue  # in a piece that has gone already
            start = max(text.rfind(" ", done, found.start()) + 1, done)
            end = text.find(" ", found.end())
            end = len(text) if end < 0 else end
            out += _WORD.findall(text[done:start].lower())
            out.append(" " + text[start:end])
            done = end
        out += _WORD.findall(text[done:].lower())
        return out

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(words)
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            return ids, np.diff(ends, prepend=0)
        made = self.bare.encode(joined, add_special_tokens=False)  # some word does not end with an id of its own
        return np.array(made.ids, dtype="<u4"), np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(words))

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array([k[0] == " " for k in keys], dtype=bool)
        if not odd.any():
            return self._merge(keys)
        ids, known = self._merge([k for k in keys if k[0] != " "])
        made = [self.tokenizer.encode(k[1:], add_special_tokens=False).ids for k in keys if k[0] == " "]
        lengths = np.zeros(len(keys), dtype=np.int64)
        lengths[~odd], lengths[odd] = known, [len(m) for m in made]
        whole = np.repeat(odd, lengths)
        both = np.empty(len(whole), dtype="<u4")
        both[whole], both[~whole] = list(chain.from_iterable(made)), ids
        return both, lengths

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._split(t) for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        ids, ends = self.words.of(chain.from_iterable(split), int(counts.sum()), self._learn)
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)][:-1])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= TOGETHER:
                yield from self._together(group)
                group, chars = [], 0
        if group:
            yield from self._together(group)

    def encode(self, text: str) -> np.ndarray:
        return self._together([text])[0]


def read_spec(path: str) -> str:
    """The tokenizer file's content, which travels to the tasks (a few MB, fixed by the vocabulary)."""
    return Path(path).read_text(encoding="utf-8")


def vocabulary_size(spec: str) -> int:
    """One more than the largest id that the tokenizer can yield."""
    parsed = json.loads(spec)
    ids = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens", []))]
    return max(ids) + 1


@lru_cache(maxsize=2)
def _made(digest: str, limit: int, holder: tuple) -> WholeTexts:
    from tokenizers import Tokenizer

    spec = holder[0]
    parsed = json.loads(spec)
    tokenizer = Tokenizer.from_str(spec)
    first = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    normal = [n["type"] for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
    spaceless = (
        first.get("pattern", {}).get("Regex") == _SPACELESS
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and normal == ["NFC", "Replace", "Lowercase"]
        and parsed["model"]["type"] == "BPE"
        and not parsed["model"]["dropout"]
        and not any(t["normalized"] or t["single_word"] for t in parsed["added_tokens"])
    )
    if not spaceless:
        return WholeTexts(tokenizer)
    return SpacelessWords(tokenizer, limit, [t["content"] for t in parsed["added_tokens"]], parsed["model"]["end_of_word_suffix"])


def encoder(spec: str, limit: int = 500_000) -> WholeTexts:
    """The encoder for a tokenizer file's content. A worker process keeps it, so later tasks find its words known."""
    return _made(hashlib.md5(spec.encode()).hexdigest(), limit, _Spec((spec,)))


class _Spec(tuple):
    """Holds a content beside its digest: equal to every other, so that the cache looks at the digest only."""

    def __eq__(self, other):
        return isinstance(other, _Spec)

    def __hash__(self):
        return 0
