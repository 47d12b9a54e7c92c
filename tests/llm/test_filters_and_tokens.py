"""The filter audit, token alignment and BPE coding against plain Python and the public libraries."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from scrubwell.llm import byte_bpe, filter_audit, token_alignment
from scrubwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

LONG = "word " * 40_000 + "x" * 30_000 + " end"
ODD = [
    (1, "plain words, and more of them"), (1, "plain words, and more of them"), (None, "plain words, and more of them"), (2, None), (3, ""),
    (4, " "), (5, "a▁b and a plain word"), (6, "<|endoftext|> 'tis <s> </s> <unk> <0x41>"), (7, "tabs\tand\r\nlines\n\n  ends  "), (8, "Zażółć 漢字 😀 é \x00 ﻿"),
    (9, LONG), (None, None), (10, "ՠ" + chr(0x558) + chr(0xC5C) + " 1"), (11, "$#" * 300), (12, "A B C d"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- filters -----------------------------------------------------------------------------------------------------


def audit_in_python(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    first, table = {}, []
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        failed |= {"D"} if re.search("[#$%&*|]", text) else set()
        failed |= {"E"} if doc_id is not None and text in first and first[text] < doc_id else set()
        mark = [any(x == doc_id and row[k] == 1 for x, *row in labels) if doc_id is not None else False for k in (0, 1)]
        table.append((part or "", failed, *mark))
    out = {}
    for part in {t[0] for t in table}:
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            rest = [t for t in table if t[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [t for t in rest if f in t[1]]
                redundant = sum(f in t[1] for t in gone)
                rest = [t for t in rest if f not in t[1]]
                gone += now
                removed_by[f] += len(now)
                alone = sum(t[1] == {f} for t in rest + gone)
                out[part, order, step] = [len(rest), len(now), redundant, alone, sum(t[2] for t in now), sum(t[3] for t in now)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    schema = "doc_id long, text string, lang string, part string, mask int, good int, digest string, n string"
    docs = spark.createDataFrame([(*d, "x", 1, 1, "y", "z") for d in docs], schema)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.document_masks(docs, labels)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}


def test_op11_counts_what_filters_do_in_every_order(spark):
    texts = ["", None, "A B C d", "a $ b", "w " * 120, " ".join(map(str, range(130))), " ".join(f"{i}#" for i in range(130)), "ABC " * 100]
    docs = [(i, texts[i % len(texts)], ("en", "de", None, "")[i % 3]) for i in range(40)]
    docs += [(None, "A B C d", "en"), (None, "A B C d", "en"), (2, "A B C d", "de"), (2, "A B C d", "de"), (-5, None, None), (None, "only nameless", "fr")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 40, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (7, None, None)]
    found = audited(spark, docs, labels)
    assert found == audit_in_python(docs, labels)
    assert len(found) == 600 * 4


def test_op11_without_rows_or_labels(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, LONG, "en")], []) == audit_in_python([(1, LONG, "en")], [])


def test_op11_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(cells, "XY").collect()}
    assert found == {("XY", 1): (9, 2, 0, 0, 2), ("XY", 2): (5, 4, 2, 4, 10), ("YX", 1): (5, 6, 0, 4, 10), ("YX", 2): (5, 0, 2, 0, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "ABCDEFGH")


# ---- coding ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def encoder():
    with open(BYTES) as file:
        return byte_bpe.Encoder(byte_bpe.vocabulary(file.read()))


def test_op13_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        wanted = len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted


def test_op13_odd_texts_and_clashing_columns(spark, documents, library):
    docs = documents(*ODD).withColumnRenamed("score", "ids").withColumnRenamed("size", "__text")
    found = byte_bpe.decode(byte_bpe.encode(docs, BYTES), BYTES).collect()
    assert len(found) == len(ODD)
    for r in found:
        text = r.row.text or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.decoded == text
    assert byte_bpe.encode(documents(*ODD).limit(0), BYTES).count() == 0


def test_op13_decodes_broken_ids(spark, library):
    ids = [[0, 1, 2], [188], [50256, 262], [-4, 60_000], [], None, [None, 262]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, ids array<long>")
    found = [r.decoded for r in byte_bpe.decode(frame, BYTES).orderBy("i").collect()]
    assert found[:3] == [library.decode(x, skip_special_tokens=False) for x in ids[:3]]
    assert found[3:] == ["", "", "", " the"]


PARTS = st.sampled_from(["a", "b", "-", "=", "Ã", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "漢", "😀", "<|endoftext|>", "the", "ing", " \n", "AA", " ", "ՠ", "ᵪ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=40).map("".join) | st.text(max_size=30), max_size=8))
def test_op13_any_text(library, encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op13_long_words_and_small_memory(library, encoder, monkeypatch):
    texts = ["a" * 20_000, "-" * 5_000 + " x", " " * 70_000, "ab" * 9_000 + " " + "q" * 70_000, "x y " * 40_000, LONG]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode_all(texts)] == wanted
    for name, value in (("MEMORY", 3), ("GROUP", 100), ("SEGMENT", 50)):
        monkeypatch.setattr(byte_bpe, name, value)
    assert [x.tolist() for x in encoder.encode_all(texts)] == wanted


def test_op13_speculation_fails_for_some_words_only(encoder, monkeypatch):
    merged = []
    together = encoder.merge_together
    monkeypatch.setattr(encoder, "merge_together", lambda words: merged.extend(words) or together(words))
    encoder.encode_words(["hello", " the", "zxqvw", "ingthe", " invented", "lloweenings"])
    assert 0 < len(merged) < 6


def test_op13_settled_characters_mean_the_same_to_the_library():
    library = ByteLevel(add_prefix_space=False, use_regex=True)
    for start in range(0, 0x20000, 64):
        text = "".join(f"a{chr(c)}b1{chr(c)}2!{chr(c)}? {chr(c)} x\n" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000 and byte_bpe._unsettled(chr(c)) is None)
        assert [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] == byte_bpe._unicode_words(text)


def test_op13_refuses_other_formats():
    with open(public_tokenizers.path("word_bpe_49k.json")) as file, pytest.raises(ValueError):
        byte_bpe.vocabulary(file.read())


# ---- alignment ---------------------------------------------------------------------------------------------------


def aligned_in_python(docs):
    a_model, b_model = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    with open(BYTES) as file:
        a_bytes = byte_bpe.token_bytes(file.read())
    names = [b_model.id_to_piece(i) for i in range(b_model.vocab_size())]
    b_bytes = [bytes([int(n[3:5], 16)]) if b_model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def one(text):
        spelled = f" {text}".encode()
        a, b = a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != spelled or b"".join(b_bytes[i] for i in b) != spelled:
            return [], [], [], [], ""
        a_end, b_end = (np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((a_bytes, a), (b_bytes, b)))
        owner = {}  # bytes to B tokens
        for j, (begin, end) in enumerate(zip([0, *b_end], b_end)):
            owner.update(dict.fromkeys(range(begin, end), j))
        links = []
        for i, (begin, end) in enumerate(zip([0, *a_end], a_end)):
            links += [(a[i], b[j]) for j in sorted({owner[k] for k in range(begin, end)})]
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        return a, b, groups, links, sha(";".join(groups))

    found = [one(t) for t in docs]
    held = Counter(p for f in found for p in set(f[3]))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    return [
        (len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest)
        for a, b, groups, links, digest in found
    ]


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_op12_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = dict(zip((d for d, _ in docs), aligned_in_python([t for _, t in docs])))
    found = {r.doc_id: (*(r[c] for c in FIGURES), r.groups_sha256) for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert found == wanted


@pytest.mark.parametrize("hot_pairs", [0, 20, 1 << 20])
def test_op12_odd_texts_with_few_and_many_hot_pairs(spark, documents, hot_pairs):
    docs = documents(*ODD).withColumnRenamed("score", "groups").withColumnRenamed("size", "pairs")
    found = token_alignment.alignment(docs, BYTES, PIECES, hot_pairs=hot_pairs).collect()
    key = lambda doc_id, text, rest: (str(doc_id), text or "", *rest)
    got = sorted(key(r.row.doc_id, r.row.text, [*(r[c] for c in FIGURES), sha(r.groups) if r.groups else ""]) for r in found)
    wanted = sorted(key(*d, w) for d, w in zip(ODD, aligned_in_python([t for _, t in ODD])))
    assert got == wanted
    assert token_alignment.alignment(docs.limit(0), BYTES, PIECES, hot_pairs=hot_pairs).count() == 0


def test_op12_small_segments_and_counts_passed_on_early(spark, documents, monkeypatch):
    text = "some words that two tokenizers  split in\ntheir own ways, 2024 naïve 漢字 " * 30
    with open(BYTES) as file, open(PIECES, "rb") as model:
        aligner = token_alignment.Aligner(byte_bpe.Encoder(byte_bpe.vocabulary(file.read(), plain=True)), token_alignment.PieceEncoder(model.read()))
    whole = aligner.run([text, "other ▁ text", text[:40]])
    for name, value in (("SEGMENT", 20), ("GROUP", 60), ("MEMORY", 2)):
        monkeypatch.setattr(token_alignment, name, value)
    cut = aligner.run([text, "other ▁ text", text[:40]])
    for a, b in zip(whole, cut):
        assert a.faithful == b.faithful
        if a.faithful:
            assert a.n.tolist() == b.n.tolist() and b"".join(a.text) == b"".join(b.text)
            assert [x.tolist() for x in token_alignment._joined(a.pairs)] == [x.tolist() for x in token_alignment._joined(b.pairs)]
    aligned = token_alignment.align(documents(*ODD), BYTES, PIECES)
    counts = {r.pair: r.n for r in token_alignment.pair_counts(aligned).collect()}
    assert counts == {r.pair: r.n for r in token_alignment.pair_counts(aligned, held=5).collect()}


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.data())
@settings(max_examples=100, deadline=None)
def test_op12_coalesces_tilings(widths, data):
    total = sum(widths)
    cuts = sorted({*data.draw(st.lists(st.integers(1, total), max_size=20)), total})
    a_end, b_end = np.cumsum(widths), np.array(cuts)
    a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
    side = np.repeat([0, 1], [len(a_end), len(b_end)])
    _, head = token_alignment.coalesce(np.append(a_start, b_start), np.append(a_end, b_end), side)
    assert head.sum() == len(set(a_end.tolist()) & set(cuts))
    at_a, at_b = token_alignment.overlaps(a_start, a_end, b_start, b_end)
    wanted = [(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]]
    assert list(zip(at_a.tolist(), at_b.tolist())) == wanted


def test_op12_texts_ending_in_one_blank(spark, documents):
    rows = [(1, "a b "), (2, "end. "), (3, "a b  "), (4, "漢字 "), (5, "word " * 20_000), (6, "\t ")]
    docs = documents(*rows).withColumnRenamed("score", "groups").withColumnRenamed("size", "pairs")
    found = {r.row.doc_id: (*(r[c] for c in FIGURES), sha(r.groups) if r.groups else "") for r in token_alignment.alignment(docs, BYTES, PIECES).collect()}
    assert found == dict(zip((d for d, _ in rows), aligned_in_python([t for _, t in rows])))
    assert all(found[d][0] > 0 for d, _ in rows)
