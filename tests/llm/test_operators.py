"""The text operators on NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scrubwell.functions.storage import fresh_path
from scrubwell.llm import (
    chat, decontamination, embedding_dedup, graphs, line_dedup, minhash, mixing, secret_scan, token_counts, token_files, tokenizer, toxicity,
)

SPEC = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "words of nobody here at all"), (None, None), (4, "word " * 60_000)]


def empty(documents):
    return documents((0, "x")).limit(0)


# ---- mixing


def test_mix_takes_whole_documents_near_the_targets(spark, documents):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 40), None if i % 11 == 0 else "abc"[min(2, i % 7)]) for i in range(800)] + [(i, None, "z") for i in range(3)]
    plan = mixing.mixing_plan(documents(*rows)).collect()
    assert len(plan) == len(rows)
    by_source = {}
    for r in plan:
        by_source.setdefault(r.row.source, []).append(r)
    words = {s: sum(r.size for r in own) for s, own in by_source.items()}
    for s, own in by_source.items():
        assert {(r.source_size, r.target) for r in own} == {(words[s], own[0].target)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert all(r.taken == r.size * r.copies and r.taken <= 3 * r.size and len(r.positions) == r.copies for r in own)
        assert all(0 <= p <= 1 for r in own for p in r.positions)
    assert abs(sum(own[0].target for own in by_source.values()) - sum(words.values())) < 1e-6
    mixed = mixing.mix(documents(*rows), partitions=5)
    assert mixed.columns == documents(*rows).columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(empty(documents)).count() == 0


def test_targets_fill_up_by_weight(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 100), ("=d", "d", 0)], "key string, source string, source_size long")
    found = {r.key: r.target for r in mixing._targets(sizes, mixing.CURRICULUM, 3, None).collect()}
    # weights 5 2 1 5: a and d are full at 30 and 0, the rest is shared 2 to 1 between b and c, where c is full at 300
    assert found == {"=a": 30.0, "=b": 780.0, "=c": 300.0, "=d": 0.0}


def test_positions_invert_the_schedule(spark):
    for s in mixing.CURRICULUM:
        rows = spark.range(101).selectExpr("id / 100D AS share")
        for r in rows.select("share", mixing._progress(rows.share, s.segments(), mixing.F.lit(s.weight)).alias("t")).collect():
            area, weight_at = 0.0, lambda x: np.interp(x, *zip(*s.knots, strict=True))  # noqa: B023, E731
            grid = np.linspace(0, r.t, 2001)
            area = np.trapezoid([weight_at(x) for x in grid], grid)
            assert area == pytest.approx(r.share * s.weight, abs=1e-5)


def test_repeated_rows_and_null_ids_are_mixed(spark, documents):
    plan = mixing.mixing_plan(documents(*ODD, *[(9, "same text", "b")] * 40)).collect()
    assert len(plan) == len(ODD) + 40
    assert all(r.taken <= 3 * r.size for r in plan)


# ---- secrets


def der(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x80 | len(b := size.to_bytes((size.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + head + content


KEY = der(0x30, b"".join(der(2, n) for n in (b"\0", b"\1" * 65, b"\1\0\1", b"\2" * 64, b"\3" * 33, b"\4" * 33, b"\5" * 32)))
WIRE = b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", b"\7" * 32))
JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2ln"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("see " + base64.b64encode(KEY).decode() + " end", ["der"]),
        ("é " + KEY.hex(), ["hex", "der"]),
        ("é " + KEY.hex().upper(), ["der", "hex"]),  # a run of digits inside is hex by itself
        ("x " + base64.b64encode(WIRE).decode(), ["wire"]),
        ("-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END RSA PRIVATE KEY-----", ["pem"]),
        (f"bearer {JWT}.", ["jwt"]),
        ("see " + base64.b64encode(KEY[:-1] + b"\0\0").decode(), []),  # lengths do not add up
        ("see " + base64.b64encode(bytes(range(60))).decode(), []),
        ("aaaaaaaaaaaa.bbbbbbbbbbbbbb.cccc", []),
        ("Password = abcdef, ſecret: abcdef, token: abc", ["assign"]),
        ("", []),
    ],
)
def test_structures_are_confirmed(text, kinds):
    found = secret_scan.find_secrets(text)
    assert [k for _, k, _ in found] == kinds
    assert all(0 <= s < e <= len(text) for s, _, e in found)


PBES2 = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(0x30, der(6, b"\x2a\x03")) + der(0x30, der(6, b"\x2b\x04"))))
ENCRYPTED = der(0x30, PBES2 + der(4, b"\x5a" * 96))
SHA256 = der(0x30, der(0x30, der(6, b"\x60\x86\x48\x01\x65\x03\x04\x02\x01") + der(5, b"")) + der(4, b"\x11" * 32))
KEY64, WIRE64 = base64.b64encode(KEY).decode(), base64.b64encode(WIRE).decode()
MIXED = KEY.hex()[:40].upper() + KEY.hex()[40:-2] + "aF"


def pem(label, data, end):
    return end.join([f"-----BEGIN {label}-----", *base64.encodebytes(data).decode().split(), f"-----END {label}-----"]) + end


@pytest.mark.parametrize(
    ("text", "wanted", "span"),
    [
        (f"PRIVATE_KEY={KEY64}\n", "der", KEY64),
        (f"https://example.org/?a=1&key={WIRE64}&b=2", "wire", WIRE64),
        (f'{{"key": "one\\n{KEY64}\\n"}}', "der", KEY64),
        (f"one\\r\\n{WIRE64}", "wire", WIRE64),
        (f"token\\t{JWT}", "jwt", JWT),
        (f"one\\n{MIXED}", "der", MIXED),
        (f"see {MIXED} end", "der", MIXED),
        (json.dumps({"private_key": pem("PRIVATE KEY", KEY, "\n")}), "pem", pem("PRIVATE KEY", KEY, "\\n")[:-2]),
        (json.dumps(pem("PRIVATE KEY", KEY, "\r\n")), "pem", pem("PRIVATE KEY", KEY, "\\r\\n")[:-4]),
        (json.dumps(json.dumps(pem("PRIVATE KEY", KEY, "\n"))), "pem", pem("PRIVATE KEY", KEY, "\\\\n")[:-3]),
        (pem("PRIVATE KEY", KEY, "\\\n"), "pem", pem("PRIVATE KEY", KEY, "\\\n")[:-2]),
        (pem("ENCRYPTED PRIVATE KEY", ENCRYPTED, "\n"), "pem", pem("ENCRYPTED PRIVATE KEY", ENCRYPTED, "\n")[:-1]),
        (f"see {base64.b64encode(ENCRYPTED).decode()}", "der", base64.b64encode(ENCRYPTED).decode()),
    ],
)
def test_structures_after_any_delimiter(text, wanted, span):
    at = text.index(span)
    assert (at, wanted, at + len(span)) in secret_scan.find_secrets(text)


def test_a_digest_is_no_key():
    assert secret_scan.find_secrets("see " + base64.b64encode(SHA256).decode()) == []


def test_secrets_of_odd_rows(spark, documents):
    rows = secret_scan.span_digests(secret_scan.scan_secrets(documents(*ODD, (5, "token=" + "a" * 400_000), (6, "password: hunter2 AKIA" + "A" * 16)))).collect()
    found = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in rows}
    assert len(rows) == len(ODD) + 2 and found[5] == (1, 0, 1) and found[6] == (1, 1, 0) and found[None] == (0, 0, 0)
    assert secret_scan.span_digests(secret_scan.scan_secrets(empty(documents))).count() == 0


# ---- chat


def test_a_conversation_of_many_turns(spark):
    texts = [("é" * (k % 7) + "</turn>" * (k % 3 == 0) + f" {k}") for k in range(2_500)]
    role = lambda k: "assistant" if k % 5 in (1, 2) else "user"
    frame = spark.createDataFrame([(1, k, role(k), t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(frame)
    row, read = made.first(), chat.read_back(made).first()
    assert read.loss_texts == [t for k, t in enumerate(texts) if role(k) == "assistant"]
    assert [chat_text(row.formatted[s.start : s.end]) for s in row.loss_spans] == read.loss_texts
    assert [(t.role, t.text) for t in read.turns] == [(role(k), t) for k, t in enumerate(texts)]
    mute = chat.read_back(chat.format_chats(frame, trained="nobody")).first()
    assert mute.loss_texts == [] and len(mute.turns) == len(texts)


def chat_text(escaped):
    return escaped.replace("\\e", "</turn>")


def test_chats_survive_any_text(spark):
    rng = random.Random(5)
    bits = ["\\", "</turn>", "<join>", "### ", "\n", "a", "\\b", "\\e", ": ", "é", "#", "<", "", "</turn", ">"]
    said = lambda: "".join(rng.choices(bits, k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys: \\tem"]), None if rng.random() < 0.1 else said()) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, None, None), (None, 2, "assistant", "x"), (-1, 1, "assistant", "b"), (-1, 1, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(4)
    read = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert len(read) == 62
    for c, r in read.items():
        own = sorted(((t if t is not None else -1, role or "", x or "") for k, t, role, x in rows if k == c))
        assert [(t.role, t.text) for t in r.turns] == [(role, x) for _, role, x in own]
        assert r.loss_texts == [x for _, role, x in own if role == "assistant"]
    assert chat.format_chats(frame.limit(0)).count() == 0


# ---- token files


@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=80), st.integers(0, 80), st.integers(0, 80))
@settings(max_examples=80, deadline=None)
def test_packing_round_trip(bits, ids, skip, n):
    ids = np.array(ids, dtype=np.int64) & ((1 << bits) - 1)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    skip = min(skip, len(ids))
    n = min(n, len(ids) - skip)
    assert token_files.unpack(packed, bits, n, skip).tolist() == ids[skip : skip + n].tolist()


def test_token_files_of_odd_rows(spark, documents):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(documents(*ODD), path, SPEC, block_ids=8, shards=3)
    rows = sorted(token_files.read_documents(spark, path, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4]
    every = [i for r in rows for i in r.ids]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert rows[4].ids == [1] and rows[6].n_tokens == 60_001
    assert token_files.read_range(spark, path, 3, 30).tolist() == every[3:33]
    assert {b.bits for b in token_files.read_blocks(spark, path).collect()} == {16}
    none = fresh_path(spark, "tokens")
    token_files.write_tokens(empty(documents), none, SPEC)
    assert token_files.read_documents(spark, none).count() == 0


TEXT = st.text(st.sampled_from("aZé'.<|>tsrevml,0 \n\t Ü!ñ#ſΣ́ 日\r\x85"), max_size=30)


@given(st.lists(TEXT, max_size=20))
@settings(max_examples=60, deadline=None)
def test_piecewise_encoding_equals_whole(texts):
    made = tokenizer.encoder(tokenizer.read_spec(SPEC))
    assert isinstance(made, tokenizer.SpacelessWords)
    for t in [*texts, "a<|endoftext|>b <|startoftext|>."]:
        assert made.encode(t).tolist() == made.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("ab 'st\n")), max_size=60), max_size=12))
@settings(max_examples=80, deadline=None)
def test_texts_encoded_together_equal_those_alone(texts):
    spec = tokenizer.read_spec(SPEC)
    whole = tokenizer.encoder(spec).tokenizer
    made = tokenizer.SpacelessWords(whole, 6, ["<|startoftext|>", "<|endoftext|>"], "</w>")  # forgets all the time
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [ids.tolist() for ids in made.encode_all(texts)] == want


def test_texts_of_pieces_without_blanks():
    made = tokenizer.encoder(tokenizer.read_spec(SPEC))
    for t in ["é日" * 3_000, "ab cd" * 3_000 + "日", "日 " * 3_000, "a</w>b </w> <|END|> <|endoftext|><|endoftext|>x y", "it's 'Tis DON'T '' 'S ÀÉ's ×÷"]:
        assert made.encode(t).tolist() == made.tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    made = tokenizer.encoder(tokenizer.read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    assert type(made) is tokenizer.WholeTexts and made.encode("a  b").tolist() == made.tokenizer.encode("a  b").ids


# ---- toxicity


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    hit = [0.9, 0.8, 0.7, 0.6, 0.9, 0.5, 0.3, 0.3]
    v = np.stack([np.where(rng.random(len(y)) < np.where(y, h, 0.05), 2, 1) for h in hit], axis=1)
    v[:, 4] = v[:, 0]  # a voter that repeats another
    codes, counts = np.unique(v @ (3 ** np.arange(7, -1, -1)), return_counts=True)
    model = toxicity.fit_label_model(codes, counts.astype(float), np.zeros(len(codes)), np.zeros(len(codes)))
    assert model.prior == pytest.approx(0.2, abs=0.02)
    assert 4 in (model.parent[0], *[i for i in range(8) if model.parent[i] == 0]) and model.correlation[0, 4] > 0.99
    assert np.mean((model.posterior(v @ (3 ** np.arange(7, -1, -1))) > 0.5) == y) > 0.96


def test_samples_of_any_share(spark):
    rows = spark.range(200_000)
    assert rows.filter(toxicity._sampled(F.col("id"), "x", 1.0)).count() == 200_000
    assert 150 < rows.filter(toxicity._sampled(F.col("id"), "x", 0.001)).count() < 250
    lowest = rows.select(F.shiftrightunsigned(F.xxhash64("id", F.lit("x")), 1).alias("h")).agg(F.min("h")).first()[0]
    assert rows.filter(toxicity._sampled(F.col("id"), "x", (lowest + 2048) / 2**63)).count() == 1  # a share below 1 / 2**17


def test_toxicity_of_odd_rows(spark, documents):
    rows = [(i, "calm words about the weather of day " + str(i)) for i in range(200)] + [(i, f"you idiot and loser of day {i} go away now") for i in range(200, 260)]
    docs = documents(*rows, *[(900 + (r[0] or 0), r[1]) for r in ODD], (None, "you idiot and loser"))
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs.filter("doc_id < 200").coalesce(1), labels).count() == 200  # no term in any text
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 200 + len(ODD)
    none = labels.limit(0)
    assert toxicity.drop_toxic(docs, none).filter("doc_id < 200").count() == 200
    assert toxicity.drop_toxic(empty(documents), labels).count() == 0


# ---- embeddings


def links_of(vectors, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n, root = [0] * len(vectors), list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if ok[i] and ok[j] and len(a) == len(b):
                a_, b_ = np.array(a, float), np.array(b, float)
                a_, b_ = a_ / np.abs(a_).max(), b_ / np.abs(b_).max()
                if a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return [(i, n[i], find(i)) for i in range(len(vectors))]


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + rng.normal(scale=s, size=16)).astype(np.float32).tolist() for s in rng.choice([0.05, 0.3, 0.6, 3], 260)]
    vectors += [vectors[0]] * 30 + [[0.0] * 16, None, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e30] * 16, [2e30] * 16, [1e-30, -0.0], [1e-30, 0.0]]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, node string").repartition(5)
    found = embedding_dedup.near_vectors(frame, tile=40)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == links_of(vectors)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_bounds_hold_for_quantised_products():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(rng.normal(size=(60, 48)) * rng.lognormal(sigma=2, size=(60, 48)))
    q, scale, lost = embedding_dedup.quantise(x)
    near = (q.astype(int) @ q.T.astype(int)) * scale[:, None] * scale
    e, f = lost[:, None], lost[None, :]
    assert (np.abs(near - x @ x.T) <= (1 + e) * f + e * (1 + f) + e * f + 1e-12).all()


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300), (401, 400), (402, 401)]
    found = dict(graphs.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 400: 400, 401: 400, 402: 400}


# ---- decontamination


def test_leaks_of_short_items_overlaps_and_blocks(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents((21, "x x " + " ".join(f"w{i}" for i in range(5, 25)) + " y"), (22, "W3, w4! w5"), (23, "short item here short item"), (24, " ".join(f"w{i}" for i in range(9))), *ODD)
    items = spark.createDataFrame([(10, text), (11, "short item"), (12, None), (13, ""), (None, "lone"), (10, text)], "item_id long, text string")
    for words in (1 << 19, 5):
        rows = decontamination.find_leaks(docs, items, block_words=words, shard_words=12).collect()
        found = {r.row.doc_id: r for r in rows}
        assert len(rows) == 4 + len(ODD)
        assert [tuple(s) for s in found[21].spans] == [(2, 22)] and ("10", 5, 2, 20) in {tuple(m) for m in found[21].matches}
        assert [tuple(s) for s in found[23].spans] == [(0, 2), (3, 5)] and {m.item_id for m in found[23].matches} == {"11"}
        assert found[22].spans == [] and found[24].spans == [] and found[24].n_words == 9
    kept = decontamination.remove_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == 2 + len(ODD)
    assert decontamination.remove_leaks(docs, items.limit(0)).count() == 4 + len(ODD)
    assert decontamination.remove_leaks(empty(documents), items).count() == 0


# ---- rollups


def test_rollups_add_up_and_batches_count_once(spark, documents):
    store = fresh_path(spark, "rollups")
    count = lambda *rows: token_counts.count_tokens(documents(*rows), "blanks-1")
    state = lambda: sorted((r.source, r.documents, r.tokens) for r in token_counts.totals(spark, store).collect())
    assert state() == []
    first = token_counts.changes(count((1, "a b c"), (2, "d e", "b"), (None, "n"), (5, None)), "insert")
    token_counts.commit(store, "one", first)
    assert state() == [("a", 3, 4), ("b", 1, 2)]
    second = token_counts.changes(count((1, "a b"), (2, "d e", "a")), "revise").union(token_counts.changes(count((None, "gone")), "delete"))
    token_counts.commit(store, "two", second)
    assert state() == [("a", 3, 4)]
    token_counts.commit(store, "one", first)
    token_counts.commit(store, "two", second)
    token_counts.commit(store, "none", first.limit(0))
    assert state() == [("a", 3, 4)]
    token_counts.commit(store, "three", token_counts.changes(count((1, "x"), (77, "never there")), "delete"))
    assert state() == [("a", 2, 2)]


def test_rows_that_share_an_id_are_all_counted(spark, documents):
    store = fresh_path(spark, "rollups")
    count = lambda *rows: token_counts.count_tokens(documents(*rows), "blanks-1")
    rows = (1, "a b"), (1, "c d e"), (None, "f"), (None, "g h"), (1, "a b"), (3, "x", None), (4, None, "c")
    token_counts.commit(store, "one", token_counts.changes(count(*rows), "insert"))
    found = {r.source: (r.documents, r.tokens) for r in token_counts.totals(spark, store).collect()}
    assert found == {"a": (5, 10), None: (1, 1), "c": (1, 0)}
    several = token_counts.changes(count((1, "old"), (3, "y y", "b")), "revise", 1).union(token_counts.changes(count((1, "new new"), (1, "and")), "revise", 2))
    token_counts.commit(store, "two", several.union(token_counts.changes(count((None, "")), "delete", 7)))
    found = {r.source: (r.documents, r.tokens) for r in token_counts.totals(spark, store).collect()}
    assert found == {"a": (2, 3), "b": (1, 2), "c": (1, 0)}


def test_an_interrupted_batch_is_not_read_and_holds_up_others(spark, documents, monkeypatch):
    store = fresh_path(spark, "rollups")
    count = lambda *rows: token_counts.count_tokens(documents(*rows), "blanks-1")
    state = lambda: [(r.documents, r.tokens) for r in token_counts.totals(spark, store).collect()]
    token_counts.commit(store, "1", token_counts.changes(count((1, "a b c")), "insert"))
    revise = token_counts.changes(count((1, "a b"), (8, "more")), "revise")
    real = token_counts._replace

    def dies(rows, path, *by):
        if path.endswith("totals"):
            raise OSError("lost")
        real(rows, path, *by)

    monkeypatch.setattr(token_counts, "_replace", dies)
    with pytest.raises(OSError):
        token_counts.commit(store, "2/x", revise)
    monkeypatch.setattr(token_counts, "_replace", real)
    assert state() == [(1, 3)]
    delete = token_counts.changes(count((1, "")), "delete")
    with pytest.raises(RuntimeError, match="2/x"):
        token_counts.commit(store, "3", delete)
    assert state() == [(1, 3)]
    token_counts.commit(store, "2/x", revise)
    token_counts.commit(store, "2/x", revise)
    assert state() == [(2, 3)]
    token_counts.commit(store, "3", delete)
    token_counts.commit(store, "2/x", revise)
    assert state() == [(1, 1)]


def test_a_commit_reads_the_buckets_of_its_ids(spark, documents):
    store = fresh_path(spark, "rollups")
    many = token_counts.count_tokens(documents(*[(i, "a b") for i in range(500)]), "blanks-1")
    token_counts.commit(store, "one", token_counts.changes(many, "insert"))
    bucket = spark.range(1).select(token_counts._bucket(F.lit(7))).first()[0]
    read = token_counts._standing(spark, store, {"one"}, [bucket])
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in scan and "PartitionFilters: [" in scan.replace("PartitionFilters: []", "")
    assert 0 < len(read.inputFiles()) and 0 < read.count() < 60


def test_counts_by_a_tokenizer_file(spark, documents):
    counted = {r.doc_id: r.tokens for r in token_counts.count_tokens(documents((1, "Hello, world"), (2, None)), "word_bpe_49k", SPEC).collect()}
    assert counted == {1: 3, 2: 0}


# ---- lines


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=150, deadline=None)
def test_patience_aligns_equal_lines_in_order(a, b):
    found = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x < x2 and y < y2 for (x, y), (x2, y2) in zip(found, found[1:], strict=False))
    assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def test_later_copies_lose_their_lines(spark, documents):
    line = lambda k: f"this is a rather long line number {k}"
    text = "\n".join(map(line, range(6)))
    docs = documents((5, text), (6, "new start of a text here\n" + "\n".join(map(line, [2, 3])) + "\nok\n  " + line(4)), (5, text), (7, "ok\nok"), *ODD, (8, "x\n\n"))
    found = line_dedup.repeated_lines(docs).collect()
    kept = sorted((r.row.doc_id or 0, r.kept_text or "", len(r.deleted)) for r in found if r.row.doc_id in (5, 6, 7, 8))
    assert kept == [(5, "", 6), (5, text, 0), (6, "new start of a text here\nok", 3), (7, "ok\nok", 0), (8, "x\n\n", 0)]
    assert len(found) == 5 + len(ODD) and sum(r.kept_text is None for r in found) == 2
    assert line_dedup.repeated_lines(empty(documents)).count() == 0


def shared_places(a, b, long_in_b):
    """Places in b of runs of lines with a long one that a holds, tried one by one."""
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    every = [range(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1)]
    return {k for r in every if any(long_in_b[x] for x in r) and tuple(b[r.start : r.stop]) in runs for k in r}


@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
@settings(max_examples=150, deadline=None)
def test_blocks_in_another_order_or_repeated(a, b):
    long_in_b = [x < 3 for x in b]
    assert set(line_dedup.common_blocks(a, b, long_in_b)) == shared_places(a, b, long_in_b)


def test_blocks_come_from_the_alignment(monkeypatch):
    assert line_dedup.common_blocks([1, 2, 3], [3, 1, 2], [True] * 3) == [0, 1, 2]
    real = line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: real(a, b)[:1])
    assert line_dedup.common_blocks([1, 2, 3, 4], [9, 1, 2, 3, 4], [False, True, False, False, False]) == [1]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.common_blocks([1, 2, 3], [3, 1, 2], [True] * 3) == []


def test_many_crossing_or_repeated_blocks_take_few_alignments(monkeypatch):
    seen, real = [], line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: seen.append(len(a) + len(b)) or real(a, b))
    n = 3_000
    for a, b in [(list(range(n)), list(range(n))[::-1]), ([1, 2], [1, 2] * n), ([0, 1] * n, [1, 0] * n), ([0, 1], [0] * n + [1])]:
        seen.clear()
        assert line_dedup.common_blocks(a, b, [True] * len(b)) == list(range(len(b)))
        assert sum(seen) <= 16 * (len(a) + len(b))


def test_lines_equal_the_comparison_of_all_overlapping_pairs(spark, documents):
    rng = random.Random(5)
    line = lambda k: f"ok {k}" if k >= 5 else f"this is a rather long line number {k}"
    picks = [[0, 1], [1, 0], [1, 0], [6, 2, 7], [3, 2, 4, 2, 0], [2, 7, 0], [0, 5, 1], [1, 5, 0], [1, 5, 0]]
    picks += [[rng.randrange(8) for _ in range(rng.randrange(9))] for _ in range(40)]
    docs = {i: [line(k) for k in own] for i, own in enumerate(picks)}
    found = {r.row.doc_id: r.deleted for r in line_dedup.repeated_lines(documents(*[(i, "\n".join(x)) for i, x in docs.items()])).collect()}
    for i, own in docs.items():
        long = [len(x) >= 20 for x in own]
        assert found[i] == sorted(set().union(*(shared_places(docs[p], own, long) for p in range(i))))


# ---- near duplicates


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:220], rng.integers(1, 1 << 62, 80).astype(np.uint64)])
    weights = rng.lognormal(size=380)
    w = {int(e): float(x) for e, x in zip(np.concatenate([a, b[220:]]), weights, strict=True)}
    wa, wb = (np.array([w[int(e)] for e in x]) for x in (a, b))
    in_b = set(b.tolist())
    wanted = 0.0
    for e in a.tolist():
        if e in in_b:  # sum over all elements of the larger of both relative weights
            others = sum(max((w[x] if x in w and i < 300 else 0.0), 0.0) for i, x in enumerate(a.tolist())) + sum(w[x] for x in b.tolist()[220:])
            wanted += w[e] / others
    owner = np.repeat([0, 1], [300, 300])
    made = minhash.sketches(np.concatenate([a, b]), np.concatenate([wa, wb]), owner, 2, 4096)
    assert np.mean(made[0] == made[1]) == pytest.approx(wanted, abs=0.03)
    alone = minhash.sketches(a, wa, np.zeros(300, dtype=int), 1, 4096)
    assert (alone[0] == made[0]).all()


def test_near_duplicates_of_odd_rows(spark, documents):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "changed", *words[101:]]
    far = [*words[:60], *[f"v{i}" for i in range(140)]]
    docs = documents((20, " ".join(words)), (11, " ".join(near)), (12, " ".join(far)), (13, " ".join(words).upper()), (14, "!!"), (15, "!!"), *ODD)
    found = minhash.near_duplicates(docs).collect()
    classes = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.class_size) for r in found if r.doc_id in (20, 11, 12, 13, 14, 15, 1))
    assert classes == [(1, 1, 2), (1, 1, 2), (11, 11, 3), (12, 12, 1), (13, 11, 3), (14, 14, 1), (15, 15, 1), (20, 11, 3)]
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["11", "12", "14", "15", "1", "2", "3", "None", "None", "4"])
    assert minhash.drop_near_duplicates(empty(documents)).count() == 0


@pytest.mark.parametrize("block", [minhash.BLOCK, 2])
def test_members_unlike_the_centre_are_linked(spark, documents, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 2)
    # All share a bucket. Its centres share most bands and are unlike everyone; groups of three are alike beside them.
    made = lambda i, k: " ".join([*[f"{k}x{j}" for j in range(60)], *([f"y{i}"] if i else [])])
    rows = [(10 * k + i, made(i, name)) for k, name in enumerate("abcd") for i in range(3)] + [(100 + i, made(0, f"u{i}")) for i in range(6)]
    longer = [(200, "z " * 3000 + "end"), (201, " ".join(f"long{j}" for j in range(900)))]  # no pair with these passes the filter by size
    sketched = minhash.sketch

    def one_bucket(*args, **options):
        found = sketched(*args, **options)
        key = lambda *bands: minhash.F.array(*[minhash.F.lit(x).cast("bigint") for x in bands])
        return found.withColumn("bands", minhash.F.when(minhash.F.col("doc_id").between(100, 201), key(1, 2, 3)).otherwise(key(1)))

    monkeypatch.setattr(minhash, "sketch", one_bucket)
    found = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_duplicates(documents(*rows, *longer)).collect()}
    wanted = {i: (10 * (i // 10), 3) if i < 100 else (i, 1) for i, _ in [*rows, *longer]}
    assert found == wanted


def test_prefix_filter_is_exact_and_leaves_out_half_alike_texts(spark, documents):
    common = [f"c{j}" for j in range(100)]
    half = [(i, " ".join([*common, *[f"o{i}x{j}" for j in range(60)]])) for i in range(600)]  # similarity below 0.5
    alike = [(1000 + i, " ".join([*[f"p{j}" for j in range(100)], f"e{i}"])) for i in range(5)]  # 0.97 or more
    made = minhash.sketch(documents(*half, *alike)).select("doc_id", "digest", "n")
    texts = made.join(documents(*half, *alike).select("doc_id", "text"), "doc_id").select("digest", "text")
    state = made.withColumn("component", minhash.F.col("digest"))
    pairs = minhash._prefix_pairs(minhash._prefixes(state, texts, 0.8), 0.8)
    ids = {bytes(r.digest): r.doc_id for r in made.collect()}
    found = {tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in pairs.collect()}
    assert found == {(1000 + i, 1000 + j) for i in range(5) for j in range(i + 1, 5)}
