"""Queries of the text operators against SQL, and against plain Python where SQL cannot say it."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from check_oracle import TABLES, compare, oracle_connection
from scrubwell.llm.queries import ORACLE, QUERIES
from scrubwell.llm.words import split_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.fixture(scope="module")
def docs(connection):
    assert "documents" in TABLES
    return dict(connection.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, connection, monkeypatch, name):
    import check_oracle

    monkeypatch.setattr(check_oracle, "ORACLE", ORACLE)
    assert compare(QUERIES[name](spark, SF), connection, name) is None


def secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_op2_finds_what_the_patterns_find(spark, docs):
    found = QUERIES["op2_secret_scan"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        wanted = secrets(docs[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in wanted)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kinds = Counter(k for _, _, k, _ in wanted)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert {*joined.split(",")} <= {*r.spans.split(",")}


def test_op4_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r in sorted(QUERIES["op4_token_files"](spark, SF).collect()):
        ids = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_op5_separates_the_classes_it_has_not_seen(spark, connection):
    sf = "/root/testdata/sf0.01"
    toxic = dict(connection.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    scored = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    assert len(scored) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in scored.items())
    held = [(toxic[i], r) for i, r in scored.items() if r.held_out and i in toxic]
    assert sum(r.predicted for y, r in held if y == 0) == 0
    assert sum(r.predicted for y, r in held if y == 1) >= 0.6 * sum(y for y, _ in held)


def near_groups(docs, similarity=0.8):
    """Smallest id of each document's group, by comparing all pairs that share a shingle."""
    shingles = {}
    for i, text in docs.items():
        words = split_words((text or "").encode())
        n = min(5, len(words))
        shingles[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    holders, parent = defaultdict(list), {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(docs):
        for j, both in Counter(j for s in shingles[i] for j in holders[s]).items():
            if both >= similarity * (len(shingles[i]) + len(shingles[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in shingles[i]:
            holders[s].append(i)
    return {i: find(i) for i in docs}


def test_op10_groups_as_all_pairs_do(spark, docs):
    wanted = near_groups(docs)
    found = QUERIES["op10_minhash_dedup"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in found} == wanted
    sizes = Counter(wanted.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_op10_finds_nearly_all_groups_of_a_larger_table(spark, connection):
    sf = "/root/testdata/sf0.01"
    wanted = near_groups(dict(connection.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()))
    found = {r.doc_id: r.class_id for r in QUERIES["op10_minhash_dedup"](spark, sf).collect()}
    assert found.keys() == wanted.keys()
    assert all(wanted[i] == wanted[c] for i, c in found.items())  # never more than all pairs link
    copies = [i for i, c in wanted.items() if c != i]
    assert sum(found[i] == wanted[i] for i in copies) >= 0.95 * len(copies) > 0


def shared_runs(a, b, long):
    """Places in b of equal stretches around every pair of equal long lines."""
    at = defaultdict(list)
    for i, x in enumerate(a):
        at[x].append(i)
    out = set()
    for j in (j for j in range(len(b)) if long[j]):
        for i in at[b[j]]:
            for step in (1, -1):
                k = 0
                while 0 <= i + k < len(a) and 0 <= j + k < len(b) and a[i + k] == b[j + k]:
                    out.add(j + k)
                    k += step
    return out


def test_op9_equals_the_diff_of_every_pair(spark, docs):
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in docs.items()}
    long = {i: [len(x) >= 20 for x in own] for i, own in lines.items()}
    holders = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            holders[x].add(i)
    for r in QUERIES["op9_line_dedup"](spark, SF).collect():
        own = lines[r.doc_id]
        partners = {p for x, of in zip(own, long[r.doc_id], strict=True) if of for p in holders[x] if p < r.doc_id}
        deleted = sorted(set().union(*(shared_runs(lines[p], own, long[r.doc_id]) for p in partners)))
        assert r.deleted == ",".join(map(str, deleted))
        kept = "\n".join(x for k, x in enumerate(docs[r.doc_id].split("\n")) if k not in deleted)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
