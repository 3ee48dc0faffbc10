import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surrogata.llm import edit_counts, packing, repair, tokens

VOCABULARY = tokens.default_vocabulary()
PARTS = ["a", "Be", "'", "s", "t", "re", "'ll", "'s", " ", "  ", "\n", "\t", "1", "²", "é", "日", "_", "!",
         "'ve", "́", "😀", "<|endoftext|>", " ", "\x1c", " ", "Ⅷ", " 'd", " the", "\r\n"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=20), max_size=6))
def test_ids_equal_the_library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    ids, count = tokens.encode_texts(texts, VOCABULARY)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert count.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_long_texts_are_cut_and_tables_may_be_cleared(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 40)
    table = tokens.PretokenIds(VOCABULARY)
    table.table = tokens.Fingerprints(64)
    table.clear()
    monkeypatch.setattr(tokens, "pretoken_ids", lambda path: table)
    texts = [" ".join(f"word{i}" for i in range(90)), None, "no", "end of it " * 30]
    ids, count = tokens.encode_texts(texts, VOCABULARY)
    want = [library(x or "") for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want]


def test_fingerprints_are_the_polynomials():
    prime, base = (1 << 61) - 1, 12345678987654321
    draw = np.random.default_rng(3)
    for top in (100, 0x110000):                       # codes that are multiplied by 31 bits, by 21
        codes = draw.integers(0, top, 3000).astype(np.uint32)
        start = draw.integers(0, 2900, 50)
        end = start + draw.integers(0, 100, 50)
        want = [sum((int(c) + 1) * pow(base, k, prime) for k, c in enumerate(codes[s:e])) % prime
                ^ ((int(e - s) << 58) & (2 ** 64 - 1)) for s, e in zip(start, end)]
        assert (tokens.span_hashes(codes, start, end, base) == tokens.mix(np.array(want, np.uint64))).all()


def test_long_spans_have_the_same_fingerprints(monkeypatch):
    codes = np.random.default_rng(4).integers(0, 0x110000, 5000).astype(np.uint32)
    start, end = np.array([0, 3, 100, 1000, 2500]), np.array([5000, 400, 3100, 1400, 2500])
    want = tokens.span_hashes(codes, start, end)
    monkeypatch.setattr(tokens, "_SPAN_CODES", 1000)
    assert (tokens.span_hashes(codes, start, end) == want).all()


@pytest.mark.parametrize("n", [10, 11, 12])
def test_complementary_texts_have_their_own_ids(library, n):
    text = "a"
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    codes = np.frombuffer((text + other).encode("utf-32-le"), np.uint32)
    a, b = tokens.span_hashes(codes, np.array([0, len(text)]), np.array([len(text), 2 * len(text)]))
    assert a != b
    ids, count = tokens.encode_texts([text, other], VOCABULARY)
    assert ids.tolist() == library(text) + library(other) and count[0] == len(library(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_group_packing_wastes_nothing(sizes):
    out = packing.pack_group(sizes, 64)
    taken = defaultdict(list)
    for sequence in out:
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= 64 and (total == 64 or total & (total - 1) == 0)
        for i, s, n in sequence:
            taken[i].append((s, n))
    for i, size in enumerate(sizes):
        at = 0
        for s, n in sorted(taken[i]):
            assert s == at
            at += n
        assert at == size


def test_first_fit_decreasing_against_a_plain_search():
    draw = random.Random(1)
    for _ in range(30):
        sizes = [draw.randint(1, 50) for _ in range(draw.randint(0, 80))]
        room, bins = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(50)
                bins.append([])
            room[b] -= sizes[i]
            bins[b].append(i)
        assert packing.first_fit_decreasing(sizes, 50) == bins


def pieces_by_document(rows):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by, sequences


def test_packing_of_documents(spark, library, edge_docs):
    docs = edge_docs.where("doc_id is null or doc_id not in (4, 5)")
    by, _ = pieces_by_document(packing.packed_digest(docs).collect())
    want = {r.doc_id: library(r.text or "") + [0] for r in docs.where("doc_id is not null").collect()}
    for doc, ids in want.items():
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in by[None]) == 1 + len(library("some text without an id")) + 1
    assert packing.packed_digest(edge_docs.limit(0)).count() == 0
    assert sum(r.length for r in packing.packed_digest(edge_docs.where("doc_id = 4")).collect()) == 4
    with pytest.raises(ValueError):
        packing.pack(edge_docs, room=1000)


def test_packing_is_the_same_however_rows_are_dealt(spark, edge_docs):
    key = lambda d: sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in d.collect())
    a = packing.packed_digest(edge_docs.repartition(1))
    assert key(a) == key(packing.packed_digest(edge_docs.repartition(5)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=8))
def test_grammar_round_trip_and_random_access(docs):
    count = np.array([len(d) for d in docs], np.int64)
    ids = np.array([i for d in docs for i in d], np.uint32)
    s = repair.Shard(repair.body(list(range(len(docs))), count, ids, 6, rounds=5, rules_a_round=4, least=2))
    assert [s.document(i).tolist() for i in range(len(docs))] == docs
    assert s.expand(s.symbols).tolist() == ids.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8))
def test_grammar_to_exhaustion(docs):
    count = np.array([len(d) for d in docs], np.int64)
    ids = np.array([i for d in docs for i in d], np.uint32)
    s = repair.Shard(repair.body(list(range(len(docs))), count, ids, 4, least=2))
    assert [s.document(i).tolist() for i in range(len(docs))] == docs
    assert s.expand_all(s.symbols).tolist() == ids.tolist()


def test_grammar_of_a_run():
    ids = np.full(20_000, 7, np.uint32)
    s = repair.Shard(repair.body([0], np.array([len(ids)]), ids, 50))
    assert len(s.symbols) < 20 and (s.document(0) == 7).all() and len(s.document(0)) == 20_000
    draw = np.random.default_rng(2)
    text = np.tile(draw.integers(0, 40, 500), 40).astype(np.uint32)      # a passage forty times
    assert len(repair.Shard(repair.body([0], np.array([len(text)]), text, 50)).symbols) < 60


def test_grammar_shrinks_repetition():
    ids = np.array(list(range(50)) * 400, np.uint32)
    body = repair.body([0], np.array([len(ids)]), ids, 50, least=4)
    s = repair.Shard(body)
    assert len(s.symbols) < len(ids) / 20 and s.document(0).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        repair.Shard(b"something else")


def test_id_files(spark, library, edge_docs):
    rows = {(r.doc_id, r.start): r for r in repair.ids_round_trip(edge_docs, shard_ids=50_000).collect()}
    want, at = {}, 0
    nulls = sum(len(library(r.text or "")) + 1 for r in edge_docs.where("doc_id is null").collect())
    at = nulls
    for r in edge_docs.where("doc_id is not null").orderBy("doc_id").collect():
        ids = library(r.text or "") + [2]
        want[r.doc_id, at] = (len(ids), crc(ids))
        at += len(ids)
    assert {k: (v.n_tokens, v.ids_crc32) for k, v in rows.items() if k[0] is not None} == want
    assert sum(v.n_tokens for k, v in rows.items() if k[0] is None) == nulls
    assert repair.ids_round_trip(edge_docs.limit(0)).count() == 0


def test_complementary_texts_through_the_operators(spark, library):
    """Texts that collide under polynomials modulo a power of two, by themselves and within a text."""
    text = "a"
    for _ in range(11):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    texts = {1: text, 2: other, 3: f"{other} {text} x@y.example"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    want = {i: library(t) for i, t in texts.items()}
    for r in repair.ids_round_trip(docs).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]) + 1, crc(want[r.doc_id] + [2]))
    for r in packing.packed_digest(docs).collect():
        assert r.ids_crc32 == crc((want[r.doc_id] + [0])[r.start:r.start + r.length])
    for r in edit_counts.edit_counts(docs).collect():
        assert r.n_tokens == len(want[r.doc_id])


def test_edits_follow_a_full_count():
    draw = random.Random(5)
    for _ in range(60):
        current = "".join(draw.choice(PARTS + [" the cat", " sat on", " a b"]) for _ in range(draw.randint(0, 60)))
        tree = next(edit_counts.trees([current], VOCABULARY))
        for _ in range(5):
            a = draw.randint(0, len(current))
            b = min(len(current), a + draw.randint(0, 6))
            new = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 2)))
            tree.replace(a, b, new)
            current = current[:a] + new + current[b:]
            assert tree.current() == current and tree.length == len(current)
            assert tree.total == tokens.encode_texts([current], VOCABULARY)[1][0]


def test_edit_counts_against_encoding_again(spark, library, edge_docs):
    more = spark.createDataFrame([(20, "write to a.b@c.example or +1 (255) 555-8013 now, card 4587121519400672"),
                                  (21, "nothing here")], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in edit_counts.edit_counts(docs.where("doc_id is not null")).collect():
        masked, n = edit_counts.PERSONAL.subn(edit_counts.MASK, text[r.doc_id])
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars_edited) == (
            len(library(text[r.doc_id])), n, len(library(masked)), len(masked))
    assert edit_counts.edit_counts(docs.limit(0)).count() == 0
    assert edit_counts.edit_counts(docs.where("doc_id is null")).count() == 2


def test_the_table_of_fingerprints_grows_with_what_is_known():
    draw = np.random.default_rng(1)
    table = tokens.Fingerprints()
    assert table.slots.nbytes < 1 << 20
    h = np.unique(draw.integers(1, 1 << 63, 100_000, np.uint64))
    draw.shuffle(h)
    for at in range(0, len(h), 7_000):
        own = h[at:at + 7_000]
        assert (table.find(own) == -1).all()
        table.insert(own, np.arange(at, at + len(own), dtype=np.int32))
        assert (table.find(h[:at + 7_000]) == np.arange(min(len(h), at + 7_000))).all()
        assert 2 * table.known <= len(table.slots) <= max(tokens.FIRST_SLOTS, 4 * table.known)
    assert (table.find(draw.integers(1 << 63, 1 << 64, 1000, np.uint64)) == -1).all()
    table.clear()
    assert table.slots.nbytes < 1 << 20 and (table.find(h) == -1).all()
