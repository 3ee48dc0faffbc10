import random
import re

import numpy as np
import pyarrow as pa
import pytest

from surrogata.llm import minhash_dedup as md
from surrogata.llm.shingles import text_slices

from .test_near import groups

TABLE = "doc_id long, text string, node string, key long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of rows."""
    sets = [set_of(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = groups(range(len(rows)), linked)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, len(s), least.get(root[k]), i == least.get(root[k]))
                   for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(frame):
    return sorted((tuple(r) for r in md.near_components(frame).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(words):
    draw = random.Random(5)
    base, out = words(21, 120), []
    for _ in range(150):                                     # near copies around the threshold
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = f"e{draw.randrange(10_000)}"
        out.append(" ".join(own))
    own = words(22, 140)
    for k in range(25):                                      # a chain: the ends aren't linked
        own = list(own)
        own[5 * k] = f"step{k}"
        out.append("\t".join(own))
    out += [" ".join(words(23, 40))] * 30 + [" ".join(words(23, 40)).upper() + "\n"]
    out += [" ".join(words(23, 40)) + "!"]                   # marks are part of a word
    out += [" ".join(words(100 + k, draw.randint(1, 30))) for k in range(80)]
    out += ["", None, " \x0b\n", "one", "One ", "one two", "one  TWO", "one two three", "É é x", "É É x", "a\xa0b c"]
    ids = list(range(len(out)))
    draw.shuffle(ids)
    return list(zip(ids, out)) + [(None, out[0]), (None, "lost one two three"), (None, "lost one two three"),
                                  (None, None), (3, "another text of id three"), (ids[40], out[40])]


@pytest.mark.parametrize("block", [256, 16])
def test_components_against_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(md, "BLOCK", block)
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], TABLE).repartition(5)
    got = found(frame)
    assert got == brute(rows)
    assert sum(r[3] for r in got) < len(got) - 100


def test_edges(spark):
    empty = spark.createDataFrame([], TABLE)
    assert found(empty) == [] and md.near_components(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    long = " ".join(f"w{k % 5000}" for k in range(150_000))
    few = [(1, long), (2, long + " tail"), (3, None), (4, "")]
    assert found(spark.createDataFrame([(*r, "", 0) for r in few], TABLE)) == brute(few)


def test_sets_and_signatures(words):
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["a", "B", "ab", "é"]) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    [(_, data, off)] = list(text_slices(pa.array(texts)))
    shingles, bounds = md.shingle_prints(data, off)
    assert np.diff(bounds).tolist() == [len(set_of(t)) for t in texts]
    assert [len(md.shingle_set(md.normal(t))) for t in texts] == [len(set_of(t)) for t in texts]
    a, b = words(31, 400), words(31, 400)
    b[50:60] = words(32, 10)
    [(_, data, off)] = list(text_slices(pa.array([" ".join(a), " ".join(b)])))
    sig = md.minima(*md.shingle_prints(data, off))
    sa, sb = set_of(" ".join(a)), set_of(" ".join(b))
    assert abs((sig[0] == sig[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.12


def test_signature_bar():
    need = md.least_agreement()
    draw = np.random.default_rng(1).binomial(md.HASHES, 0.85, 1_000_000)
    assert (draw < need).sum() == 0 and need > 0.55 * md.HASHES


@pytest.mark.parametrize("seed", [0, 1])
def test_star_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    edges += [(700, k) for k in range(701, 900)] + [(1000, 1000)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = groups(nodes, [e for e in edges if e[0] != e[1]])
    got = md.star_components(spark.createDataFrame(edges, "c long, p long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
