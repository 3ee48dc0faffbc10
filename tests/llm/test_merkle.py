import hashlib
import random
import zlib

import pytest

from surrogata.llm import merkle

TABLE = "text string, doc_id long, lang string, source string, n_chars long, t long, idx string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    text, i, lang, source, n = row
    n = None if n is None else n + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(digests):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 2])) for k in range(0, len(last), 2)])
    return levels


def folded(digest, levels, i):
    siblings = []
    for level in levels[:-1]:
        pair = i ^ 1
        if pair < len(level):
            siblings.append(level[pair])
            digest = sha(digest + level[pair] if pair > i else level[pair] + digest)
        else:
            digest = sha(digest)
        i //= 2
    return digest, siblings


def brute(rows):
    out, groups = [], {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names]) if names else None
    for at, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            hit = row[1] is not None and zlib.crc32(str(row[1]).encode()) % 7 == 0
            sub, low = folded(leaf_of(row, int(hit)), trees[g], i)
            root, high = folded(sub, top, at)
            out.append((row[1], leaf_of(row), trees[g][-1][0], top[-1][0], sha("".join(low + high)), root,
                        root == top[-1][0]))
    return sorted(out, key=repr)


def report(frame):
    return sorted((tuple(r) for r in merkle.manifest_report(frame).collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_report_against_brute_force(spark, monkeypatch, bits):
    """Blocks of 2 to 8 leaves, so versions pass through several rounds above their block."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    draw = random.Random(bits)
    sizes = {None: 3, "": 1, "a": 37, "de": 2, "é": 5, "z": 8, "b": 64, "Ω": 1, "c": 17}
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((draw.choice(["", None, "x" * 50, "été\n", f"t{draw.random()}"]), draw.randrange(10_000),
                         lang, draw.choice([None, "web", "büch"]), draw.choice([None, 0, -5, 2 ** 63 - 1, 17])))
    rows += rows[:6] + [(None,) * 5, ("one id", 7, "a", None, 3), ("another text", 7, "a", None, 3)]
    draw.shuffle(rows)
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], TABLE).repartition(5)
    assert report(frame) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], TABLE)
    assert report(empty) == []
    one = [("text", 1, "en", "s", 4)]
    assert report(spark.createDataFrame([(*r, 1, "") for r in one], TABLE)) == brute(one)
    same = [("w " * 200_000, 9, "en", "s", 4)] * 3
    assert report(spark.createDataFrame([(*r, 1, "") for r in same], TABLE)) == brute(same)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13, 1000])
def test_versions_share_all_but_their_path(n):
    leaves = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)]
    levels = (n - 1).bit_length()
    tree = merkle.PathCopyTree(leaves, levels)
    base, root = len(tree.digest), tree.digest[tree.root]
    new = hashlib.sha256(b"new").digest()
    versions = {}
    for place in {0, n // 2, n - 1}:
        before = len(tree.digest)
        versions[place] = tree.replace(place, new)
        assert len(tree.digest) - before == levels + 1           # the leaf and its ancestors
        fresh = set(range(before, len(tree.digest)))
        for node in fresh:
            children = [c for c in (tree.left[node], tree.right[node]) if c >= 0]
            assert sum(c not in fresh for c in children) == max(0, len(children) - 1)
    for place, version in versions.items():
        own = list(leaves)
        own[place] = new
        again = merkle.PathCopyTree(own, levels)
        assert tree.digest[version] == again.digest[again.root]
        assert tree.digest[tree.path(place, version)[-1]] == new and tree.digest[tree.path(place)[-1]] == leaves[place]
        assert merkle.fold(leaves[place], tree.proof(place)) == root
        assert merkle.fold(new, tree.proof(place)) == tree.digest[version]
    assert tree.digest[tree.root] == root and tree.root < base
    two = tree.replace(n - 1, leaves[n - 1], versions[n - 1])    # a version of a version
    assert tree.digest[two] == root
