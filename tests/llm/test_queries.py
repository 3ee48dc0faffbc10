import random

import numpy as np
import pytest

import corpus_pipeline
from surrogata.llm import topk
from surrogata.llm.queries import ORACLE_SQL, QUERIES

from .test_near import document_set, jaccard


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    want = duck("/root/testdata/sf0.01").execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def brute_top(rows, k, every):
    fine = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("slice_rows,block,scale", [(512, 4096, 0.2), (7, 40, 0.2), (16, 64, 1e6)])
def test_top_k_against_all_pairs(spark, monkeypatch, slice_rows, block, scale):
    monkeypatch.setattr(topk, "SLICE", slice_rows)
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 16)
    draw = np.random.default_rng(7)
    rows = [(i, (draw.standard_normal(8) * scale * draw.choice([0.1, 1, 3])).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(80)]                 # ties
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8),
             (1080, [0.5] * 3), (1100, [1.5] * 3), (None, [0.1] * 8), (1120, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as g")
    got = topk.top_k(frame, k=5).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 5, 20) and len(got) == len({tuple(r) for r in got})


def test_top_k_edges(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])],
                                  "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(frame).collect()) == [(20, 1, 1, 4096), (20, 2, 1, 4096)]
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id = 20")).count() == 0


def test_top_k_in_passes_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "PASS_BYTES", 700)                           # two groups of queries at once
    draw = np.random.default_rng(8)
    rows = [(i, draw.standard_normal(8).round(1).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, k=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 3          # 20 queries, 5 groups
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5, 20)


def test_first_rows_are_found_by_the_last_key(spark):
    rows = spark.range(500).selectExpr("id % 250 as id", "cast(id * 7 % 50 as double) as a").repartition(7)
    got = [tuple(r) for r in topk._first(rows, ["a", "id"], 34).collect()]
    assert sorted(got) == sorted((r.id, r.a) for r in rows.orderBy("a", "id").limit(34).collect())


def test_pipeline_against_brute_force(spark, tmp_path, words):
    draw = random.Random(11)
    bench = [(k, " ".join(words(500 + k, 20))) for k in range(3)]
    common = " ".join(words(700, 60))
    rows = [(k, " ".join(words(k, draw.randint(30, 90)))) for k in range(120)]
    toxic = {k for k in range(120) if k % 4 == 0}
    rows = [(k, t + " vexon vexir vexon" if k in toxic else t) for k, t in rows]
    base = words(800, 160)
    near = []
    for k in range(8):                        # near copies whose lines differ enough to stay
        own = list(base)
        own[20 * k + 3] = f"new{k}"
        near.append((200 + k, "\n".join(" ".join(own[s:s + 8]) + f" {k}{k}{k} {s}zz{k}{k}{k}" for s in range(0, 160, 8))))
    flat = [(300 + k, " ".join(base[:100 + k])) for k in (0, 1)]
    rows += near + flat + [(400, bench[1][1] + " tail"), (401, common + "\n" + rows[1][1][::-1]),
                           (402, common + "\nown line of 402"), (403, common), (404, ""), (405, None), (404, "")]
    full = [(i, t, "en", "s", len(t) if t else 0) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(120)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert {i for i, _ in kept["toxicity"]} == {i for i, _ in rows} - toxic
    after = dict(kept["line_dedup"])
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    assert after[401].startswith(common) and after[402] == "own line of 402" and after[403] == ""
    ids = [i for i, t in kept["line_dedup"] if document_set(t)]
    sets = {i: document_set(after[i]) for i in ids}
    gone = {b for x, b in enumerate(sorted(ids)) for a in sorted(ids)[:x] if jaccard(sets[a], sets[b]) >= 0.8}
    assert {i for i, _ in kept["ngram_jaccard"]} == {i for i, _ in kept["line_dedup"]} - gone
    assert {i for i, _ in kept["decontamination"]} == {i for i, _ in kept["ngram_jaccard"]} - {400}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in kept["decontamination"]}
