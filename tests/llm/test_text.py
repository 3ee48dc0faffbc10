import html as entities
import itertools
import random
import re

import numpy as np
import pytest

from surrogata.llm import decontaminate, html_extract, language, toxicity
from surrogata.llm.tokens import Fingerprints

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_overlap(text, items):
    words = WORD.findall((text or "").translate(FOLD))
    hit, own = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(FOLD))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit |= set(range(j, j + n))
                    own.add(item)
    return len(words), len(hit), own


def test_overlap_against_a_plain_search(spark, words, edge_docs):
    draw = random.Random(4)
    items = [(k, " ".join(words(k, draw.randint(1, 30)))) for k in range(12)]
    items += [(12, items[0][1]), (13, None), (14, " ?! "), (None, " ".join(words(99, 20))), (3, items[3][1])]
    texts = []
    for k in range(60):
        own = words(1000 + k, draw.randint(0, 60))
        for _ in range(draw.randint(0, 2)):
            w = words_of(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(w) - 13))
            at = draw.randint(0, len(own))
            own[at:at] = [x.upper() if draw.random() < 0.2 else x for x in w[a:a + draw.randint(10, 20)]]
        texts.append(", ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") \
        .unionByName(edge_docs.where("doc_id in (1, 2, 5, 6)").selectExpr("doc_id + 100 as doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.SHARD_BYTES, 200):          # one shard, and many passes
        found, f = decontaminate.judged(docs, bench, shard_bytes=size)
        for r in found.collect():
            n, hit, own = brute_overlap(r.text, items)
            x = r[f]
            assert (x.n_words, x.n_hit, set(x.item_ids)) == (n, hit, own - {None})
            assert x.contaminated == (hit > 0 and 20 * hit >= n)
            marked = [w for a, b in zip(x.span_from, x.span_to) for w in WORD.findall(r.text[a:b].translate(FOLD))]
            assert len(marked) == hit
    kept = decontaminate.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert decontaminate.overlap_digest(edge_docs.limit(0), bench).count() == 0
    assert decontaminate.overlap_digest(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def words_of(text):
    return WORD.findall(text or "")


def test_clause_marks():
    i, t, p, n, r, o = (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION,
                        toxicity.REPORT, toxicity.OTHER)
    mark = lambda s: [toxicity.MARKS[m] for _, m in toxicity.mark_clause(s)]
    assert mark([o, i, o]) == ["insult"]
    assert mark([p, o, i]) == mark([i, p]) == ["insult_target"]
    assert mark([p, n, o, i]) == ["insult_denied"] and mark([n, o, o, o, o, i]) == ["insult"]
    assert mark([r, p, i]) == mark([toxicity.QUOTE, i]) == ["insult_reported"]
    assert mark([toxicity.QUOTE, o, toxicity.QUOTE, i]) == ["insult"]
    assert mark([t]) == ["threat"] and mark([t, p]) == ["threat_target"] and mark([n, t, p]) == ["threat_excused"]
    assert mark([]) == []


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"grumf": 6.0, "zork$": 4.0})
    score = lambda x: toxicity.scores([g.marks(x)], toxicity.PRIOR)[0]
    assert score("You are a grumfling.") > 0.5 > score("he said you are not a grumfling")
    assert score("a zorkish day") == score("a fine day") == score(None) < 0.1
    assert score("You zork! You zork! I kill you!") > score("You zork!")


def test_trigger_reads_every_clause_that_has_a_mark():
    g = toxicity.Grammar({"grumf": 6.0, "zork$": 4.0, "«$": 1.0})
    draw = random.Random(3)
    parts = ["grumf", "zork", "kill", "you", "_", "__", "2", "9", " ", " ", ". ", "é", "s", "«", "\n", "not "]
    for text in ["_zork_", "__grumfa__", "2zork", "zork9. you", *("".join(draw.choices(parts, k=9)) for _ in range(2000))]:
        sums = [0.0] * len(toxicity.MARKS)
        for clause in toxicity._CLAUSE.findall(text.lower()):
            read = [g.symbol(t) for t in toxicity._TOKEN.findall(clause)]
            for place, mark in toxicity.mark_clause([s for s, _ in read]):
                sums[mark] += read[place][1]
        assert g.marks(text)[:-1] == sums, text


def labelled(words, n=600):
    draw, rows = random.Random(6), []
    for i in range(n):
        own = words(i, draw.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                own.insert(draw.randint(0, len(own)), "vex" + draw.choice(["a", "on", "ir"]))
        rows.append((i, " ".join(own) + ".", int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, words, edge_docs):
    rows = labelled(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.selectExpr("doc_id", "1 as quality", "score as toxic")
    out = toxicity.toxicity_report(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == len(rows) and 60 < len(held) < 180
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and set(truth) - {r.doc_id for r in kept.collect()} <= {
        i for i, y in truth.items() if y}
    # labels of held-out rows are never used
    flipped = labels.withColumn("toxic", toxicity.held_out("doc_id").cast("int") * 0 + (
        (labels.toxic == 1) & ~toxicity.held_out("doc_id")).cast("int"))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity_report(docs, flipped).collect()} == {
        (r.doc_id, r.score) for r in out}
    more = toxicity.toxicity_report(edge_docs, labels).collect()
    assert len(more) == edge_docs.count() and all(r.score is not None for r in more)
    assert toxicity.toxicity_report(edge_docs.limit(0), labels).count() == 0
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(edge_docs, none).count() == edge_docs.count()


def test_forward_sums_all_segmentations():
    pieces = language.Pieces.__new__(language.Pieces)
    pieces.names, pieces.size = ["a", "ab", "b", "ba", "▁", "▁a"], 6
    pieces.table = Fingerprints(64)
    text = "".join(pieces.names)
    end = np.cumsum([len(n) for n in pieces.names])
    start = end - [len(n) for n in pieces.names]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    pieces.table.insert(language.span_hashes(codes, start, end), np.arange(6, dtype=np.int32))
    draw = np.random.default_rng(1)
    p = draw.random((7, 2))

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[pieces.names.index(word[:n]) if word[:n] in pieces.names else 6, k] * total(word[n:], k)
                   for n in (1, 2) if word[:n] in pieces.names or n == 1 if len(word) >= n)
    words = ["▁" + "".join(w) for n in range(1, 5) for w in itertools.product("abz", repeat=n)]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    s = language.word_scores(pieces, codes, np.cumsum(size) - size, size, p)
    want = [[np.log(total(w, k)) for k in (0, 1)] for w in words]
    assert np.allclose(s, want)
    # expected uses: moving a probability moves the log probability by uses / probability
    lattice = pieces.lattice(codes, np.cumsum(size) - size, size)
    uses = language.expected(lattice, size, p, np.ones((len(words), 2)))
    q = p.copy()
    q[1] *= 1 + 1e-6
    slope = (language.word_scores(pieces, codes, np.cumsum(size) - size, size, q) - s).sum(0) / 1e-6
    assert np.allclose(uses[1], slope, rtol=1e-3)


def test_language_on_held_out_rows(spark, edge_docs):
    draw = random.Random(9)
    sounds = {"xx": ["tha", "ing", "ster", "wo"], "yy": ["eau", "que", "lle", "oi"], "zz": ["sch", "ung", "ie", "ach"]}
    rows = []
    for i in range(300):
        lang = draw.choice(sorted(sounds))
        text = " ".join("".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 3))) for _ in range(12))
        rows.append((i, text, lang))
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 !!", None), (1003, "a" * 5000, None),
             (None, "thaing woster", "xx"), (1004, "THAING Woster", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert all(out[i].lang_pred == lang for i, t, lang in rows[:300])
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert out[1004].lang_pred == "xx" == out[None].lang_pred and 0 <= out[1003].score <= 1
    assert len(language.language_report(edge_docs).collect()) == edge_docs.count()
    assert language.language_report(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 0)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.language_report(unlabelled).collect()} == {"und"}


def test_lexicon_counts_different_texts(spark, words):
    """A stock insult is learned whatever precedes it; words of a much copied toxic text are not."""
    own = [" ".join(words(k, 40)) for k in range(400)]
    rows = [(f"{t} you grumfa.", 1) for t in own[:60]] + [(t, 0) for t in own[60:]] + [(f"{own[70]} grumfa", 0)]
    once = "wobbli snarke plimth quodda frenzo " + " ".join(words(999, 60))
    rows += [(f"{once} ending{k % 3}", 1) for k in range(80)]
    labelled = [(k, t, y) for k, (t, y) in enumerate(rows)]
    docs = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    found = toxicity.fit(docs, docs)[0].lexicon
    assert any("grumfa$".startswith(e) for e in found)
    assert not any(e in found for w in once.split()[:5] for e in toxicity.prefixes(w))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Start</a></li><li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">{ad}</div>
<article><header><h1>{title}</h1></header><p class="intro note">Sign up now</p><p>{one}<p>x <b>y</b>z &lt;ok&gt;&nbsp;!
<div class="share">tweet</div></article><section id="comments"><p>first!</section><aside>{ad}</aside>
<form><input><button>Go</button></form><footer>&copy; {ad}</footer><script>var a = "</p>";</script></body></html>"""


def test_article_of_a_templated_host(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(ad=f"buy {k}", title=f"Title {k}", one=f"Text   {k}.\n"))
            for k in range(6)]
    rows += [(10, "https://other.example/", "<div><p>alone</p></div>"), (11, None, None), (None, "x", ""),
             (12, "https://h.example/broken", "<article><p>cut off <b>he"), (13, "", "a &amp; b<br>c"),
             (13, "", "a &amp; b<br>c"), (14, "https://deep.example", "<div>" * 3000 + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = [(r.page_id, r.text, r.n_chars) for r in html_extract.page_texts(pages).collect()]
    want = [(k, f"Title {k} Text {k}. x yz <ok> !") for k in range(6)]
    want += [(10, "alone"), (11, ""), (None, ""), (12, "cut off he"), (13, "a & b c"), (13, "a & b c"), (14, "x")]
    assert sorted(out, key=str) == sorted([(k, t, len(t)) for k, t in want], key=str)
    named = pages.withColumnRenamed("page_id", "_host").withColumn("constant", pages.url)
    found, f = html_extract.extract(named)
    assert found.columns == [*named.columns, f] and found.count() == len(rows)
    assert html_extract.page_texts(pages.limit(0)).count() == 0


def test_varying_slots_without_an_article(spark):
    rows = [(k, "http://v.example/p", f"<body><div class='brand'>Brand</div><div class='body'><p>Only {k}</div>"
                                      f"<div class='sidebar'>{k}</div></body>") for k in range(4)]
    out = html_extract.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {f"Only {k}" for k in range(4)}


def test_constancy_over_the_host_chooses_the_content(spark):
    story = lambda k: f"Story {k} " + "long " * 20
    teaser = lambda k: f"<section><article>more on {k}</article></section>"
    rows = [(k, "http://a.example/", f"<article><div>Sign our list</div><p>{story(k)}</p></article>") for k in range(4)]
    rows += [(k, "http://b.example/", f"<div><p>{story(k)}</p></div>{teaser(k)}") for k in range(10, 14)]
    rows += [(k, "http://c.example/", f"<main><div>{story(k)}</div></main>{teaser(k)}") for k in range(20, 24)]
    rows += [(k, "http://d.example/", "<article><div>Same</div><p>text</p></article>") for k in range(30, 34)]
    rows += [(k, "http://e.example/", f"<article><p>{story(min(k, 44))}</p>{'<ul><li>kept</ul>' * (k > 43)}</article>"
                                      f"<div class=ad>{k}</div>") for k in range(40, 48)]
    out = html_extract.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    found = {r.page_id: r.text for r in out.collect()}
    want = {k: story(k).strip() for k in [*range(4), *range(20, 24), *range(40, 44)]}
    want |= {k: f"{story(k)}more on {k}" for k in range(10, 14)} | {k: "Same text" for k in range(30, 34)}
    want |= {k: f"{story(44)}kept" for k in range(44, 48)}
    assert found == want


def test_tree_matching_is_the_largest_ordered_match():
    a, b = "r(a b(c d) e)", "r(b(d) a e(x))"
    x, y = html_extract.tree_of(a), html_extract.tree_of(b)
    pairs = {(x.label[i], y.label[j]) for i, j in html_extract.align(a, b).items()}
    assert pairs == {("r", "r"), ("b", "b"), ("d", "d"), ("e", "e")}
    assert html_extract.align(a, "q") == {}


def test_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.page_texts(pages).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id])[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", article))
        assert r.text == " ".join(entities.unescape(plain).split())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_given_labels_and_languages(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    tox = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in tox) >= 0.93 * len(tox)
    lang = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) >= 0.97 * len(lang)
