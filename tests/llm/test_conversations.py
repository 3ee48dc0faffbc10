import hashlib
import random
import zlib

import pytest

from surrogata.llm import conversations as cv

TABLE = "conv_id long, turn long, role string, text string, seg long, conv string"
WHITE = " \t\n\x0b\x0c\r"


def plain_paths(rows, start=0, goals=(0, 3)):
    """Least (cost, audit) by relaxing all edits until nothing changes; rows are (initial, must go,
    truncated)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, start): (0, "")}
    while True:
        new = dict(best)
        for (i, q), (cost, audit) in best.items():
            moves = [((i, step[q, r]), 3, "I") for r in "ua" if (q, r) in step]
            if i < len(rows):
                initial, gone, cut_off = rows[i]
                moves.append(((i + 1, q), 4, "D"))
                if not gone:
                    extra = 3 * cut_off
                    moves += [((i + 1, step[q, r]), 3 + extra, "R") for r in "ua" if (q, r) in step]
                    if (q, initial) in step:
                        moves.append(((i + 1, step[q, initial]), extra, "K"))
            for to, more, edit in moves:
                label = (cost + more, audit + edit)
                if to not in new or label < new[to]:
                    new[to] = label
        if new == best:
            break
        best = new
    return min(best[len(rows), q] for q in goals if (len(rows), q) in best)


def brute(rows):
    """The report of damaged rows [(conv, turn, role, text)], by conversation."""
    damaged, out = [], {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        damaged += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv in {c for c, *_ in rows}:
        own = sorted((r for r in damaged if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marks, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            end = text.rstrip(WHITE)
            fault = ("blank" if not end else "duplicate" if (role, text) in seen
                     else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = plain_paths(marks) if own else (0, "")
        lines, todo = [], iter(own)
        for e in audit:
            turn_of = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if e == "I":
                lines.append(f"{turn_of}:")
                continue
            _, _, role, text = next(todo)
            if e != "D":
                lines.append(f"{role if e == 'K' else turn_of}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha)
    return out


def report(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in frame.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_search_against_all_edits(seed):
    draw = random.Random(seed)
    for _ in range(60):
        symbols = "".join(draw.choice("suaoSUAOxx") for _ in range(draw.randint(0, 9)))
        rows = [(c.lower(), c == "x", c.isupper()) for c in symbols]
        for a in range(4):
            for z in range(4):
                found = cv.cheapest_edits(symbols, a, z)
                try:
                    want = plain_paths(rows, a, (z,))
                except ValueError:
                    want = None
                assert found == want, (symbols, a, z)


def test_search_settles_equal_costs():
    """Deleting and rerolling cost differently, but u-u can be mended by an insert at two places."""
    assert cv.cheapest_edits("uu", 0, 3) == (3, "KR")
    assert cv.cheapest_edits("uxa", 0, 3) == (4, "KDK")
    assert cv.cheapest_edits("", 0, 0) == (0, "")
    assert cv.cheapest_edits("s", 0, 0) == (4, "D")
    assert cv.cheapest_edits("a", 3, 0) is None


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_report_against_brute_force(spark, monkeypatch, bits):
    """Segments of 2 and 4 rows, so most conversations are put together from several."""
    monkeypatch.setattr(cv, "SEGMENT_BITS", bits)
    monkeypatch.setattr(cv, "SEGMENT", 1 << bits)
    draw = random.Random(bits)
    rows = []
    for c in [None, *range(60)]:
        turns = draw.sample(range(14), draw.randint(1, 11))
        for t in turns:
            text = draw.choice(["Yes.", "No", "why? ", "  ", "", None, f"line {draw.random()}!", "a.b ", "été."])
            rows.append((c, draw.choice([t, t, t, None]) if t == 3 else t,
                         draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    rows += rows[5:9] + [(100, None, None, None)]
    rows += [(200, k % 40, "user" if k % 3 else "assistant", f"row {k % 50}.") for k in range(300)]
    draw.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], TABLE)
    got = frame.repartition(7)
    made = cv.damaged_report(got)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                            "repaired_sha256"]
    found, want = report(made), brute(rows)
    assert found == want and len(found) == len({r[0] for r in rows})


def test_report_of_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert report(cv.damaged_report(frame)) == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "There."), (2, 5, "assistant", "Ok.")]
    out = cv.repair_conversations(spark.createDataFrame([(*r, 0, "") for r in rows], TABLE)).collect()
    assert sorted(tuple(r) for r in out if r.conv_id == 1) == [
        (1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "There.", "R")]
    assert sorted((r.place, r.role, r.text, r.edit) for r in out if r.conv_id == 2) == [
        (0, "user", "", "I"), (1, "assistant", "Ok.", "K")]


def test_edges(spark):
    empty = spark.createDataFrame([], TABLE)
    assert cv.damaged_report(empty).count() == 0 and cv.repair_conversations(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = cv.damaged_report(spark.createDataFrame([(gone, 0, "user", "x.", 1, "")], TABLE)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 40_000 + f"{t}.", 1, "") for t in range(4)]
    named = spark.createDataFrame(long, TABLE).selectExpr(
        "cast(conv_id as string) as conv_id", "turn", "role", "text")
    [row] = cv.repair_report(named).collect()
    assert (row.conv_id, row.cost, row.audit) == ("1", 0, "KKKK")
