"""Conversation repair: the lightest derivation against a search over all edits, spans, odd rows."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventmine.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(letters, most):
    """(cost, audit) of the best edits found by trying all edit sequences that cost at most ``most``."""
    import re

    best = None

    def go(at, cost, audit, out):
        nonlocal best
        if cost > most or (best and (cost, audit) > best and cost > best[0]):
            return
        if at == len(letters) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if len(out) < 2 * len(letters) + 3:
            for x in "ua":
                go(at, cost + 2, audit + "I", out + x)
        if at < len(letters):
            c = letters[at]
            go(at + 1, cost + 3, audit + "D", out)
            if c != "x":
                more = c.isupper()
                go(at + 1, cost + more, audit + "K", out + c.lower())
                for x in "ua":
                    go(at + 1, cost + 2 + more, audit + "R", out + x)

    go(0, 0, "", "")
    return best


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.text("suaoSUAx", max_size=4))
def test_lightest_derivation_is_the_cheapest(letters):
    own = [[f"0 {t} {c} {a}" for t, (c, a) in R.lightest(letters, 0).items()]]
    got = R.joined(own)
    assert got == every_repair(letters, got[0])


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.text("suaoSUAx", max_size=40), st.integers(1, 7))
def test_spans_join_to_the_same(letters, n):
    def spans(size):
        return [[f"{q} {t} {c} {a}" for q in range(4) for t, (c, a) in R.lightest(letters[k:k + size], q).items()] for k in range(0, max(1, len(letters)), size)]

    assert R.joined(spans(n)) == R.joined(spans(100))


def test_damage(spark):
    rows = [(c, t, "assistant", f"Yes. {c}! no? {t}.") for c in range(30) for t in range(4)] + [(None, 3, None, None), (5, None, "system", "a.b")]
    got = {}
    for r in R.damage(spark.createDataFrame(rows, SCHEMA).withColumn("_copy", F.lit(1))).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    seen = set()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, "".join(x for x in text if x not in ".!?"))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((c, t), []) == want
        seen.add(kind)
    assert {0, 1, 2, 3, 4} <= seen


def brute(rows):
    """Per conversation, by a plain loop; ``rows`` as repaired (null roles and texts: one space)."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[0] if role[:1] in tuple("sua") and role else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = R.joined([[f"0 {t} {k} {a}" for t, (k, a) in R.lightest(letters, 0).items()]])
        out[c] = (gaps, *counts.values(), illegal, cost, audit, R.applied(audit, [r[1] for r in own], [r[2] for r in own]))
    return out


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "assistant", "no"),
    (2, None, "system", "s."), (2, None, None, "t."), (2, 3, "user", None), (2, 4, "user", ""), (None, 0, "user", "Hi."), (None, 1, "human", "Hi."),
    (3, 0, "user", " \n\t"), (3, 1, "assistant", ""), (4, 7, "assistant", "A.\n "), (5, 0, "", "x."), (5, 0, "system", "x."), (5, 0, "user", "x"),
    (6, None, "user", "a."), (6, None, "user", "a."), (7, 1, "user", "é" * 200_000 + "."), (7, 2, "assistant", "b." + " " * 200_000), (8, 3, "user", " "),
]


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in df.collect()}


@pytest.mark.parametrize("span", [256, 1, 2])
def test_odd_rows_equal_a_plain_loop(spark, span, monkeypatch):
    monkeypatch.setattr(R, "SPAN", span)
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("_conv", F.lit(1)).withColumn("audit", F.lit(2)).withColumn("_n", F.lit(3))
    for n in (1, 5):
        got = collected(R.repair(df.repartition(n)))
        assert got == brute(ODD)
    assert got[3][5:] == (6, "DD", []) and got[None][6] == "KR"
    assert R.repair(df.limit(0)).count() == 0


def test_a_long_conversation_is_many_spans(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 5 % 3], f"{t % 700}." if t % 11 else f"{t}") for t in range(5000)] + [(c, 0, "user", "x.") for c in range(2, 400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert collected(R.repair(df)) == brute(rows)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn")]
    ordered = df.selectExpr("conv_id", "role", "text", "'u' AS _letter", "turn").repartitionByRange(8, *order).sortWithinPartitions(*order).drop("turn")
    spans = R._spans(ordered, df.schema["conv_id"].dataType)
    per = [r.n for r in spans.where("_conv = 1").groupBy(F.shiftright("_at", 40)).agg(F.sum(F.length("_initials")).alias("n")).collect()]
    assert sum(per) == 5000 and max(per) < 2 * 5398 / 8


def test_query_against_a_plain_loop(spark):
    from eventmine.llm import queries

    sf = "/root/testdata/sf0.01"
    damaged = [tuple(r) for r in R.damage(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")).collect()]
    want = brute(damaged)
    rows = queries.op11_conversation_repair(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    for r in rows:
        w = want.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", []))
        text = "\n".join(f"{a}:{b}" for a, b in w[7])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == w[:7]
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
