from fractions import Fraction

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import mixing, queries


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=8))
def test_schedule_deviates_by_less_than_one_block(slots):
    order = mixing.pfair(slots)
    period = sum(slots.values())
    assert len(order) == period
    for s, n in slots.items():
        got = 0
        for t, x in enumerate(order + order, 1):
            got += x == s
            assert abs(got - Fraction(n * t, period)) < 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.tuples(st.integers(0, 60), st.integers(0, 5)), min_size=1, max_size=5))
def test_phases_give_each_block_one_slot(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    slots = {}
    for s, first, n, per, turn, start, period, place in mixing.phases(blocks, {s: w for s, (_, w) in sources.items()}):
        for i in range(turn, n, per):
            slots[start + i // per * period + place] = (s, first + i)
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert sorted(slots.values()) == sorted((s, i) for s, n in blocks.items() for i in range(n))


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    data = [(i, "x" * (i % 13), ["a", "a", "b", None][i % 4]) for i in range(200)] + [(900, None, "a"), (901, "y" * 300, "b"), (5, "x" * 5, "a"), (5, "x" * 5, "a")]
    d = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    rows = mixing.mixed(d, {"a": 3, "b": 1, None: 1}, block=20).collect()
    assert sorted((r.doc_id, r.text or "", r.source or "") for r in rows) == sorted((i, t or "", s or "") for i, t, s in data)
    for source in ("a", "b", None):
        own = sorted((r.block * 20 + r.offset, len(r.text or "")) for r in rows if r.source == source)
        place = 0
        for at, n in own:
            assert at == place
            place += n
        slots = {r.block: r.slot for r in rows if r.source == source}
        assert [slots[b] for b in sorted(slots)] == sorted(slots.values())
    assert mixing.mixed(d.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.mixed(d.where("doc_id = 900")).collect()] == [(900, None, "a", 0, 0, 0)]


def test_many_sources_and_clashing_names(spark):
    """Equal weights against the plan's own rule, with 1001 sources and further columns named like the operator's own."""
    names = ["turn", "start", "place", "period", "s", "r", "b", "n", "part", "chunk", "order", "rank", "inside", "blocks", "slot"]
    data = [(i, "x" * (40 + i % 50), f"w{i % 1001 if i < 3000 else i % 7}") for i in range(3400)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.mixed(d.select("*", *(F.lit(7).alias(c) for c in names)), block=100)
    assert got.columns == ["doc_id", "text", "source", *names[:-1], "block", "slot", "offset"]
    rows = got.collect()
    assert len(rows) == 3400 and all(r.turn == 7 for r in rows)
    blocks = {}
    for r in rows:
        blocks[r.source] = max(blocks.get(r.source, 0), -(-sum(len(t) for _, t, s in data if s == r.source) // 100)) if r.source not in blocks else blocks[r.source]
    order = sorted(blocks, key=lambda s: -blocks[s])
    slots = {(r.source, r.block): r.slot for r in rows}
    assert len(set(slots.values())) == len(slots)
    for (s, b), slot in slots.items():
        earlier = sum(min(n, b) for n in blocks.values())
        assert earlier <= slot < earlier + sum(n > b for n in blocks.values())
    assert max(slots.values()) < sum(blocks.values()) and len(order) == 1001
    some = mixing.mixed(d, {f"w{k}": 1 + k % 3 for k in range(5)}, block=100).collect()
    last = max(r.slot for r in some if r.source in {f"w{k}" for k in range(5)})
    assert len(some) == 3400 and min(r.slot for r in some if r.source not in {f"w{k}" for k in range(5)}) > last


def test_deviation_from_given_weights_over_many_slots():
    for weights in ({"a": 0.9999, "b": 0.0001}, {"a": 1, "b": 1, "c": 1}, {"a": 0.123, "b": 0.456, "c": 0.421}):
        total = sum(Fraction(str(w)) for w in weights.values())
        at = {}
        for s, _, n, per, turn, start, period, place in mixing.phases(dict.fromkeys(weights, 100_000), weights):
            if not start:
                for i in range(turn, min(n, 100_000), per):
                    at[i // per * period + place] = s
        got = dict.fromkeys(weights, 0)
        for t in range(100_000):
            got[at[t]] += 1
            if t % 97 == 0 or t > 99_900:
                assert all(abs(n - Fraction(str(weights[s])) / total * (t + 1)) < 1 for s, n in got.items())


@pytest.mark.parametrize(
    "weights",
    [dict.fromkeys("abcdefg", 1), dict.fromkeys("abcdefghijklmnopqrs", 1), {"a": 0.3, "b": 0.7}, {"a": 1 / 3, "b": 0.5, "c": 1e-5}],
    ids=["seven", "nineteen", "decimals", "long period"],
)
def test_plan_keeps_to_target_weights_over_many_periods(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    blocks = dict.fromkeys(weights, 5000)
    order = {}
    for s, _, n, per, turn, start, period, place in mixing.phases(blocks, weights):
        for i in range(turn, n, per):
            if not start:
                order[i // per * period + place] = s
    assert sorted(order) == list(range(len(order))) and len(order) >= 5000
    got = dict.fromkeys(weights, 0)
    for t in range(len(order)):
        got[order[t]] += 1
        assert all(abs(n - Fraction(str(weights[s])) / total * (t + 1)) < 1 for s, n in got.items())


def test_equal_sources_stay_together_when_others_run_out():
    blocks = {s: 3 + 5 * k for k, s in enumerate("gfedcba")}
    slots = {}
    for s, first, n, per, turn, start, period, place in mixing.phases(blocks, dict.fromkeys(blocks, 1)):
        for i in range(turn, n, per):
            slots[start + i // per * period + place] = s
    got = dict.fromkeys(blocks, 0)
    for t in range(sum(blocks.values())):
        got[slots[t]] += 1
        live = [n for s, n in got.items() if n < blocks[s]]
        assert not live or max(live) - min(live) <= 1


def test_long_table_of_turns(spark, monkeypatch):
    d = spark.createDataFrame([(i, "x" * 30, "abc"[i % 3]) for i in range(90)], "doc_id bigint, text string, source string")
    weights = {"a": 1 / 3, "b": 0.123456789, "c": 0.5}
    rows = sorted(tuple(r) for r in mixing.mixed(d, weights, block=50).collect())
    monkeypatch.setattr(mixing, "MOST_TURNS", 0)
    assert len(rows) == 90 and rows == sorted(tuple(r) for r in mixing.mixed(d, weights, block=50).collect())


def test_query_keeps_to_its_target_weights(spark):
    """The query's slots come from windows and deadlines, and no prefix of a phase deviates by a block."""
    sf = "/root/testdata/sf0.1"
    sizes = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    blocks = {r.source: -(-r.n // mixing.BLOCK) for r in sizes}
    at = {}
    for s, first, n, per, turn, start, period, place in mixing.phases(blocks, mixing.TARGETS):
        for i in range(turn, n, per):
            at[start + i // per * period + place] = (s, first + i)
    rows = queries.op7_mix_sources(spark, sf).select("source", "block", "slot").distinct().collect()
    assert len(rows) > 100 and all(at[r.slot] == (r.source, r.block) for r in rows)
    live, got, since, given = dict(mixing.TARGETS), dict.fromkeys(mixing.TARGETS, 0), 0, dict.fromkeys(mixing.TARGETS, 0)
    for t in range(len(at)):
        source = at[t][0]
        got[source] += 1
        given[source] += 1
        assert all(abs(given[s] - Fraction(w * (t + 1 - since), sum(live.values()))) < 1 for s, w in live.items())
        if got[source] == blocks[source]:  # a source is used up: the others share its slots from here on
            del live[source]
            since, given = t + 1, dict.fromkeys(mixing.TARGETS, 0)
    assert not live


def test_slots_of_the_sql(spark, tmp_path):
    """The SQL schedules slot by slot; here with few and many blocks, phases that end, and sources without a weight."""
    docs = [(k, "x" * (1 + 7919 * k % 90_000), [f"src{k * k % 23}", None, "other"][0 if k % 9 else k % 3 and 1 or 2]) for k in range(260)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = {r[0]: r[1:] for r in db.execute(f'SELECT doc_id, block, slot, "offset" FROM ({mixing.ORACLE_SQL})').fetchall()}
    assert {r.doc_id: (r.block, r.slot, r.offset) for r in queries.op7_mix_sources(spark, str(tmp_path)).collect()} == wanted
