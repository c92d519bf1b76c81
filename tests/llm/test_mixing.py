import itertools
import random

import pytest

from pointprep.llm import mixing
from tests.llm.conftest import EDGES


def test_quotas_stop_and_share_again():
    assert mixing.quotas([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.quotas([10, 1000], [3, 1]) == [20.0, 1495.0]
    assert sum(mixing.quotas([5, 0, 7, 900], [3, 1, 2, 3])) == pytest.approx(1.5 * 912)


def test_flow_is_of_least_cost():
    # Two patterns share a source; repetition is used only where fresh tokens run out.
    patterns = [((0,), 10), ((0, 1), 6), ((1,), 4)]
    targets = [18.0, 12.0]
    flows = mixing.route(patterns, targets, 2)
    assert sum(map(sum, flows)) == pytest.approx(30)
    assert sum(f[1] for f in flows) == pytest.approx(10)
    best = min(
        a[1] + b[1] + c[1]
        for a, b, c in itertools.product(*[[(n, r) for n in range(s + 1) for r in range(s + 1)] for _, s in patterns])
        if sum(map(sum, (a, b, c))) == 30
    )
    assert best == 10


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_sources_come_near_their_targets(spark, docs):
    rows = [(i, words(1 + i % 13), None if i % 7 == 0 else f"s{min(i % 11, 4)}") for i in range(3000)]
    out = mixing.mix_sources(docs(rows)).collect()
    assert len(out) == len(rows)
    source = {d: s for d, _, s in rows}
    size = {d: len(t.split()) for d, t, _ in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = [sum(size[d] for d in size if source[d] == n) for n in names]
    want = dict(zip(names, mixing.quotas(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    for n in names:
        own = [r for r in out if source[r["doc_id"]] == n]
        assert abs(sum(r["taken"] for r in own) - want[n]) <= 13
        assert all(r["target"] == pytest.approx(want[n]) and r["source_size"] == sum(size[x["doc_id"]] for x in own) for r in own)
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs(rows).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_overlapping_sources(spark):
    rows = [(i, words(5), [["a"], ["a", "b"], ["b", None], []][i % 4]) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = {r["doc_id"]: r for r in mixing.mix_sources(table, weights=(1, 1, 4)).collect()}
    assert len(out) == 400 and all(out[i]["taken"] == 0 for i in range(3, 400, 4))
    assert all(r["copies"] <= 2 for r in out.values())


def test_edges(spark, docs):
    assert mixing.mix_sources(docs([])).count() == 0
    out = {r["doc_id"]: r for r in mixing.mix_sources(docs(EDGES)).collect()}
    assert out[0]["size"] == out[1]["size"] == out[4]["size"] == 0 and out[0]["taken"] == 0
    assert out[7]["size"] == 5000 and len(out) == len(EDGES)
    assert mixing.mix_sources(docs([(1, None), (2, "")])).filter("taken > 0").count() == 0


def test_a_third_of_all_rows_under_a_null_key(spark, docs):
    rows = [(None if i % 3 == 0 else i, words(1 + i % 9) + f" {i}", f"s{i % 2}") for i in range(3000)]
    rows += [(77, "copy of one text", "s1")] * 500
    out = mixing.mix_sources(docs(rows)).collect()
    assert len(out) == len(rows)
    for target in {r["target"] for r in out}:
        per = [r for r in out if r["target"] == target]
        assert abs(sum(r["taken"] for r in per) - target) <= 12
    again = sorted((str(r["doc_id"]), r["draw"], r["taken"]) for r in mixing.mix_sources(docs(rows[::-1]).repartition(5)).collect())
    assert again == sorted((str(r["doc_id"]), r["draw"], r["taken"]) for r in out)


@pytest.mark.parametrize("seed", range(12))
def test_flow_equals_brute_force(seed):
    draw = random.Random(seed)
    members = [m for r in (1, 2, 3) for m in itertools.combinations(range(3), r)]
    patterns = [(m, draw.randint(0, 4)) for m in draw.sample(members, 4)]
    targets = [float(draw.randint(0, 9)) for _ in range(3)]
    flows = mixing.route(patterns, targets, 2)
    subsets = [set(s) for r in (1, 2, 3) for s in itertools.combinations(range(3), r)]

    def possible(taken):
        return all(sum(x for x, (m, _) in zip(taken, patterns) if set(m) <= s) <= sum(targets[i] for i in s) for s in subsets)

    ways = [t for t in itertools.product(*[range(2 * n + 1) for _, n in patterns]) if possible(t)]
    most = max(map(sum, ways))
    least = min(sum(max(0, x - n) for x, (_, n) in zip(t, patterns)) for t in ways if sum(t) == most)
    assert sum(map(sum, flows)) == pytest.approx(most) and possible([sum(f) - 1e-6 for f in flows])
    assert sum(f[1] for f in flows) == pytest.approx(least)
    assert all(f[1] <= 1e-6 or f[0] == pytest.approx(n) for f, (_, n) in zip(flows, patterns))


def test_a_flow_of_many_patterns():
    # One connected group: each pattern joins two neighbours on a ring of sources.
    n = 30_000
    flows = mixing.route([((i, (i + 1) % n), 3) for i in range(n)], [4.0] * n, 2)
    assert sum(f[0] for f in flows) == pytest.approx(3 * n) and sum(f[1] for f in flows) == pytest.approx(n)


def test_targets_of_many_sources(spark):
    sizes = {f"s{i * 7919 % 100_003:06d}": i * i % 977 for i in range(20_000)} | {"~": 5}
    names = sorted(sizes)
    want = mixing.quotas([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    table = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = sorted(mixing.source_targets(table, (3, 1, 2), 1.5, 2.0).collect(), key=lambda r: r["number"])
    assert [r["source"] for r in got] == names and [r["source_size"] for r in got] == [sizes[n] for n in names]
    assert [r["target"] for r in got] == pytest.approx(want)


def chosen(rows, draws, targets):
    """Copies of each document by brute force: documents of a source in their order, while their middle lies within the flow."""
    copies = {}
    for name, target in targets.items():
        own = sorted((draws[d], d, len((t or "").split())) for d, t, s in rows if s == name)
        total = sum(n for *_, n in own)
        for c in range(2):
            before, goal = 0, min(total, max(0, target - c * total))
            for _, d, n in own:
                copies[d] = copies.get(d, 0) + (goal > 0 and (goal >= total or before + n / 2 <= goal))
                before += n
    return copies


@pytest.mark.parametrize("by_key", [False, True])
def test_choice_equals_brute_force(spark, docs, monkeypatch, by_key):
    if by_key:
        # Tables about patterns are joined by pattern, the heavy ones dealt over tasks.
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
        spark.conf.set("pointprep.hotRows", "100")
    try:
        rows = [(i, words(1 + i * i % 40), None if i % 3 == 0 else f"s{i % 11}") for i in range(900)] + [(2000 + i, "own source", f"t{i}") for i in range(40)]
        out = mixing.mix_sources(docs(rows)).collect()
    finally:
        if by_key:
            spark.conf.unset("pointprep.hotRows")
    sizes = {n: sum(len(t.split()) for _, t, s in rows if s == n) for n in {s for *_, s in rows}}
    names = sorted(n for n in sizes if n is not None) + [None]
    targets = dict(zip(names, mixing.quotas([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    want = chosen(rows, {r["doc_id"]: r["draw"] for r in out}, targets)
    assert len(out) == len(rows) and {r["doc_id"]: r["copies"] for r in out} == want


def test_copies_of_one_document_are_cut_at_the_goal(spark, docs):
    # A third of all rows are one document without a key, read by several tasks.
    rows = [(None, "copy of one text", "a")] * 1000 + [(i, words(1 + i % 9), "b" if i % 2 else "c") for i in range(2000)]
    out = mixing.mix_sources(docs(rows).repartition(6)).collect()
    own = [r for r in out if r["doc_id"] is None]
    assert len(own) == 1000 and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2


def test_names_that_hold_separators(spark):
    table = spark.createDataFrame([(1, "one two", ["a\u0001sb"]), (2, "three four", ["a", "b"])], "doc_id long, text string, source array<string>")
    out = {r["doc_id"]: r for r in mixing.mix_sources(table, weights=(1,)).collect()}
    assert out[1]["source_size"] == 2 and out[2]["source_size"] == 4
