import re

from tidemark.llm.mixture import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(frame):
    return {(r["doc_id"], r["size"]): r for r in frame.collect()}


def test_sizes_and_targets(docs):
    data = [(i, "w " * (10 + i), f"s{i % 3}") for i in range(60)]
    got = mix(docs(data)).collect()
    sizes = {i: len(WORD.findall(t)) for i, t, _ in data}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    total = sum(sizes.values())
    for k, weight in enumerate((3, 1, 2)):
        own = [r for r in got if r["doc_id"] % 3 == k]
        size = sum(r["size"] for r in own)
        assert all(r["source_size"] == size for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)
        assert own[0]["target"] <= 2 * size
    assert abs(sum(r["target"] for r in {r["source"]: r for r in got}.values()) - 1.5 * total) < 1e-6


def test_excess_is_reshared_until_feasible(docs):
    got = mix(docs([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 100, "c")])).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target["a"] == 20 and target["c"] == 200
    assert abs(target["b"] - (1.5 * 1110 - 220)) < 1e-9


def test_reruns_agree_and_do_not_depend_on_partitions(docs):
    frame = docs([(i, "x " * (i % 17 + 1), None if i % 5 == 0 else f"s{i % 4}") for i in range(300)])
    one = sorted((r["doc_id"], r["taken"]) for r in mix(frame).collect())
    two = sorted((r["doc_id"], r["taken"]) for r in mix(frame.repartition(7)).collect())
    assert one == two


def test_null_source_comes_last(docs):
    got = {r["source"]: r["target"] for r in mix(docs([(1, "a " * 100, None), (2, "b " * 100, "z"), (3, "c " * 100, "é")]), budget=0.6).collect()}
    assert got["z"] == 90 and got["é"] == 30 and got[None] == 60


def test_odd_rows(docs, odd, spark):
    got = mix(docs(odd, extra=True)).collect()
    assert len(got) == len(odd)
    assert {r["doc_id"]: r["size"] for r in got} == {1: 0, 2: 0, 3: 0, 4: 60000, 5: 5, None: 5, 7: 3}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mix(docs([])).collect() == []
    assert [r["taken"] for r in mix(docs([(1, None), (2, "")])).collect()] == [0, 0]
