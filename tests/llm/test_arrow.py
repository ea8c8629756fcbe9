from tidemark.llm import arrow


def test_a_worker_keeps_things_of_one_operator(monkeypatch):
    monkeypatch.setattr(arrow, "_KEPT", {})
    made = []
    own = lambda op: arrow.lean(op, lambda batches: iter([arrow.kept(op, (1,), lambda: made.append(op) or op) for _ in batches]))
    assert list(own("a")([0, 0])) == ["a", "a"] and list(own("a")([0])) == ["a"] and made == ["a"]
    assert list(own("b")([0])) == ["b"] and list(arrow._KEPT) == ["b"]
    assert list(arrow.lean("c", lambda batches: iter(batches))([])) == [] and not arrow._KEPT


def test_batches_are_small(spark):
    arrow.bounded_batches(spark, arrow.SMALL_BATCH_BYTES)
    assert int(spark.conf.get(arrow.KEY)) <= 2_000_000
