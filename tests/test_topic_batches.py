"""Topics are looked for in a bounded number of bytes of text at a time, whatever the size of Spark's batches."""

from __future__ import annotations

import pyarrow as pa

from notemill.operators import sizing, topics


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    texts = spark.createDataFrame([], "id bigint, text string")
    asked = spark.createDataFrame([("topic1",), ("topic3",)], "topic string")
    tasks, sizes, find = [], [], topics.find
    monkeypatch.setattr(type(texts), "mapInArrow", lambda df, run, schema: tasks.append(run))
    monkeypatch.setattr(topics, "find", lambda part, machines: sizes.append(sum(map(len, part))) or find(part, machines))
    topics.occurrences(asked, texts)
    batch = pa.record_batch([pa.array(range(40)), pa.array(["x" * 200_000 + f" topic{i % 4} " for i in range(40)])], ["id", "text"])
    found = sorted((r["id"], r["topic"]) for out in tasks[0](iter([batch])) for r in out.to_pylist())
    assert found == [(i, f"topic{i % 4}") for i in range(40) if i % 2]
    assert max(sizes) <= 2 << 20


def test_slices(spark):
    batch = pa.record_batch([pa.array(["a" * 5, "b" * 5, None, "c" * 30, "d"])], ["t"])
    assert [x.num_rows for x in sizing.small_batches(iter([batch]), 0, 10)] == [3, 1, 1]
    sizes = []
    machines = topics.automata(["b"])
    for x in sizing.small_batches(iter([batch]), 0, 10):
        texts = [t or "" for t in x.column(0).to_pylist()]
        sizes.append(list(topics.find(texts, machines)))
    assert sizes == [[(1, "b")], [], []]
