"""What a chunking task holds is bounded by a few texts."""

import pyarrow as pa
from askspark.operators import chunking as C


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    taken = {}
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, task, schema: taken.update(task=task) or self)
    C.chunk_documents(frame, 20, 0)
    n = 10 * C.ROWS_AT_ONCE
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "__text": ["some words " * 9] * n, "__size": [20] * n, "__overlap": [0] * n})
    made = list(taken["task"](iter([batch])))
    assert len(made) == 10 and pa.Table.from_batches(made).column("doc_id").unique().to_pylist() == list(range(n))
