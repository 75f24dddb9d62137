"""A label map that follows additions and removals against the map of what is left."""

import numpy as np

from axiomloom.operators.lookup import ambiguous_labels, label_map
from axiomloom.schema import LABEL
from axiomloom.streaming.labels import current_ambiguous, current_labels, stream_labels

CHANGES = "change string, label string, iri string"


def test_labels_follow_changes(spark, tmp_path):
    rng = np.random.default_rng(6)
    left, batches = [], []
    for _ in range(3):
        rows = []
        for _ in range(150):
            if left and rng.random() < 0.4:
                rows.append(("remove", *left.pop(int(rng.integers(len(left))))))
            else:  # one label has a third of all changes; some annotations are told twice
                pair = ("hot" if rng.random() < 0.34 else f"label {rng.integers(30)}", f"http://x/{rng.integers(12)}")
                left.append(pair)
                rows.append(("add", *pair))
        rng.shuffle(rows)  # a removal may come before its addition
        batches.append([tuple(r) for r in rows] + [("add", None, "http://x/1"), ("add", "label 1", None), ("rename", "label 1", "http://x/1")])
    source, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        query = stream_labels(spark.readStream.schema(CHANGES).parquet(source), out, checkpoint)
        query.awaitTermination()
        assert query.exception() is None
    annotations = spark.createDataFrame([(iri, LABEL, label) for label, iri in left], "subject string, prop string, value string")
    assert {tuple(r) for r in current_labels(spark, out).collect()} == {tuple(r) for r in label_map(annotations).collect()}
    assert {tuple(r) for r in current_ambiguous(spark, out).collect()} == {tuple(r) for r in ambiguous_labels(label_map(annotations)).collect()}
