"""What the operators leave to the driver."""

import numpy as np
from tests.llm.test_operators import labelled

from tessera.llm import quality


def test_the_classifier_is_fitted_by_a_task(spark, monkeypatch):
    docs, labels = labelled(spark, 90)
    rows = sorted((r.doc_id, bytes(r.x), r.y) for r in quality.training_rows(docs, labels, "quality", quality.MAX_TRAIN).collect())
    here = quality.fit([np.frombuffer(x, "<u4").astype(np.int32) for _, x, _ in rows], np.array([y for *_, y in rows]))

    def refuse(*_):
        raise AssertionError("the driver fits")

    monkeypatch.setattr(quality, "fit", refuse)
    model = quality.train(docs, labels)
    assert len(rows) > 50 and np.array_equal(model.weights, here.weights)
    assert (model.bias, model.slope, model.offset) == (here.bias, here.slope, here.offset)
