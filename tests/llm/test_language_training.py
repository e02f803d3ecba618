"""The text model is drawn from distinct texts."""

import numpy as np

from fieldglass.llm import language


def test_copies_count_once_and_every_label_has_texts(spark):
    """Labels of few distinct texts with many copies keep all their texts; copies do not change the model."""
    few = [(f"ord{k}a och{k}b det{k}c " + "xyz"[k % 3] * 5 + chr(97 + k), f"l{chr(97 + k)}") for k in range(12)]
    once = spark.createDataFrame([(t + x, label) for t, label in few for x in (" alfa", " beta")], "text string, label string")
    many = once.selectExpr("text", "label", "explode(sequence(1, 400)) as i").select("text", "label")
    languages, model = language.fit_text_model(many, "text", "label", train_rows=20)
    same, single = language.fit_text_model(once, "text", "label", train_rows=20)
    assert languages == same == sorted(label for _, label in few)
    assert np.array_equal(model, single)
    assert all(len(np.unique(table)) > 1 for table in model)
    assert (language.fit_text_model(once.unionByName(spark.createDataFrame([(None, "la")], "text string, label string")), "text", "label")[1] == single).all()
