"""Reworded notices in the corpus do not teach the model to reject notices."""

from pyspark.sql import functions as F

from fieldglass.llm import licences

SMALL = "/root/testdata/sf0.001"
REWORDED = [
    "This project is licensed under the terms of the MIT license and comes as it is.", "The code of the project is released under the MIT License by its makers.",
    "All rights reserved.", "You can redistribute it under the terms of the GNU General Public License, version 3 or later.",
    "Our files are licensed under the Apache License, Version 2.0, as all of the project.",
]


def test_reworded_notices_in_the_corpus(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("text is not null")
    # One paragraph in a hundred is a reworded notice.
    lines = [x for r in documents.collect() for x in r["text"].split("\n")] * 4
    lines = [f"{x} {i}." for i, x in enumerate(lines)]
    for i in range(0, len(lines), 100):
        lines[i] = f"{REWORDED[i // 100 % len(REWORDED)]} {i}."
    corpus = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string")
    trained = licences._unlike_notices(spark, corpus).where(F.col("doc_id") % 100 == 0).collect()
    assert trained == []
    model = licences.fit(corpus)
    assert model.least < 0.9
    rows = [(i, f, t) for i, (f, t) in enumerate(licences.TEMPLATES)] + [(1000 + i, "", x) for i, x in enumerate(lines[1:100])]
    out = licences.families_of_documents(spark.createDataFrame(rows, "i int, expected string, text string"), model=model).collect()
    assert [(r["i"], r["licences"]) for r in out if r["licences"] != r["expected"]] == []
