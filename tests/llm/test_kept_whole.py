"""No language, row or column is lost: many languages, null, repeated and text ids, clashing names."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import credentials, language, minhash, mixing, vectors

CLASHING = [
    "_id_a", "_ID_B", "_id_a_", "_clean", "_shards", "_shard", "_order", "_copy", "_id", "_of", "_words", "_label", "_kept", "_own",
    "_declared", "_t", "_prior", "_log", "_best", "_chances", "_counts", "_level_0", "letters", "evidence", "id", "of", "words", "size",
    "label", "any", "component_id", "kept", "_row", "node", "key", "block", "shards", "language",
]


def test_each_of_a_hundred_languages_is_found_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(100):
        words = ["".join(rng.choice(letters, 5)) for _ in range(40)]
        rows += [(f"{chr(97 + k // 10)}{chr(97 + k % 10)}", " ".join(rng.choice(words, 25)), i, "s") for i in range(14)]
    df = spark.createDataFrame(rows, "lang string, text string, i int, source string")
    languages, model = language.fit_text_model(df.where("i < 10"), "text", "lang")
    assert len(languages) == len(model) == 100
    held = df.where("i >= 10").withColumn("none", F.lit(None).cast("string"))
    found = language.identify(held, "text", "none", ["source"], languages, model, ["lang"])
    right = {r["lang"]: r["n"] for r in found.where("lang = language and accepted").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert right == {name: 4 for name in languages}


def test_model_rows_are_the_log_chances(spark):
    df = spark.createDataFrame([("de", "der die das"), ("en", "the and of"), ("en", "the and off"), (None, "la")], "lang string, text string")
    languages, model = language.fit_text_model(df, "text", "lang")
    for k, name in enumerate(languages):
        table = np.full(language.BUCKETS, language.FLOOR)
        for text in [t for l, t in (("de", "der die das"), ("en", "the and of"), ("en", "the and off")) if l == name]:
            np.add.at(table, language.trigrams([text])[0], 1)
        assert np.allclose(model[k], np.log(table / table.sum()), rtol=1e-6)


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of each inner name, all holding the document's number."""
    text = "the quick brown fox jumps over the lazy dog and then runs away from number {}"
    rows = [(i, text.format(i % 30) if i % 7 else None, "en", "ab"[i % 2], 70) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASHING])


@pytest.mark.parametrize("stage", [
    language.keep_identified, minhash.keep_one_of_each, credentials.redact, lambda d: mixing.mix(d).select(*d.columns)],
    ids=["language", "minhash", "secrets", "mixing"])
def test_columns_with_inner_names_stay(clashing, stage):
    out = stage(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHING)


def test_mix_names_its_own_columns_apart(clashing):
    assert mixing.mix(clashing).columns[-3:] == ["_copy_", "_shard_", "_order_"]


def test_redaction_leaves_the_session_as_it_is(spark, clashing):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    credentials.redact(clashing).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_redaction_leaves_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    """The stage's caller writes its rows; a copy of its own would stay on disk through the stages after it."""
    written = []
    monkeypatch.setattr("fieldglass.llm.tables.scratch_path", lambda _, label: written.append(label) or str(tmp_path / f"{label}-{len(written)}"))
    rows = [(i, f"password = hunter{i:05d}x and more" if i % 3 else None, 9) for i in range(250)]
    out = credentials.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int"))
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found == {i: ("<assign> and more", 17) if i % 3 else (None, 9) for i in range(250)}
    assert not written and not list(tmp_path.iterdir())


def test_every_vector_has_its_row(spark):
    """Null and repeated ids with unlike vectors; ids of text."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a), (None, b), (None, b), ("x", a), ("x", c), ("w", c), ("y", None), ("y", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id string, embedding array<double>, label int")
    out = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    assert out == {
        (None, 1, "x", False): 1, (None, 1, None, True): 2, ("x", 1, "x", True): 1, ("x", 1, "w", False): 1, ("w", 1, "w", True): 1,
        ("y", 0, "y", True): 2}
