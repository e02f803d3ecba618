"""Url rules, vectors, near duplicates, mixing, sharding and the pipeline against brute force."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from fieldglass.llm import credentials, minhash, mixing, queries, sharding, url_rules, vectors
from fieldglass.llm.components import connected_components
from fieldglass.llm.hnsw import Graph

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, block int, node bigint"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    text = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).round(6).itertuples(index=False)))
    assert text(a) == text(b)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


# ---- components


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    assert out == union_find({n for pair in links for n in pair}, links)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- url rules


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1",
    "https://xexample.com/en/", "http://a.net/es/1", "http://a.net/fr", "http://net/fr/", "ftp://a.net:80/fr/", "http://ÄB.com/É", "http://x.com?a://b", "a://b://c.net/es/",
    "http://example.com./en/", "http://" + "a." * 300 + "com/" + "p" * 5000, "http://a.org/en/",
]


def test_url_rules_by_brute_force(spark):
    rules = [*url_rules.RULES, ("block", "a.net", "/es/1"), ("allow", "org", ""), ("block", "org", "/en/")]
    urls = URLS * 3 + [f"http://h{i % 7}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(200)] + ["http://hot.net/es/1"] * 300
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id bigint, url string, part int, key string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()}
    assert out == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_edges(spark):
    rules = url_rules.rule_table(spark, url_rules.RULES)
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None), (1, None), (2**62 + 1, "http://a.net/es/")], "page_id bigint, url string")
    out = Counter((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, rules).collect())
    assert out == {(None, "allow"): 1, (1, "allow"): 2, (2**62 + 1, "block"): 1}
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r["rule"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {None}


# ---- vectors


def clustered(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1, base[:1] + rng.normal(size=(n - 2 * len(base), dim)) * 0.12])
    return rows.astype(np.float32)


@pytest.mark.parametrize("shard", [16_384, 60])
def test_vectors_by_brute_force(spark, shard):
    rows = clustered(400)
    label = [i % 3 if i % 11 else None for i in range(len(rows))]
    vecs = [r.tolist() for r in rows]
    vecs[5], vecs[6], vecs[7], vecs[8], vecs[9] = None, [0.0] * 16, [float("nan"), *vecs[7][1:]], [None, *vecs[8][1:]], vecs[9][:7]
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, (v, y) in enumerate(zip(vecs, label, strict=True))], "vec_id bigint, embedding array<float>, label int, id int, shard int")
    out = {r["vec_id"]: r for r in vectors.near_duplicates(df, shard=shard).collect()}
    links = []
    for i, v in enumerate(vecs):
        for j in range(i):
            w = vecs[j]
            if label[i] is None or label[i] != label[j] or v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            a, b = np.array(v, np.float64), np.array(w, np.float64)
            size = np.sqrt(a @ a) * np.sqrt(b @ b)
            if size > 0 and a @ b / size >= 0.98:
                links.append((i, j))
    counts = Counter(n for pair in links for n in pair)
    component = union_find(range(len(vecs)), links)
    assert len(links) > 200
    found = sum(out[i]["n_links"] for i in out) / (2 * len(links))
    assert found >= 0.995 and all(out[i]["n_links"] <= counts[i] for i in out)
    assert sum(out[i]["component_id"] != component[i] for i in out) <= 0.005 * len(out)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


def test_graph_recall():
    data = clustered(1500, 3, 32).astype(np.float64)
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    graph = Graph.build(unit.astype(np.float32))
    rows, _ = graph.search(unit[:200].astype(np.float32), 32)
    truth = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(rows, truth, strict=True)]) >= 0.95
    again = vectors.unpack_shard(vectors.pack_shard(np.arange(1500), data))[2]
    assert all((a[1] == b[1]).all() for a, b in zip(graph.layers, again.layers, strict=True))


def test_vector_edges(spark):
    df = spark.createDataFrame([(None, [1.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    out = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect())
    assert out == {(None, 0, None): 1, (1, 2, 1): 2, (2, 2, 1): 1}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# ---- near duplicates


def shingle_counts(text, length=5):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return Counter(tuple(words[i: i + length]) for i in range(max(1, len(words) - length + 1))) if words else Counter()


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        elements = rng.integers(0, 2**63, 300).astype(np.uint64)
        w1 = rng.random(300) * 3
        w2 = np.where(rng.random(300) < share, w1, w1 * 0.2)
        both, places = np.concatenate([elements, elements]), np.array([0, 300, 600])
        sig = minhash.dart_signatures(both, np.concatenate([w1, w2]), places, 2000)
        expected = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        assert (sig[0] == sig[1]).mean() == pytest.approx(expected, abs=0.05)


def test_dart_signatures_do_not_depend_on_the_limit():
    rng = np.random.default_rng(6)
    elements = rng.integers(0, 2**63, 50).astype(np.uint64)
    one = minhash.dart_signatures(elements, np.ones(50), np.array([0, 50]), 64)
    many = minhash.dart_signatures(np.concatenate([elements, elements[:1]]), np.ones(51), np.array([0, 50, 51]), 64)
    assert (one[0] == many[0]).all() and (many > 0).all()


@pytest.mark.parametrize("by_count", [False, True])
def test_near_duplicates_by_brute_force(spark, by_count):
    rng = np.random.default_rng(7)
    word = lambda: "w" + str(rng.integers(0, 3000))
    texts = []
    for g in range(12):
        base = [word() for _ in range(60 + 10 * g)]
        for c in range(14):
            copy = list(base)
            for _ in range(c // 3):
                copy[int(rng.integers(len(copy)))] = word()
            texts.append(" ".join(copy) + (" again again" * g if c % 5 == 4 else ""))
    texts += [texts[0]] * 5 + [None, "", "  ", "short one", "Short  ONE", "other"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, node int, bucket string")
    out = {r["doc_id"]: r for r in minhash.near_duplicates(df, by_count=by_count).collect()}
    counts = [shingle_counts(t) for t in texts]
    if not by_count:
        counts = [Counter(set(c)) for c in counts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if counts[i] == counts[j] or (
        counts[i] and counts[j] and sum((counts[i] & counts[j]).values()) >= 0.8 * sum((counts[i] | counts[j]).values()) - 1e-9)]
    expected = union_find(range(len(texts)), links)
    assert sum(out[i]["component_id"] != expected[i] for i in out) <= 1
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.values())


def test_blocks_of_a_mixed_bucket(spark, monkeypatch):
    """Members of one bucket in several blocks: every pair of components that links is found."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    sets = [np.arange(i // 5 * 100 + i % 5, i // 5 * 100 + i % 5 + 40).astype(np.uint64) for i in range(20)]
    df = spark.createDataFrame([(i, bytearray(s.tobytes()), bytearray(b"")) for i, s in enumerate(sets)], "node bigint, elements binary, weights binary")
    able = spark.createDataFrame([(1, i) for i in range(20)], "bucket bigint, node bigint")
    none = spark.createDataFrame([], "node bigint, component bigint")
    links = [(r["a"], r["b"]) for r in minhash._crossing_links(able, none, df, 0.8).collect()]
    assert union_find(range(20), links) == {i: i // 5 * 5 for i in range(20)}


def test_keep_one_of_each_with_repeated_rows(spark):
    long = " ".join(f"t{i}" for i in range(40000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "z z z"), (None, "z z z"), (3, None), (4, ""), (5, long), (6, long + " end")]
    df = spark.createDataFrame([(i, t, None, "s", None, "k", 1, 2) for i, t in rows], SCHEMA)
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 5), (1, 13), (3, 0), (5, len(long))]
    assert minhash.keep_one_of_each(df.limit(0)).count() == 0


# ---- mixing


def documents_like(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, block int, key string")


def test_mixing_against_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), None if s == 9 else f"s{s}", 1, 2, "k") for i, (n, s) in enumerate(zip(rng.integers(0, 900, 600), rng.choice(10, 600, p=[.35, *[.65 / 9] * 9]), strict=True))]
    plan = mixing.allocate(documents_like(spark, rows)).toPandas()
    mine = pd.DataFrame({"doc_id": plan["id"], "size": plan["size"], "source_size": plan["source_size"], "target": plan["target"], "taken": plan["size"] * plan["copies"]})
    sql = queries.MIX_SQL
    same_rows(mine, duck(sql, documents=pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "source"])))
    assert mine["target"].groupby(plan["source"].fillna("-")).first().sum() == pytest.approx(mine["size"].sum())
    for source, part in mine.groupby(plan["source"].fillna("-")):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 900, source
        assert (part["taken"] <= 3 * part["size"]).all() and part["target"].iloc[0] <= 3 * part["source_size"].iloc[0] + 1e-6
    assert (plan["shards"].map(len) == plan["copies"]).all()


def test_targets_by_repeated_sharing(spark):
    """Water filling equals sharing the excess by weight again and again."""
    rng = np.random.default_rng(9)
    for _ in range(4):
        sizes = {f"s{i:02d}": int(n) for i, n in enumerate(rng.integers(1, 5000, 9) ** 2 // 1000)}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        total, cut = sum(sizes.values()), {}
        while True:
            free = [s for s in sizes if s not in cut]
            left, all_weights = total - sum(cut.values()), sum(weight[s] for s in free)
            share = {s: left * weight[s] / all_weights for s in free}
            over = [s for s in free if share[s] > 3 * sizes[s]]
            if not over:
                break
            cut |= {s: 3.0 * sizes[s] for s in over}
        df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        out = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert out == pytest.approx(cut | share)


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([([100, 0, 37, 263],)], "quotas array<bigint>")
    runs = mixing.split_quotas(quotas, 3).toPandas()
    drawn = defaultdict(list)
    for r in runs.itertuples():
        drawn[r.position] += range(r.first, r.last + 1)
    assert {k: sorted(v) for k, v in drawn.items()} == {0: list(range(100)), 2: list(range(37)), 3: list(range(263))}
    per_shard = runs.assign(n=runs["last"] - runs["first"] + 1).groupby("shard")["n"].sum()
    assert per_shard.tolist() == [50] * 8
    halves = [mixing.split_quotas(quotas, 1, seed).where("position = 0 and shard = 0").first() for seed in range(12)]
    left = [h["last"] - h["first"] + 1 for h in halves]
    assert abs(np.mean(left) - 50) < 6 and np.std(left) > 1  # variance of the law is about 19 here


def test_mixed_rows(spark):
    rows = [(i, "a b c", f"s{i % 2}", 1, 2, "k") for i in range(40)] + [(0, "a b c", "s0", 1, 2, "k"), (None, None, None, 1, 2, "k"), (None, "", "s1", 1, 2, "k")]
    df = documents_like(spark, rows)
    mixed = mixing.mix(df)
    plan = mixing.allocate(df).toPandas()
    assert set(df.columns) <= set(mixed.columns)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == int((plan["size"] * plan["copies"]).sum())
    assert mixing.mix(df.limit(0)).count() == 0


# ---- sharding


def test_sharding_against_sql(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "é" * int(n)) for i, n in enumerate(rng.integers(0, 400, 500))] + [(900, "x" * 5000), (901, None)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sharding.shards(df, limit=3000).withColumnRenamed("id", "doc_id").toPandas()
    same_rows(out, duck(queries.SHARD_SQL.replace(str(sharding.LIMIT), "3000"), documents=frame))
    by = out.groupby("shard").agg(total=("bytes", "sum"), n=("bytes", "size"), said=("shard_bytes", "first"))
    assert (by["total"] == by["said"]).all() and ((by["total"] <= 3000) | (by["n"] == 1)).all()
    shards = sorted(by.index)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))


def test_sharding_splits_equal_rows(spark):
    df = spark.createDataFrame([(7, "y" * 100, 1, "b")] * 200 + [(None, "", 1, "b")] * 3, "doc_id bigint, text string, row int, bits string")
    out = sharding.shards(df, limit=1000).toPandas()
    assert len(out) == 203 and out.groupby("shard")["bytes"].sum().max() <= 1000
    assert sharding.shards(df.limit(0)).count() == 0
    one = sharding.shards(df.limit(2)).toPandas()
    assert one["shard"].tolist() == ["", ""]


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.keep_once(stage(spark, kept, SMALL), "stage")
        counts.append(kept.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        if name == "MinHash near-dedup":
            texts = [r["text"] for r in kept.collect()]
            assert len(set(texts)) == len(texts) and counts[-1] < counts[-2]
            assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "secret scans":
            assert counts[-1] == counts[-2]
            assert not any(credentials.strong_parts(r["text"]) for r in kept.collect() if "<" not in r["text"])
    ids = Counter(r["doc_id"] for r in kept.where("piece = 0").collect())
    mixed = Counter(r["doc_id"] for r in before.collect())
    assert ids == mixed and max(ids.values()) <= 3


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "the and of it " * 5, "en", None, 70), (2, "the and of it " * 5, "en", None, 70),
            (3, "12 34", None, "b", 5), (4, "the and of that with password=abcdefg", None, "b", 30)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in out} <= {2, 4} and bool(out) == bool(part)


def test_pipeline_of_the_folder_runs(spark):
    assert os.path.isdir(SMALL) and corpus_pipeline.run(spark, SMALL).count() > 0
