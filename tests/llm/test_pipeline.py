"""The pipeline's stages against plain ones, on a table with planted cases and on edge rows."""

import re
from collections import Counter

import corpus_pipeline as P
from test_jaccard import brute as groups_of

from tidemark.llm import toxicity
from tidemark.llm.common import Scratch


def folder(spark, tmp_path, rows, schema, items, labels=()):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path, texts):
    rows, labels = [], []
    for i in range(300):
        text = texts(i, 60 + i % 40)
        if i % 6 == 0:
            words = text.split()
            words[10], words[30] = "wretched", "wretched vileness"
            text = " ".join(words)
        if i % 10 == 1:
            text = texts(i - 1, 60 + (i - 1) % 40) + " end" if i % 20 == 1 else texts(7777, 90)
        if i % 50 == 3:
            text += " " + texts(9000, 40)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int("wretched" in text)))
    path = folder(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long", [(1, texts(9000, 40))], labels)
    scratch, docs = Scratch(spark), spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = scratch.write(stage(spark, docs, path), name)
        kept[name] = docs.collect()
        if name != "token_records":
            assert docs.columns == columns
    texts_of = {r[0]: r[1] for r in rows}
    left = sorted(i for i, t in texts_of.items() if "wretched" not in t)
    assert sorted(r["doc_id"] for r in kept["toxicity"]) == left
    left = sorted(i for i, _, c in groups_of([(i, texts_of[i]) for i in left]) if i == c)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == left
    left = [i for i in left if texts(9000, 40) not in texts_of[i]]
    assert sorted(r["doc_id"] for r in kept["benchmark_leaks"]) == left
    # Mixing: every source near its target, no document more than twice, order by position.
    size = {i: len(re.findall(r"\S+", texts_of[i])) for i in left}
    source = {r[0]: r[3] for r in rows}
    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) <= set(left) and max(times.values()) <= 2
    total = sum(size.values())
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - 1.5 * total) <= 4 * max(size.values())
    for s in sorted({source[i] for i in left}):
        assert sum(size[i] * times[i] for i in left if source[i] == s) <= 2 * sum(size[i] for i in left if source[i] == s)
    assert Counter(r["doc_id"] for r in kept["token_records"]) == times
    assert sorted(tuple(r) for r in P.run(spark, path).collect()) == sorted(tuple(r) for r in kept["token_records"])


def test_edge_rows_pass_all_stages(spark, tmp_path, edge):
    edge.withColumnRenamed("visits", "toxicity").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, scratch = spark.read.parquet(str(tmp_path / "documents.parquet")), Scratch(spark)
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
        if name == "toxicity":
            assert docs.count() == edge.count()
        if name == "near_duplicates":
            ids = Counter(r["doc_id"] for r in docs.collect())
            assert ids[1] == 1 and {4, 5, 6, 7, 9} <= set(ids) and not {2, 8} & set(ids)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path, empty):
    path = folder(spark, tmp_path, [], empty.schema, [], [])
    assert P.run(spark, path).count() == 0


def test_model_is_small_to_ship():
    import pickle

    model = toxicity.Model({"a": 1.0})
    model.word_score("abc")
    assert pickle.loads(pickle.dumps(model)).memo == {}
