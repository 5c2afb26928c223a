"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline

from .test_llm import brute_groups, brute_repeats, sha, tokens


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    voc = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(240):
        if rows and r.random() < 0.3:
            w = r.choice(rows)[1].split(" ")
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(voc)
        else:
            w = [r.choice(voc) for _ in range(r.randrange(20, 60))]
        if r.random() < 0.15:
            w[3] = "Idiot"
        rows.append((i, " ".join(w)))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("Idiot" in t)) for i, t in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    now = [(i, t) for i, t in rows if "Idiot" not in t]
    assert sorted(x[0] for x in kept[0].select("doc_id").collect()) == [i for i, _ in now]
    first = {}
    for i, t in now:
        first.setdefault(t, i)
    now = [(i, t) for i, t in now if first[t] == i]
    assert sorted(x[0] for x in kept[1].select("doc_id").collect()) == [i for i, _ in now]
    groups = brute_groups(now, 5, 80)
    now = [(i, t) for i, t in now if groups[i][1] == i]
    assert sorted(x[0] for x in kept[2].select("doc_id").collect()) == [i for i, _ in now]
    cut = brute_repeats(now)
    texts = {x["doc_id"]: x for x in kept[3].collect()}
    assert {i: sha(x["text"]) for i, x in texts.items()} == {i: c[3] for i, c in cut.items()}
    assert all(x["n_chars"] == len(x["text"]) for x in texts.values())
    packed = {x[0]: x[1] for x in kept[4].groupBy("doc_id").sum("n_words").collect()}
    assert packed == {i: len(tokens(x["text"])) for i, x in texts.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()
