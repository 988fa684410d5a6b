"""The pipeline on a small corpus, each stage against a plain version of its rule."""

import numpy as np
import pytest

import corpus_pipeline
from chainhaul.llm import queries, secrets

from .helpers import classes, documents, words
from .test_operators import ITEMS, mixed, toxic_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, labels, _ = toxic_corpus(300, 11)
    rng = np.random.default_rng(5)
    clean = [k for k, v in enumerate(labels) if not v]
    plain = " ".join(f"q{k}" for k in range(60))
    texts += [texts[clean[3]], texts[clean[3]], plain, plain.replace("q30", "zz"), f"{plain[:90]} {ITEMS[1]} tail", "", None, "token = abcdefgh12345678 end of it all now"]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark, texts, sources=["b", "a", None]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, v, int(rng.integers(0, 2))) for k, v in enumerate(labels)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, labels


def test_stages(spark, folder):
    path, texts, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}.parquet")
        docs = spark.read.parquet(f"{path}/{name}.parquet")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    a, b, c, d, e = seen.values()
    assert set(a) == {k for k in range(len(texts)) if k >= len(labels) or not labels[k]}
    left = sorted(a)
    low = classes([texts[k] for k in left])
    assert set(b) == {k for n, k in enumerate(left) if low[n][1] == n}
    assert set(c) == set(b) - {304}
    assert set(d) == set(c)
    for k, r in d.items():
        want = texts[k]
        if want:
            for start, kind, end in reversed(secrets.base_spans(want)):
                want = f"{want[:start]}[{secrets.KINDS[kind]}]{want[end:]}"
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    own, target = mixed([len(words(r.text)) for r in d.values()], [r.source for r in d.values()])
    assert set(e) == set(d)
    for s in own:
        mine = [r for r in e.values() if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in mine) - target[s]) <= 120


def test_run_is_the_stages(spark, folder):
    path, _, _ = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {r.doc_id for r in spark.read.parquet(f"{path}/{corpus_pipeline.STAGES[-1][0]}.parquet").collect()}


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
