"""The pipeline's stages against brute force, on rows with planted cases."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from lemmaflow.llm import store

from .test_pairs import brute_components, brute_removed, words
from .test_texts import invented

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, " ".join(invented(rng, rng.choice([60, 150, 400])))) for i in range(120)]
    passage = invented(rng, 70)
    bench = [(i, " ".join(invented(rng, 30)) + ".") for i in range(5)]
    leaks = {}
    for i in range(0, 30, 3):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:20] + passage + w[20:]))
    for i in range(31, 60, 7):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:10] + bench[i % 5][1].split() + w[10:]))
        leaks[i] = i % 5
    copies = {200 + i: 60 + i for i in range(6)}
    for new, old in copies.items():
        w = rows[old][1].split()
        w[3] = "changed" if new % 2 else w[3]
        rows.append((new, " ".join(w)))
    short = {300, 301, 302}
    rows += [(300, "few words"), (301, None), (302, "a b c " * 40), (60, rows[60][1])]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 4}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, leaks, copies, short, passage


def test_stages(spark, corpus):
    folder, rows, leaks, copies, short, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, folder), "stage")
        assert docs.columns == COLUMNS
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.count() == len(seen[-1]) or name == "quality rules"
    all_ids = {d for d, _ in rows}
    assert set(seen[0]) == all_ids - short
    texts = {d: t for d, t in rows if d in seen[0]}
    comps = brute_components(list(texts.items()), 5, 80, 100)
    assert set(seen[1]) == {d for d, (_, c) in comps.items() if c == d} and not set(copies) & set(seen[1])
    removed = {d: (n, digest) for d, _, n, digest in brute_removed(list(seen[1].items()), 50)}
    assert all(removed[i][0] >= 70 for i in range(0, 30, 3) if i in seen[2])
    assert {d: hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for d, t in seen[2].items()} == {d: x for d, (_, x) in removed.items()}
    assert set(seen[3]) == set(seen[2]) - set(leaks)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed}


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share a doc_id or have none are judged by their texts, the same way every time."""
    rng = random.Random(3)
    one, two, three = (" ".join(invented(rng, 40)) for _ in range(3))
    rows = [(7, one), (7, two), (7, two), (None, two), (None, three), (9, one + " more"), (5, three), (None, None), (4, "")]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(map(str, corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()))
        expected = [(7, one), (7, two), (5, three), (None, None), (4, "")]
        assert got == sorted(map(str, spark.createDataFrame(expected, "doc_id long, text string").collect()))


def test_clashing_columns(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'k' as kept", "'n' as n_words", "'c' as component_id", "'r' as n_removed", "'t' as kept_text", "'l' as _leaky", "'s' as s1")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, folder), "stage")
        row = docs.first()
        assert (row["kept"], row["n_words"], row["component_id"], row["n_removed"], row["kept_text"], row["_leaky"], row["s1"]) == ("k", "n", "c", "r", "t", "l", "s")


def test_empty(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = store.written(stage(spark, docs, folder), "stage")
        assert made.count() == 0
        docs = made if made.columns == COLUMNS else docs
