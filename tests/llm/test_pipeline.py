"""The pipeline over a small folder of tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_tiles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    base = [" ".join(words(120, s)) for s in range(40)]
    near = base[0].split()
    near[60] = "changed"
    item = " ".join(words(30, 999))
    rows = [(i, t, "en" if i % 2 else "fr", "a", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[1], "en", "a", 1), (101, " ".join(near), "fr", "b", 1), (102, base[2] + " " + item, "en", "b", 1), (103, None, None, "b", None), (104, "12 34 --", "en", None, 8), (None, base[3] + " null id", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    first = stages["language_id"](spark, docs, folder)
    assert first.columns == docs.columns and {103, 104}.isdisjoint(r.doc_id for r in first.collect()) and first.count() == docs.count() - 2
    second = stages["near_dedup"](spark, first, folder)
    ids = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns and 100 not in ids and 101 not in ids and ids >= set(range(40)) - {2, 3}
    third = stages["decontaminate"](spark, docs, folder)
    assert third.columns == docs.columns and 102 not in {r.doc_id for r in third.collect()} and third.count() == docs.count() - 1
    fourth = stages["mix"](spark, docs, folder)
    assert fourth.columns == docs.columns and 0 < fourth.count() < 4 * docs.count()
    last = stages["shard"](spark, fourth, folder).collect()
    counts = Counter(r.shard for r in last)
    assert len(last) == fourth.count() and max(counts.values()) - min(counts.values()) <= 1


def test_run_is_the_stages_in_turn(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.doc_id for r in rows}.isdisjoint({100, 102, 103, 104})


def test_run_goes_on_in_its_folder(spark, folder, tmp_path):
    first = Counter(corpus_pipeline.run(spark, folder, str(tmp_path)).collect())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0-language_id", "1-near_dedup", "2-decontaminate", "3-mix"]
    assert Counter(corpus_pipeline.run(spark, folder, str(tmp_path)).collect()) == first


def test_near_dedup_and_decontaminate_match_plain_versions(spark, folder):
    r, rows = random.Random(12), []
    item = words(30, 999)
    for k in range(300):
        if k % 3 and rows:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                if w:
                    w[r.randrange(len(w))] = f"new{k}"
        else:
            w = words(r.choice([3, 40, 90]), 5000 + k)
        if k % 11 == 0:
            at = r.randrange(len(w) + 1)
            w = w[:at] + item[: r.choice([10, 20, 30])] + w[at:]
        rows.append((r.choice([None, k, k, k, 7]), " ".join(w), "en", r.choice(["a", None]), k))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "lang_pred", "replica", "shuffle_key", "row", "key", "text_key", "root", "_source")})
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for w in (t.lower().split() for _, t, *_ in rows)]
    group = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while any(group[i] != group[j] for i, j in near):
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    kept = [x.n_chars for x in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
    assert len(kept) == len({*kept}) and Counter(group[k] for k in kept) == Counter({*group})  # n_chars is the row's number here
    least = {g: min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if group[k] == g) for g in {*group}}
    assert all((rows[k][0] is None, rows[k][0] or 0) == least[group[k]] for k in kept)
    clean = {k for k, (_, t, *_) in enumerate(rows) if 2 * sum(n for *_, n in brute_tiles(t.split(), item, 4)) < len(item)}
    left = corpus_pipeline.decontaminate(spark, docs, folder)
    assert left.columns == docs.columns and Counter(x.n_chars for x in left.collect()) == Counter(clean) and 100 < len(clean) < 280
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.mix):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {x.score for x in out.collect()} <= {1}
    assert corpus_pipeline.shard(spark, docs, folder).count() == len(rows)


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
