"""The registered queries' columns and digests, models and stages, against plain versions over a small folder; trees that outlive a run."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citygeo.llm import op03_language as op3
from citygeo.llm import op05_mixing as op5
from citygeo.llm import op06_quality as op6
from citygeo.llm import op07_sharding as op7
from citygeo.llm import op10_tokens as op10
from citygeo.llm.queries import QUERIES
from tests.llm.test_operators import brute_base, brute_personal, brute_ring, brute_statistics, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, replica int, counts int"
SPEECH = {"en": "the and of that with ing", "de": "der und die das nicht ung", "fr": "le la les des eaux que", "es": "el los que ción para del", "pt": "não uma dos são com"}


def some_rows():
    r = random.Random(21)
    bits = ["a.b@c.org", "john at mail dot com", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234-5678", "four one one", "MIT License", "GNU General Public License", "apache license 2.0", "#*", "é", "名前", "12345678", "\n", "same line\n"]
    rows = []
    for k in range(120):
        lang = r.choice([*SPEECH])
        w = [r.choice(SPEECH[lang].split()) + r.choice(["", "a", "en"]) for _ in range(r.randrange(5, 90))] + r.choices(bits, k=r.randrange(8))
        r.shuffle(w)
        rows.append((k, " ".join(w), lang))
    rows += [(200, None, "en"), (201, "", "de"), (202, " \n\t", None), (203, "12 -- 34", "fr"), (None, "the and of that without id", "en"), (5, "repeated id der und die", "de"), (7, rows[7][1], "en"), (204, "same line\n" * 60, "en")]
    return [(i, t, lang, r.choice(["a", "a", "b", None]), k, 9.0, "x", 9, 9) for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame(some_rows(), SCHEMA).repartition(4).write.parquet(f"{out}/documents.parquet")
    labels = [(k, int(k % 3 > 0)) for k in range(0, 120, 2)] + [(0, 1), (None, 1), (4, None), (999, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return out


def result(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def test_personal_data_columns(spark, folder):
    want = Counter()
    for i, t, *_ in some_rows():
        base = brute_personal(t or "")
        listed = [f"{kind}:{a}:{b}" for kind in ("email", "ip", "card", "phone") for a, b in base[kind]]
        want[i, *[len(base[k]) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(listed).encode()).hexdigest()] += 1
    found = result(spark, folder, "op4_personal_data")
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    added = 0
    for r in found:
        spans = [s for s in r.spans.split(",") if s]
        order = [("email ip card phone".split().index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order) and r.n_added == len(spans) - r.n_email - r.n_ip - r.n_card - r.n_phone >= 0
        added += r.n_added
    assert added > 0


def test_license_and_quality_columns(spark, folder):
    given = some_rows()
    found = result(spark, folder, "op9_license_rules")
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter((i, *brute_base(t or "")) for i, t, *_ in given)
    assert all({*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in found)
    found = result(spark, folder, "op6_quality_trees")
    want = Counter()
    for i, t, *_ in given:
        n = brute_statistics(t or "")
        want[i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in found)


def test_shard_columns(spark, folder):
    found = result(spark, folder, "op7_ring_sharding")
    given = [((t or "").encode()) for _, t, *_ in some_rows()]
    assert Counter((r.size, r.text_crc32) for r in found) == Counter((len(t) + 1, zlib.crc32(t)) for t in given)
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(counts[s])) for s in range(8))


def test_token_columns(spark, folder):
    full = op10.encoder(op10.VOCABULARY).encode_ordinary

    def cleaned(t):
        seen, out = set(), []
        lines = t.split("\n")
        for k, line in enumerate(lines):
            if line.strip() and line in seen:
                continue
            seen.add(line)
            out.append(line + ("\n" if k < len(lines) - 1 else ""))
        return re.sub("[0-9]{5,}", "0", "".join(out))

    want = Counter((i, len(t or ""), len(re.findall(r"\S|\s", t or "")) and len(op10._PIECE.findall(t or "")), len(full(t or "")), len(full(cleaned(t or "")))) for i, t, *_ in some_rows())
    found = result(spark, folder, "op10_token_counts")
    assert Counter((r.doc_id, r.n_chars, r.n_pretokens, r.n_tokens, r.n_tokens_after) for r in found) == want
    assert any(r.n_edits for r in found)


def grams(text):
    """Buckets of all n-grams of a text, one after the other."""
    data, _ = op3.simple_bytes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    for n in op3.SIZES:
        for at in range(len(data) - n + 1):
            code = int(data[at])
            for b in data[at + 1 : at + n]:
                code = code * 0x01000193 & 0xFFFFFFFF ^ int(b)
            yield (code * (2 * n + 1) & 0xFFFFFFFF) * 0x9E3779B1 % 2**32 >> 32 - op3.BITS


def plain_prediction(model, text):
    """Language and score of a text by plain dot products: the best family, then votes of its pairs."""
    if not text or not any(c.isalpha() for c in text) or not model.languages:
        return "und", 0.0
    own = list(grams(text))
    margin = [sum(float(w[g]) for g in own) / max(1, len(own)) + float(b) for w, b in zip(model.weights, model.bias)]
    sure = [1 / (1 + math.exp(-4 * max(-50, min(50, m)))) for m in margin]
    k = max(range(len(model.families)), key=lambda f: margin[f])
    inside = [x for x in model.languages if op3.family_of(x) == model.families[k]]
    wins, strength, rivals = Counter(), Counter(), Counter()
    for p, (a, b) in zip(sure[len(model.families) :], model.pairs):
        a, b = model.languages[a], model.languages[b]
        wins[a if p > 0.5 else b] += 1
        strength[a] += p
        strength[b] += 1 - p
        rivals.update([a, b])
    best = max(inside, key=lambda x: wins[x] + strength[x] / (len(model.languages) + 1))
    return best, (sure[k] if len(model.families) > 1 else 1.0) * (strength[best] / rivals[best] if rivals[best] else 1.0)


@pytest.fixture(scope="module")
def model(spark, folder):
    return op3.fit(spark.read.parquet(f"{folder}/documents.parquet").filter(~op3.held_out()))


@pytest.mark.parametrize("step", [1 << 20, 61])
def test_margins_are_plain_dot_products(model, monkeypatch, step):
    monkeypatch.setattr(op3, "STEP", step)
    given = [t for _, t, *_ in some_rows()] + ["ÉTÉ été " * 40, "a", "ab", "名前 " * 30]
    margins = model.margins(pa.array(given))
    for t, own in zip(given, margins):
        gram = list(grams(t or ""))
        want = [sum(float(w[g]) for g in gram) / max(1, len(gram)) + b for w, b in zip(model.weights, model.bias)]
        assert np.allclose(own, want, atol=1e-6)


def test_language_columns_and_stage(spark, folder, model):
    given = some_rows()
    found = result(spark, folder, "op3_language_id")
    want = Counter()
    for i, t, *_ in given:
        language, score = plain_prediction(model, t)
        want[i, i is None or zlib.crc32(str(i).encode()) % 4 == 2, language, round(score, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in found) == want
    kept = corpus_pipeline.language_id(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    good = {k for k, (_, t, *_) in enumerate(given) if (p := plain_prediction(model, t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert Counter(r.n_chars for r in kept) == Counter(good)  # n_chars is the row's number here
    assert {(r.lang_pred, r.score) for r in kept} == {("x", 9.0)}


def test_junk_labels_are_bounded(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.range(3000).selectExpr("id + 1000 as doc_id", "concat('junk text ', id) as text", "concat(if(id % 2 = 0, 'q', 'en-'), id) as lang")
    found = op3.fit(rows.unionByName(junk), most_languages=40, most_models=25)
    assert {*SPEECH} <= {*found.languages} and len(found.languages) <= 40 and len(found.weights) <= 25
    few = op3.fit(rows.unionByName(junk), most_languages=3)
    often = Counter(lang for _, t, lang, *_ in {r[1]: r for r in some_rows() if r[1] is not None and r[2]}.values())
    assert few.languages == sorted(sorted(often, key=lambda x: (-often[x], x))[:3])
    assert op3.learnable(["en", "de", "xx", "nl", "yy"], 5) == ["en", "de", "xx", "nl"]  # models: 1, 1, 1, 2


def test_trees_score_as_a_walk_node_by_node():
    r = np.random.default_rng(3)
    x = r.random((1500, 4))
    trees = op6.grow(x, ((x[:, 0] + x[:, 1] > 1) ^ (r.random(1500) < 0.1)).astype(float), [1, 0, -1, 0], trees=15)

    def walk(row):
        total = trees.prior
        for node in trees.roots.tolist():
            while trees.feature[node] >= 0:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.limit[node] else trees.right[node])
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    probe = np.concatenate([x[:200], r.normal(size=(100, 4)) * 5])
    assert np.allclose(trees.score(probe), [walk(row) for row in probe], atol=1e-12) and len({*trees.score(probe).round(6)}) > 20


def test_mix_stage_matches_a_plain_draw(spark, folder):
    given = some_rows()
    chars = Counter()
    for _, t, _, source, *_ in given:
        chars[source] += len(t or "")
    weight = {s: n**op5.POWER for s, n in chars.items() if n}
    want = Counter()
    for i, t, _, source, k, *_ in given:
        rate = op5.GROWTH * sum(chars.values()) * weight[source] / sum(weight.values()) / chars[source]
        name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{op5.MIX_SEED}|{name}".encode()).hexdigest()[:12], 16) / 16**12
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        want[k] += n
    found = corpus_pipeline.mix(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert Counter(r.n_chars for r in found.collect()) == +want and max(want.values()) > 1


def test_shard_stage_matches_a_plain_ring(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.shard(spark, docs, folder).collect()
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size, crc), F.lit(1 << 40))
    rows = sorted(docs.select(place.alias("place"), "doc_id", crc.alias("crc")).collect(), key=lambda r: (r.place, r.doc_id is not None, r.doc_id or 0, r.crc))
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in found) == Counter((r.doc_id, r.crc, s) for r, s in zip(rows, brute_ring([r.place for r in rows], 8, 256)))


def test_trees_are_flat_again_after_edits():
    count = op10.Counter(op10.VOCABULARY)
    r = random.Random(17)
    some = lambda n: "".join(r.choice("ab 's \n\t 1.é,  ") for _ in range(r.randrange(n)))
    for _ in range(1500):
        tree = op10.Tree(some(40), count)
        for _ in range(4):
            before, n = tree.text, len(tree.text)
            edits = [(a := r.randrange(n + 1), min(n, a + r.randrange(6)), some(5)) for _ in range(r.randrange(4))]
            edits = op10.difference(before, some(40)) if r.random() < 0.3 else edits
            parts = op10._PIECE.findall(tree.apply(edits))
            lengths, counts = tree.flat()
            assert lengths.tolist() == [*map(len, parts)] and counts.tolist() == count(parts) and tree.n_parts == len(parts), (before, edits)
            tree = op10.Tree(tree.text, count, (lengths, counts)) if r.random() < 0.4 else tree
        new = some(30)
        changed = tree.text
        for a, b, put in op10.difference(changed, new):
            changed = changed[:a] + put + changed[b:]
        assert changed == new


def test_a_later_run_takes_up_the_trees(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.createDataFrame([(300, " ".join(words(4000, 31)))], "doc_id long, text string")
    first = docs.select("doc_id", "text").unionByName(long)
    op10.tree_table(op10.count_tokens(first, (), keep=True)).write.parquet(str(tmp_path / "first"))
    trees = spark.read.parquet(str(tmp_path / "first"))
    changed = first.withColumn("text", F.when(F.col("doc_id") == 300, F.concat(F.substring("text", 1, 9000), F.lit(" put in "), F.expr("substring(text, 9001)"))).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    changed = changed.unionByName(spark.createDataFrame([(301, "a new one")], changed.schema)).withColumns({"lengths": F.lit(1), "counts": F.lit("x"), "_tree": F.lit(2)})
    columns = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "text_after"]
    for edits in ((), op10.CLEANING):
        plain, taken = op10.count_tokens(changed, edits), op10.count_tokens(changed, edits, trees=trees)
        assert Counter(tuple(x) for x in plain.select(columns).collect()) == Counter(tuple(x) for x in taken.select(columns).collect())
    touched = {x.doc_id: x.n_reencoded for x in op10.count_tokens(changed, (), trees=trees).collect()}
    assert 0 < touched[300] < 20 and touched[10] > 0 and touched[11] == touched[200] == 0
    op10.tree_table(op10.count_tokens(changed, trees=trees, keep=True)).write.parquet(str(tmp_path / "second"))
    second = spark.read.parquet(str(tmp_path / "second"))
    after = op10.count_tokens(changed, op10.CLEANING).select("doc_id", F.col("text_after").alias("text"))
    third = op10.count_tokens(after.filter("doc_id is not null and doc_id not in (5, 7)"), (), trees=second)
    assert {x.n_reencoded for x in third.collect()} == {0}
    full = op10.encoder(op10.VOCABULARY).encode_ordinary
    assert all(len(full(x.text_after)) == x.n_tokens_after for x in third.collect())
    assert op10.count_tokens(changed, (), trees=second.limit(0)).count() == changed.count() and op10.count_tokens(changed.limit(0), (), trees=trees).count() == 0
