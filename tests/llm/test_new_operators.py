"""Merkle manifests, vector codes and MinHash groups against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citygeo.llm import op01_substring as op1
from citygeo.llm import op04_pii as op4
from citygeo.llm import op06_quality as op6
from citygeo.llm import op07_sharding as op7
from citygeo.llm import op08_decontaminate as op8
from citygeo.llm import op11_merkle as op11
from citygeo.llm import op12_codes as op12
from citygeo.llm import op13_minhash as op13
from citygeo.llm.common import ranked
from citygeo.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import GAP, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, grp string, rank int, leaf string, node string, n int"


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 1, "g", 2, "l", "x", 3)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r[0], r[3], r[2], r[4], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Levels of a tree over a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def manifest(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root, verified of each row, by the contract."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, Counter()
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = climb([leaf(r, r[1]) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in order]) if order else []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            altered = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded, siblings = leaf(r, r[1].replace("\n", "")) if altered else leaf(r, r[1]), []
            for levels, at in ((trees[s], i), (top, g)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    folded, at = sha(*run[: at % 3], folded, *run[at % 3 + 1 :]), at // 3
            root = top[-1][0]
            out[r[0], leaf(r, r[1]), trees[s][-1][0], root, sha(*siblings), folded, folded == root] += 1
    return out


def merkle_rows():
    r = random.Random(4)
    rows = [row(k, "\n".join(f"line {r.random()}" for _ in range(r.randrange(4))), r.choice(["a", "a", "b", "é", "Z", ""])) for k in range(180)]
    rows += [row(200 + k, f"alone {k}\n", f"own {k}") for k in range(12)] + [row(300 + k, "no source\nat all", None) for k in range(5)]
    rows += [row(400, "x\ny", "a"), row(400, "x\ny", "a"), row(400, "other", "a"), row(None, "no\nid", "a"), row(None, None, "b"), row(401, None, "a", None), row(402, "", "a")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("merkle"))
    spark.createDataFrame(merkle_rows(), SCHEMA).repartition(5).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_matches_brute_force(spark, folder, monkeypatch, levels):
    make = op11.merkle_manifest
    monkeypatch.setattr(op11, "merkle_manifest", lambda docs, **kw: make(docs, levels=levels, **kw))
    got = Counter(tuple(r) for r in op11.op11_merkle_manifest(spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == manifest(merkle_rows())


def test_manifest_of_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op11.merkle_manifest(none).count() == 0
    one = op11.merkle_manifest(spark.createDataFrame([row(1, "only")], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == leaf(row(1, "only"), "only") and one.path == []
    long = row(1, "word " * 400_000)
    assert op11.merkle_manifest(spark.createDataFrame([long], SCHEMA)).first().root == leaf(long, long[1])


def test_equal_rows_and_one_group_are_spread(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("g").alias("grp"), F.when(F.col("id") < n // 2, 7).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked(rows, ["k", "v"])
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        ranks = sorted(r.rank for r in found.select("rank").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks == list(range(n)) and len(tasks) == 4 and max(tasks) < n / 2
    assert found.agg(F.min("n"), F.max("n")).first() == (n, n) and found.filter("k = 7").agg(F.max("rank")).first()[0] == n // 2 - 1


def test_shards_of_equal_rows(spark):
    docs = spark.range(5000).select(F.when(F.col("id") < 3000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit(1).alias("grp"), F.lit(2).alias("spot"))
    found = op7.shard_bounded(docs).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == 5000 and set(counts.values()) == {625}
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(625)) for s in counts)


# --- vector codes


def plain_codes(vectors):
    """(vec_id, label, code, error) of (vec_id, vector, label) rows, and the codebooks, by the contract."""
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4 if kept else 0
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((away(part(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(4):
        held = [[near(v, p)[1] for _, v, _ in kept] for p in range(4)]
        for p in range(4):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), h in zip(kept, held[p]) if h == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = Counter()
    for i, v, l in kept:
        best = [near(v, p) for p in range(4)]
        out[i, l, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)] += 1
    return out, books


def vector_rows():
    r = random.Random(9)
    rows = [(k, [r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1)]) for _ in range(8)], r.choice([0, 1, None])) for k in range(330)]
    bad = [None, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] + [0.0] * 7]
    rows += [(k, v, 0) for k, v in enumerate(bad)] + [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[6][1], 2), (None, [0.0] * 8, 2), (900, [-0.0001] * 8, 3)]
    return rows


def test_codes_match_brute_force(spark):
    vectors = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "error": F.lit(2), "id": F.lit(3), "v": F.lit(4)}).repartition(3)
    found, books = op12.compress(vectors)
    want, plain = plain_codes(vector_rows())
    assert books.tolist() == plain
    rows = found.collect()
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in rows) == want
    total = Counter()
    for r in rows:
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in rows)


def test_search_sees_all_ties_and_stops_early():
    r = np.random.default_rng(3)
    for width in (1, 3, 16):
        values, book = r.integers(-30, 30, (400, width)), r.integers(-30, 30, (60, width))
        book[17] = book[3]
        away = ((values[:, None] - book[None]) ** 2).sum(axis=2)
        place, least = op12.search(values, book)
        assert (place == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    make = lambda rows: op12.compress(spark.createDataFrame(rows, schema))
    found, books = make([])
    assert found.count() == 0 and books.size == 0 and op12.books_digest(books) == hashlib.sha256(b"").hexdigest()
    assert make([(1, None, 0), (2, [float("nan")], 0)])[0].count() == 0
    found, books = make([(1, [], 0), (2, [], 1)])
    assert [(r.code, r.error) for r in found.collect()] == [("00000000", 0)] * 2
    found, books = make([(1, [1.0, 2.0, 3.0], 0), (2, [1.0], 0)])  # padded with zeros to four
    assert {(r.vec_id, r.code, r.label_error) for r in found.collect()} == {(1, "00000000", 0), (2, "00010100", 0)} and books.shape == (4, 2, 1)
    with pytest.raises(Exception, match="scale the vectors"):
        make([(1, [1e30] * 8, 0)])


# --- MinHash


def plain_groups(rows, shingle=4, percent=80):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, text in rows:
        w = GAP.findall((text or "").translate(low))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), g in zip(rows, label):
        least[g] = min([x for x in (least.get(g), doc_id) if x is not None], default=None)
    return Counter((d, len(s), least[g], d == least[g]) for (d, _), s, g in zip(rows, sets, label))


def near_rows(n=420):
    r, rows, base = random.Random(21), [], [words(120, 900 + k) for k in range(12)]
    for k in range(n):
        w = list(r.choice(base)) if k % 4 else words(r.choice([2, 4, 30, 200]), 3000 + k)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (None, rows[3][1]), (3, rows[3][1]), (None, "just this one here now"), (None, "just this one here now")]
    return rows + [(2000 + k, " ".join(base[0][:100] + [f"chain{i}" for i in range(k, k + 20)])) for k in range(12)]


@pytest.mark.parametrize("tile", [1024, 5])
def test_groups_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op13, "TILE", tile)
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, id long, key long, node long, root long").repartition(4)
    got = Counter(tuple(r) for r in op13.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == plain_groups(rows)
    for most in (0,):
        monkeypatch.setattr(op13, "MOST", most)
        assert Counter(tuple(r) for r in op13.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()) == got


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert op13.near_components(spark.createDataFrame([], schema)).count() == 0
    assert {tuple(r) for r in op13.near_components(spark.createDataFrame([(5, None), (4, "")], schema)).collect()} == {(5, 0, 5, True), (4, 0, 4, True)}
    long = " ".join(words(400_000, 77, 10**6))
    rows = [(1, long), (2, long + " and a few words more"), (3, long[: len(long) // 2])]
    found = {r.doc_id: r.component_id for r in op13.near_components(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_estimates_follow_similarity():
    r = np.random.default_rng(8)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 2000
            both = int(2 * n * share / (1 + share))
            x = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            sets = [np.sort(x[:n]), np.sort(x[n - both :])]
            least = op13.minima(np.concatenate(sets), np.array([0, n, 2 * n]))
            sig = op13.packed(least)
            errors.append(op13.estimated(op13.agreeing(sig[0], sig[1])) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
        agree = op13.agreement(0.55)
        assert op13.estimated(agree) >= 0.55 > op13.estimated(agree - 1)


def test_equal_rows_are_looked_at_twice_and_returned_as_given(spark):
    w = words(60, 31)
    rows = [(1, " ".join(w))] * 700 + [(None, "short text")] * 300 + [(2, " ".join(words(50, 32) + w[10:50])), (3, " ".join(words(80, 33))), (1, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    once = op1.told_once(docs, "doc_id", "text").collect()
    assert len(once) == 2 + 2 + 3 and sum(r.times for r in once) == len(rows)
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in op1.remove_repeats(docs, shards=3).collect())
    assert found == {(1, 60, 60): 700, (None, 2, 0): 300, (2, 90, 40): 1, (3, 80, 0): 1, (1, 1, 0): 1}


# --- the registered queries against their SQL, and what was mended in others


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes"])
def test_query_equals_its_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    own = QUERIES[name](spark, data)
    columns = sorted(own.columns)
    there = con.sql(ORACLES[name])
    assert columns == sorted(there.columns)
    at = [there.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in own.collect()) == sorted(tuple(r[i] for i in at) for r in there.fetchall())


def test_seeds_that_many_items_share_are_no_pairs_in_python():
    import time

    import pyarrow as pa

    items = [" ".join(["the big red dog"] + [f"w{k}x{j}" for j in range(20)]) for k in range(20_000)]
    docs = [" ".join(["the big red dog"] + [f"d{k}x{j}" for j in range(100)]) for k in range(39)] + [items[77] + " and more"]
    hashes, doc = op8.plain_words(pa.array(items))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(docs), pa.array(range(40))], ["doc_id", "_text", "_key"])
    began = time.time()
    found = [r for b in op8._tile_rows(list(range(len(items))), hashes, doc, 4, 0.5, "doc_id")(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in found] == [(39, 77, 1.0)] and time.time() - began < 20
    again = [r for b in op8._tile_rows([1, 2], *op8.plain_words(pa.array([items[77]] * 2)), 4, 0.5, "doc_id")(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"]) for r in again] == [(39, 1), (39, 2)]  # equal items each count


def test_dots_at_any_distance_belong_to_an_address():
    for blanks in (1, 16, 17, 400):
        text = "write to john" + " " * blanks + "dot doe at example dot com"
        assert op4.find(text)[1]["email"] == [(9, len(text))]
    assert op4.find("call one two three four five six seven, eight nine zero now")[0]["phone"] == []


def test_tape_maps_signs_back_as_lists_do():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abc ") for _ in range(r.randrange(1, 30)))
        tape, start, end, new = op4.Tape(text), list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)
        for _ in range(3):
            cuts = sorted(r.sample(range(len(tape.text) + 1), min(len(tape.text) + 1, 2 * r.randrange(4))))
            edits = [(a, b, "x" * r.randrange(3)) for a, b in zip(cuts[::2], cuts[1::2])]
            out = [[], [], [], []]
            at = 0
            for a, b, put in edits:
                if not put:
                    for i in (a - 1, b):
                        if 0 <= i < len(new):
                            new[i] = True
            for a, b, put in [*edits, (len(new), len(new), "")]:
                for o, own in zip(out, (tape.text, start, end, new)):
                    o += own[at:a]
                out[0] += put
                out[1] += [start[a] for _ in put]
                out[2] += [end[b - 1] for _ in put]
                out[3] += [True for _ in put]
                at = b
            tape.rewrite(edits)
            start, end, new = out[1:]
            assert (tape.text, tape.start.tolist(), tape.end.tolist(), tape.new.tolist()) == ("".join(out[0]), start, end, new)


def test_letters_of_all_scripts_count():
    at = op6.COUNTS.index("n_letters")
    assert op6.statistics_of("한국어 中文 ｆｕｌｌ")[at] == 9 and op6.statistics_of("\U0001d400 \U00020000 \U0001f600")[at] == 2


def test_repeated_ids_do_not_lift_the_bound(spark, monkeypatch):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(2, "another")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(op6, "grow", lambda x, y, c: seen.append(len(y)))
    op6.fit_quality(docs, labels, bound=10)
    assert seen == [2]
