"""The training-data operators against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relcheck.llm import components as stars
from relcheck.llm import op01_token_counts as op01
from relcheck.llm import op02_near_dedup as op02
from relcheck.llm import op03_nearest_neighbours as op03
from relcheck.llm import op05_best_fit_packing as op05
from relcheck.llm import op06_decontamination as op06
from relcheck.llm import op07_language_id as op07
from relcheck.llm import op08_quotation_linking as op08
from relcheck.llm import op09_sharding as op09
from relcheck.llm import op10_line_dedup as op10
from relcheck.llm.components import components
from relcheck.llm.queries import QUERIES, SQL
from relcheck.llm.shared import stored
from relcheck.llm.tokens import Encoder, tokenizer_path

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, rep long"
#: Null ids and texts, empty and blank texts, repeated rows, one long text, columns with clashing names.
ODD = [(1, None, "en", "a", 0, "x", 1), (2, "", None, None, 0, None, None), (3, " \n ", "en", "a", 3, "x", 1), (4, "one two", "en", "b", 7, "x", 1), (4, "one two", "en", "b", 7, "x", 1), (5, "one two", None, "c", 7, "x", 1), (None, "one two", "en", "c", 7, "x", 1), (6, "w " * 30_000, "en", "a", 60_000, "x", 1), (7, "Größe 三 " * 9, "de", "a", 0, "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, r = QUERIES[name](spark, DIR), duck.sql(SQL[name])
    columns = sorted(r.columns)
    assert sorted(df.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, r.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    low = {x: x for e in links for x in e}
    for _ in links:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in low.items() if any(a != b and x in (a, b) for a, b in links)}


def least(links):
    """The smallest node that each node is connected to."""
    low = {x: x for e in links for x in e}

    def root(x):
        while low[x] != x:
            low[x] = x = low[low[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in low}


def test_components_in_small_plans(spark, monkeypatch):
    """The driver keeps the plans of all rounds, so none may hold those of the steps before it; nodes of many links included."""
    rng = random.Random(24)
    links = [(i, i + 1) for i in range(2000, 2300)] + [(5000 + i, 3000) for i in range(700)] + [(1000 - i, 5000 + i) for i in range(600)] + [(rng.randint(1, 900), rng.randint(1, 900)) for _ in range(300)]
    rng.shuffle(links)
    for many, tasks in ((stars.LEAST_MANY, 2), (8, 9)):
        plans = []
        monkeypatch.setattr(stars, "LEAST_MANY", many)
        monkeypatch.setattr(stars, "stored", lambda df, name, put=stored, seen=plans: seen.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, name))
        rows = spark.createDataFrame(links, "a long, b long").repartition(tasks)
        got, fewer = ({r.node: r.component for r in components(x).collect()} for x in (rows, stars.reduced(rows)))
        assert got == fewer == {x: y for x, y in least(links).items() if any(a != b and x in (a, b) for a, b in links)}
        assert max(p.count("Exchange") for p in plans) <= 4 and max(p.count("Join") for p in plans) <= 2
    assert any("BroadcastHashJoin" in p and "xxhash64" in p for p in plans)


def test_forest(monkeypatch):
    rng = random.Random(25)
    monkeypatch.setattr(stars, "CHUNK", 50)
    for n, most in ((0, 1), (1, 1), (40, 60), (400, 100), (400, 1 << 62)):
        links = [(rng.randint(-most, most), rng.randint(-most, most)) for _ in range(n)] + [(i, i + 1) for i in range(0, n, 3)] + [(most, i) for i in range(n // 10)]
        links = [(a, b) for a, b in links if a != b]
        u, v = stars.forest(*(np.array([e[i] for e in links], dtype=np.int64) for i in (0, 1)))
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: y for x, y in least(links).items() if x != y} and len(set(u.tolist())) == len(u)
        batches = [pa.RecordBatch.from_pylist([{"u": a, "v": b} for a, b in links[i : i + 7]]) for i in range(0, len(links), 7)]
        out = [(r["u"], r["v"]) for batch in stars._forests(iter(batches)) for r in batch.to_pylist()]
        assert least(out) == least(links)


def near_rows(seed, groups=6, copies=30):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = f"v{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8, "weight": 500}, {"family": 3, "block": 16}])
def test_near_duplicates(spark, options):
    rows = near_rows(5)
    sets = {i: shingle_set(t, 3) for i, t in rows}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    got = op02.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=85, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def test_near_duplicates_odd(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op02.near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 1, 6, True), (7, got[-2][1], 7, True)], key=repr)
    assert op02.near_duplicates(empty).count() == 0


def test_near_duplicates_take_one_worker_a_task(spark, monkeypatch):
    """What a task reads goes through one Python worker: two would each keep what all operators load into them."""
    plans = []
    for module in (stars, op02):
        monkeypatch.setattr(module, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    op02.near_duplicates(spark.createDataFrame(near_rows(5), "doc_id long, text string"), shingle=3, threshold=85)
    blocks = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(blocks) == 1 and blocks[0].count("MapInArrow") == 1  # that of the pairs, beside the blocks


def test_signature_join_guarantee():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, 56).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        b[rng.choice(56, 15, replace=False)] += 1  # 2 * 8 - 1 differences
        assert set(op02.keys(a[None], 7)[0].tolist()) & set(op02.keys(b[None], 7)[0].tolist())


def test_encoder():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    own, rng = Encoder(tokenizer_path(), True), random.Random(4)
    signs = "aAbé'sstT ΣσİßﬁÉé \n\t\x0b\x0c\r\x1c\x85 ​12三<|endoftext|>.,!$\x00"
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_tokens(spark):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), True, special=True), random.Random(16)
    ids = lambda text: library.encode(text, add_special_tokens=False).ids
    assert ids("a<|endoftext|>")[-1] == 49407
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "Word", "two ", " ", "\n", "é.", "l'an", "12", "ﬁ", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids([t.encode() for t in texts])] == list(map(ids, texts))
    row = op05.pack(spark.createDataFrame([(1, "One<|endoftext|>two")], "doc_id long, text string")).first()
    want = np.array([*ids("One<|endoftext|>two"), 1], "<u4")
    assert (row.length, row.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
    # op1 closes documents with such an id, so none may come from a text.
    assert op01.document_token_counts(spark.createDataFrame([(1, "One<|endoftext|>two")], "doc_id long, text string")).count() == 1


def test_token_counts(spark, odd, empty):
    library = Encoder(tokenizer_path(), False)
    size = {(r[0], r[1]): len(library.ids([(r[1] or "").encode()])[0]) // 4 for r in ODD}
    got = op01.document_token_counts(odd).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((r[0], size[r[0], r[1]]) for r in ODD), key=repr)
    assert op01.document_token_counts(empty).count() == 0


def test_separator_scan(spark):
    rng = random.Random(6)
    stream = [rng.choice([9, 9, 1, 2, 3, 4, 5]) for _ in range(500)] + [1, 2]
    data, rows, at = np.array(stream, "<u2").tobytes(), [], 0
    while at < len(data):
        step = 2 * rng.randint(0, 9)
        rows.append((3, len(rows), bytearray(data[at : at + step])))
        at += step
    rows.append((4, 0, None))
    old, op01.GROUP = op01.GROUP, 4
    got = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in op01.token_counts(spark.createDataFrame(rows, "stream long, block long, payload binary"), 9).collect())
    op01.GROUP = old
    want, begin = [], 0
    for i, x in enumerate(stream):
        if x == 9:
            want.append((len(want), begin, i - begin, True))
            begin = i + 1
    assert got == [*want, (len(want), begin, len(stream) - begin, False)]


def test_read_flat(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 9], "<u2").tofile(tmp_path / "a.bin")
    got = op01.token_counts(op01.read_flat(spark, str(tmp_path), 4), 9).collect()
    assert sorted((r.ordinal, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 1)]


def test_read_flat_by_ranges(spark, tmp_path):
    ids = np.random.default_rng(15).integers(0, 9, 5001).astype("<u2")
    ids.tofile(tmp_path / "a b%20.bin")
    ids[:0].tofile(tmp_path / "none.bin")
    blocks = op01.read_flat(spark, str(tmp_path), 100, range_bytes=1000)
    got = blocks.withColumn("task", F.spark_partition_id()).collect()
    assert b"".join(bytes(r.payload) for r in sorted(got, key=lambda r: r.block)) == ids.tobytes() and len({r.task for r in got}) > 1
    assert sum(r.n_tokens for r in op01.token_counts(blocks, 8).collect()) == int((ids != 8).sum())
    # Longer than a row can be; a sparse file.
    with open(tmp_path / "long.bin", "wb") as file:
        file.truncate((1 << 31) + (1 << 20))
    got = op01.read_flat(spark, str(tmp_path / "long.bin"), 1 << 22).agg(F.sum(F.octet_length("payload")), F.max(F.octet_length("payload"))).first()
    assert tuple(got) == ((1 << 31) + (1 << 20), 1 << 22)
    with pytest.raises(ValueError):
        op01.read_flat(spark, str(tmp_path), 101)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[700:760] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0]), (None, [1.0] * 16)]
    got: dict[int, list] = {}
    for r in op03.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    score = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, found in got.items():
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(score[q, i], 9), i))[:20]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and all(abs(s - score[q, i]) < 1e-9 for i, s in found)
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[700]][:3] == [3, 701, 702]
    assert op03.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_returns_whole_results(spark):
    rng = np.random.default_rng(14)
    # A far vector in a cell of its own; a tight cluster of 20, and 20 vectors in cells further off.
    for centres, size in (([[1, 1, 1, 1]] * 14 + [[9, 9, 9, 9]], 14), ([[5, 5, 5, 5]] * 20 + [[5, 5, 1, 1]] * 10 + [[1, 1, 5, 5]] * 10, 20)):
        x = (np.array(centres) + rng.normal(size=(len(centres), 4)) * 0.001).astype("float32")
        rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)]
        score = x.astype(float) @ x.astype(float).T
        got: dict[int, list] = {}
        for r in op03.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id < 14").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.keys() == set(range(14))
        for q, found in got.items():
            want = sorted((i for i in range(len(x)) if i != q), key=lambda i: -score[q, i])[:size]
            assert len(found) == size and (size == 20 or set(found) == set(want))


def test_nearest_of_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(160, 8)).astype("float32")
    x[:40] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(160)] + [(20, [float(v) for v in x[0]])] * 15
    rows += [(40, [float(v) for v in 2 * x[0]]), (1000, [1.0, 2.0]), (1001, [1.0, 0.5]), (1002, [0.0, -1.0]), (1000, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, entry int, ids string")
    got: dict[int, list] = {}
    for r in op03.nearest(table, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # Each (id, vector) is one row; those of one id are candidates for each other.
    pairs = sorted({(i, tuple(v)) for i, v in rows if v is not None and len(v) == 8})
    for q in (0, 20, 40, 60):
        for vector in {v for i, v in pairs if i == q}:
            score = {(i, v): float(np.dot(np.array(v, float), np.array(vector, float))) for i, v in pairs if (i, v) != (q, vector)}
            want = sorted(((-round(s, 9), i) for (i, _), s in score.items()))[:20]
            assert set(i for _, i in want) <= set(i for i, _ in got[q]), q
    assert [len(got[q]) for q in (0, 20, 60)] == [20, 20, 20] and got[20][0][0] == 40 and len(got[40]) == 40
    assert [i for i, _ in got[1000]] == [1001, 1002] and 1001 not in got
    assert op03.nearest(table, "vec_id < 0").count() == 0


def test_traverse():
    rng = np.random.default_rng(3)
    a, b, count = rng.random(7), rng.random(7), rng.integers(0, 4, 49)
    order = [c for c in np.argsort((a[:, None] + b).ravel()).tolist() if count[c]]
    found = op03.traverse(a, b, count, 40)
    assert found == order[: len(found)] and count[found].sum() >= 40 > count[found[:-1]].sum()


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(100):
        capacity = rng.choice([10, 37, 100])
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        rows, bins = op05.plan(sizes, capacity).tolist(), {}
        for size, n in sizes.items():
            own = sorted((r for r in rows if r[0] == size), key=lambda r: r[1])
            for k in range(n):
                _, first, each, b, offset = [r for r in own if r[1] <= k][-1]
                bins.setdefault(b + (k - first) // each, []).append((offset + (k - first) % each * size, size))
        for found in bins.values():
            assert [o for o, _ in sorted(found)] == list(np.cumsum([0] + [s for _, s in sorted(found)])[:-1]) and sum(s for _, s in found) <= capacity
        room: list[int] = []
        for size in sorted(sizes.elements(), reverse=True):
            fits = [r for r in room if r >= size]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else capacity) - size)
        assert len(bins) == len(room)


def test_pack(spark, odd, empty):
    library = Encoder(tokenizer_path(), False)
    got, sequences = {}, {}
    for r in op05.pack(odd).collect():
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text, *_ in ODD:
        ids = np.frombuffer(library.ids([(text or "").encode()])[0] + b"\1\0\0\0", "<u4")
        for p in range(-(-len(ids) // 4096)):
            part = ids[4096 * p : 4096 * p + 4096]
            assert set(got[doc_id, p]) == {(4096 * p, len(part), zlib.crc32(part.tobytes()))}
    for found in sequences.values():
        assert [o for o, _ in sorted(found)] == list(np.cumsum([0] + [n for _, n in sorted(found)])[:-1]) and sum(n for _, n in found) <= 4096
    assert op05.pack(empty).count() == 0


def test_contained(spark, odd, empty):
    rng = random.Random(10)
    items = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.choice([2, 8, 30, 200])))) for i in range(40)] + [(99, None), (None, "one two"), (98, "")]
    docs = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(300)) + " " + " ".join(w if rng.random() > 0.03 else "x" for w in (items[i % 40][1]).split())) for i in range(80)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i, len(shingle_set(t, 5) & shingle_set(u, 5)), len(shingle_set(u, 5))) for d, t in docs for i, u in items if i is not None and shingle_set(u, 5) and 100 * len(shingle_set(t, 5) & shingle_set(u, 5)) >= 80 * len(shingle_set(u, 5)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (op06.BLOCK, 100):
        assert sorted(map(tuple, op06.contained_items(table, frame, block=block).collect())) == want and len(want) > 20
    assert {r.doc_id for r in op06.decontaminated(table, frame).collect()} == {d for d, _ in docs} - {d for d, *_ in want}
    assert sorted(repr(tuple(r)) for r in op06.contained_items(odd, frame).collect()) == sorted(repr((d, None, 1, 1)) for d in (4, 4, 5, None))
    assert op06.contained_items(empty, frame).count() == op06.contained_items(odd, frame.limit(0)).count() == 0


def test_languages(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op07.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    model = op07.learn(docs)
    half = {r.lang: r.text for r in docs.filter("n_chars > 900 and n_chars < 2000").collect()}
    mixed = spark.createDataFrame([(1, half["en"] + "\n" + half["de"])], "doc_id long, text string")
    mixture = op07.languages(mixed, model).first().mixture
    assert {k for k, v in mixture.items() if v > 0.2} == {"en", "de"} and abs(sum(mixture.values()) - 1) < 0.01
    found = {r.doc_id: r for r in op07.predicted_languages(odd).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3)) and found[7].lang_pred in ("de", "en")
    assert op07.predicted_languages(empty).count() == 0


def test_mixtures_against_plain_em():
    """The same by loops over words: rounds of EM, and languages admitted by penalised likelihood."""
    import math

    rng, names = random.Random(21), ["a", "b", "c", "d"]
    word = lambda i: "".join(rng.choice("efgh" + "pqrs"[i]) for _ in range(rng.randint(2, 6)))
    model = op07.Model({x: np.bincount(op07.trigrams([" ".join(word(i) for _ in range(400)).encode()])[0], minlength=op07.BUCKETS) for i, x in enumerate(names)})
    texts = [" ".join(word(rng.choice(some)) for _ in range(rng.randint(1, 120))) for some in ([0], [1], [0, 2], [0, 0, 3], [1, 2, 3], [0, 1, 2, 3]) for _ in range(6)]

    def em(likely, share, rounds):
        for _ in range(rounds):
            total = [0.0] * 4
            for w in likely:
                s = sum(p * x for p, x in zip(share, w, strict=True))
                total = [t + p * x / s for t, p, x in zip(total, share, w, strict=True)]
            share = [t / len(likely) for t in total]
        return share, sum(math.log(sum(p * x for p, x in zip(share, w, strict=True))) for w in likely)

    found, _ = model.mixtures([t.encode() for t in texts])
    several = 0
    for text, got in zip(texts, found, strict=True):
        bucket, first, _ = op07.trigrams([text.encode()])
        logs = [sum(model.logs[b] for b in bucket[i:j]) for i, j in zip(first, [*first[1:], len(bucket)], strict=True)]
        log = [[max(float(x - w.max()), -60.0) for x in w] for w in logs]
        likely, single = [[math.exp(x) for x in w] for w in log], [sum(w[i] for w in log) for i in range(4)]
        best = max(range(4), key=lambda i: single[i])
        share, value = [float(i == best) for i in range(4)], single[best]
        full, top = em(likely, [0.25] * 4, op07.ROUNDS)
        price = op07.PENALTY / 2 * math.log(len(likely) + 1)
        order = sorted(range(4), key=lambda i: -full[i])
        for size in range(2, 5):
            if top - value <= price and size == 2:
                break
            tried, gained = em(likely, [1 / size if i in order[:size] else 0.0 for i in range(4)], op07.SET_ROUNDS)
            if gained - value <= price:
                break
            share, value = tried, gained
        several += max(share) < 1
        assert np.abs(got - share).max() < 1e-3
    assert several > 5


def test_too_many_languages(spark):
    rows = spark.range(600).selectExpr("id doc_id", "'a text' text", "concat('l', id) lang")
    with pytest.raises(ValueError):
        op07.learn(rows)


def test_more_than_four_languages():
    rng, names = random.Random(13), [f"l{i}" for i in range(7)]
    # Each language has letters of its own.
    word = lambda i: "".join(chr(0x4E00 + 40 * i + rng.randrange(20)) for _ in range(6))
    model = op07.Model({x: np.bincount(op07.trigrams([" ".join(word(i) for _ in range(3000)).encode()])[0], minlength=op07.BUCKETS) for i, x in enumerate(names)})
    share = [0.45, 0.15, 0.1, 0.1, 0.1, 0.1, 0.0]
    text = " ".join(word(i) for i, p in enumerate(share) for _ in range(round(400 * p)))
    found, _ = model.mixtures([text.encode(), word(3).encode()])
    assert np.abs(found[0] - share).max() < 0.02
    assert found[1].tolist() == [0, 0, 0, 1, 0, 0, 0]


def test_quotation(spark):
    rows = [(1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "Fine thanks.\nAnd you"), (1, 2, "user", "> hello there\n>  how are you?\n\nanswer to the first"), (1, 3, "user", ">> Hello there\n> Answer to the first\nmore"), (1, 4, "user", "unrelated"), (2, 0, "user", "> Fine thanks.\nx"), (2, 0, "user", "> Fine thanks.\nx"), (None, 1, "user", "> hello there"), (1, None, "user", "> hello there\nz"), (3, 0, None, None)]
    got = op08.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.body, r.parent_turn, r.depth) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [(None, "z", None, 0), (0, rows[0][3], None, 0), (2, "answer to the first", 0, 1), (3, "more", 2, 2), (1, rows[1][3], None, 0), (4, "unrelated", None, 0)]
    assert sorted((r.position, r.body) for r in got if r.conv_id == 2) == [(0, "x"), (1, "x")] and len(got) == len(rows)
    links = op08.passage_links(spark.createDataFrame(rows[:7], "conv_id long, turn long, role string, text string").select("conv_id", "turn", "text")).collect()
    assert {(r.conv_id, r.turn, r.level, r.from_conv, r.from_turn) for r in links} == {(1, 2, 1, 1, 0), (1, 3, 2, 1, 0), (1, 3, 1, 1, 2), (2, 0, 1, 1, 1)}
    chain = [(7, i, "u", f"line {i}\n" + (f"> line {i - 1}" if i else "")) for i in range(40)]
    got = op08.reply_ordered(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.depth, r.position) for r in got} == {(i, i, i) for i in range(40)}


def test_quoted_passages_as_a_whole(spark):
    a, b = "the first of the two lines", "and the second of them"
    long = [f"w{i}" for i in range(30)]
    text, other = " ".join(long), " ".join(reversed(long))
    wrapped = lambda words, n: "\n".join("> " + " ".join(words[i : i + n]) for i in range(0, len(words), n))
    rows = [
        # A whole paragraph in turn 5; its lines first in turns 1 and 2.
        *((1, t, x) for t, x in enumerate(["hi", f"{a}\nmore", f"{b}\nless", "no", "none", f"intro\n\n{a}\n{b}\n\nend", f"> {a}\n> {b}\nyes"])),
        # Wrapped at another width: a paragraph, a part of one, two of them with a third left out.
        *((2, t, x) for t, x in enumerate([f"{text}\n\nbetween\n\n{other}", wrapped(long, 7) + "\nanswer", wrapped(long[3:17], 4) + "\nanswer", wrapped(long, 4) + "\n>\n> [...]\n>\n" + wrapped(long[::-1], 4) + "\nanswer"])),
        # Short lines in a row within a longer paragraph, and a short line that is no chance find.
        *((3, t, x) for t, x in enumerate(["a b\nx", "c d\ny yes sir", "q\na b\nc d\nr", "yes", "> a b\n> c d\nso", "> yes\nso"])),
        # From another conversation; a repeated message; all between two quotes.
        *((4, t, x) for t, x in enumerate(["start", wrapped(long, 5) + "\nanswer"])),
        *((5, t, x) for t, x in [(0, f"> p1\n{a}\n\n{b}\n> p2"), (1, f">{a} {b}\nz"), (1, f">{a} {b}\nz")]),
    ]
    links = op08.passage_links(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    got = {(r.conv_id, r.turn, r.passage): (r.from_conv, r.from_turn) for r in links}
    assert {(c, t): x for (c, t, _), x in got.items()} == {(1, 6): (1, 5), (2, 1): (2, 0), (2, 2): (2, 0), (2, 3): (2, 0), (3, 4): (3, 2), (3, 5): (3, 3), (4, 1): (2, 0), (5, 1): (5, 0)}
    assert len(links) == len(got) == 8


def runs_needed(sides, capacity):
    n = 0
    for sizes in sides:
        full = capacity
        for s in sizes:
            n, full = (n + 1, s) if full + s > capacity else (n, full + s)
    return n


def test_smallest_capacity():
    rng = random.Random(11)
    for _ in range(200):
        sides, shards = [[rng.randint(1, 30) for _ in range(rng.randint(0, 15))] for _ in range(rng.randint(1, 4))], rng.randint(1, 7)
        got = op09.smallest_capacity(sides, shards)
        if sum(map(bool, sides)) > shards:
            assert got is None
            continue
        largest = max([0, *(x for s in sides for x in s)])
        assert got[0] == next(c for c in range(largest, sum(map(sum, sides)) + 1) if runs_needed(sides, c) <= shards)
        cut = [s[i:j] for s, c in zip(sides, got[1], strict=True) if s for i, j in zip([0, *c], [*c, len(s)], strict=True)]
        assert len(cut) <= shards and all(cut) and all(sum(c) <= got[0] for c in cut)


def test_shards(spark, odd, empty):
    rng = random.Random(12)
    rows = [(i, "t" * rng.randint(0, 500) + str(i)) for i in range(900)] + [(2000 + i, "hot" * 400) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = docs.groupBy(F.xxhash64("text", F.col("text").isNull()).alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    order = [(r.h, r.bytes) for r in groups.orderBy("h").collect()]
    exact = op09.smallest_capacity([[b for _, b in order]], 16)[0]
    assert op09.cuts(groups, 16)[1] == exact
    # The heavy group stays in its place, and both sides of it are cut as evenly as they can be.
    heavy = max(order, key=lambda x: x[1])[0]
    sides = [[b for h, b in order if h < heavy], [b for h, b in order if h > heavy]]
    assert op09.cuts(groups, 16, (heavy,))[1] == op09.smallest_capacity(sides, 15)[0]
    placed = op09.minimax_shards(docs).join(docs.select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("h")), "doc_id")
    spans = placed.groupBy("shard").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("n"), F.countDistinct("h").alias("k")).orderBy("a").collect()
    assert [r.shard for r in spans] == list(range(16)) and all(x.b < y.a for x, y in zip(spans, spans[1:], strict=False))
    assert [r.k for r in spans if r.a == heavy] == [1]
    for side, runs in zip(sides, ([r.n for r in spans if r.b < heavy], [r.n for r in spans if r.a > heavy]), strict=True):
        assert max(runs) == op09.smallest_capacity([side], len(runs))[0] and min(runs) > 0.8 * max(runs)
    for table in (docs, odd):
        got = op09.minimax_shards(table).collect()
        by: dict[int, list] = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        assert all(sorted(r.slot for r in found) == list(range(len(found))) for found in by.values()) and len(got) == table.count()
        texts = {(r[0], r[1]): r for r in table.select("doc_id", "text").collect()}
        of = {d: r.shard for d, r in ((r.doc_id, r) for r in got)}
        assert len({of[d] for d, t in texts if t in ("hot" * 400, "one two")}) == 1
    sizes = [sum(r.size for r in found) for found in by.values()]
    assert sum(sizes) == sum(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    assert op09.minimax_shards(empty).count() == 0


def test_spread_lines(spark, odd, empty):
    rows = [(i, f"own {i}\n common line \n\nlast {i % 3}", "en", f"s{i % 12}") for i in range(60)] + [(None, "common line", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for sent in (op10.SENT, 0):
        got = {r.doc_id: r for r in op10.remove_spread_lines(docs, min_sites=10, sent=sent).collect()}
        assert got[0].text == rows[0][1] and got[5].text == "own 5\n\nlast 2" and (got[5].n_lines, got[5].n_removed) == (4, 1)
        assert got[None].text == "" and op10.remove_spread_lines(docs, min_sites=13, sent=sent).agg(F.sum("n_removed")).first()[0] == 0
        assert sorted(((r.doc_id, r.text) for r in op10.remove_spread_lines(odd, sent=sent).collect()), key=repr) == sorted(((r[0], r[1]) for r in ODD), key=repr)
        assert op10.remove_spread_lines(empty, sent=sent).count() == 0


def test_spread_lines_of_documents_without_id(spark):
    rows = [(None, f"common line\nown {i % 3}", "en", f"s{i}") for i in range(20)] + [(1, "common line\nx", "en", "s0"), (2, None, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for sent in (op10.SENT, 0):
        got = sorted(repr((r.doc_id, r.text)) for r in op10.remove_spread_lines(docs, sent=sent).collect())
        assert got == sorted(repr((d, t and t.replace("common line\n", "") if d is None else t)) for d, t, *_ in rows)


def test_signature_distance():
    width, errors = 56, op02.most_errors(0.85, 56, 1e-4)
    rng = np.random.default_rng(22)
    assert (rng.binomial(width, 0.15, 1_000_000) > errors).mean() < 2e-4 and 12 < errors < 24
    shared = set(range(1000))
    a, b = (np.sort(np.array([hash(("s", x)) for x in some], dtype=np.int64).view(np.uint64)) for some in (shared, shared - set(range(81)) | set(range(2000, 2081))))
    assert (op02.signature(a, width) != op02.signature(b, width)).sum() <= errors


def test_hot_key_is_led_before_the_shuffle(spark):
    """Very many classes on one key: what is dealt out by the key are a few rows from each chunk."""
    rng = np.random.default_rng(23)
    sig = rng.integers(0, 1 << 16, 14).astype(np.uint16)
    rows = [(i, bytes(np.concatenate((sig[:7], rng.integers(0, 1 << 16, 7).astype(np.uint16))).tobytes())) for i in range(500)]
    keyed = spark.createDataFrame(rows, "rep long, sig binary").select("rep", "sig").repartition(2).mapInArrow(op02._keyed(14, 7), "deal long, key long, rep long, lead long, many boolean")
    hot = keyed.groupBy("deal").count().agg(F.max("count")).first()[0]
    assert hot <= 14
    found = keyed.repartition("deal").sortWithinPartitions("key", "rep").mapInArrow(op02._runs, "kind byte, a long, b long, key long")
    assert {r.component for r in components(found.filter("kind = 1").select("a", "b")).collect()} == {0}


def brute_components(sets, linked):
    low = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])]
    for _ in pairs:
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    return low


def test_pipeline_stages_against_brute_force(spark):
    rng = random.Random(24)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words_ = list(base) if i % 3 else [f"u{rng.randint(0, 200)}" for _ in range(60)]
        for _ in range(rng.randint(0, 4)):
            words_[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(words_) + ("\nfoot of all pages" if i % 2 else "") + f"\nlast {i}", "en", f"s{i % 15}", 1))
    rows += [rows[7], rows[7], (9, "another text of document nine that is its own", "en", "s9", 1), (None, rows[3][1], "en", "s1", 1), (70, None, "en", "s1", None), (71, "", None, None, 0), (71, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    got = sorted(repr(tuple(r)) for r in corpus_pipeline.line_dedup(spark, docs, "").collect())
    sites, first = {}, {}
    for d, t, _, s, _ in rows:
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).update({s} - {None})
            if d is not None:
                first[line] = min(first.get(line, d), d)
    want = []
    for d, t, lang, s, n in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip(" \t\r") or len(sites[x.strip(" \t\r")]) < 10 or (d is not None and first.get(x.strip(" \t\r")) == d)]
        text = t if t is None or len(kept) == len(lines) else "\n".join(kept)
        if len(kept) == len(lines) or text.strip():
            want.append(repr((d, text, lang, s, None if text is None else len(text))))
    assert got == sorted(want) and any("foot of all pages" not in w and "last 3" in w for w in want)

    got = sorted(repr((r.doc_id, r.text)) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingle_set(t, 5))
    low = brute_components(sets, lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in a for y in b))
    want = {(d, t) for d, t, *_ in rows if d is not None and low[d] == d}
    assert got == sorted([repr(x) for x in want] + [repr((None, rows[3][1]))]) and len(want) < 55

    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    library = Encoder(tokenizer_path(), False)
    lengths = Counter((d, len(library.ids([(t or "").encode()])[0]) // 4 + 1) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.length) for r in pieces) == lengths


def test_pipeline(spark, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DIR)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        if name == "decontamination":
            kept = [shingle_set(r.text, 5) for r in docs.collect()]
            gone = [shingle_set(r.text, 5) for r in before.join(docs, "doc_id", "left_anti").collect()]
            held = lambda s: any(100 * len(s & shingle_set(t, 5)) >= 80 * len(shingle_set(t, 5)) for t in items)
            assert not any(map(held, kept)) and all(map(held, gone))
        if name == "language_id":
            assert docs.count() > 0.98 * before.count()
    for table in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table.select("doc_id", "text", "lang", "source", "n_chars"), DIR).collect()
