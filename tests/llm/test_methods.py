"""Operators against brute force, exact round trips, other engines and held-out labels."""

import math
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mendline.llm import (
    count_rollup,
    crosspolytope,
    extendible_dedup,
    graph,
    license_rules,
    piece_dropout,
    registry,
    rule_ensemble,
    simhash_ring,
    source_mix,
    toxic_spans,
    warc_revisits,
)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables absent")
RANDOM = np.random.default_rng(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def classes(pairs, nodes):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


# --- pieces


@pytest.fixture(scope="module")
def model():
    return Path(piece_dropout.MODEL).read_bytes()


def test_pieces_without_dropout_are_those_of_the_library(model, docs):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), piece_dropout.Pieces(model, 0.0, 1)
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "  a  b ", "a\n\nb", "\t", "é漢😀", "<0x0A> </s>", "q" * 300]
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode_many(texts, [0] * len(texts))] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_matrix_agenda_is_the_agenda(model, rate):
    own = piece_dropout.Pieces(model, rate, 9)
    units = ["▁" + "".join(RANDOM.choice(list("abehinorst漢▁"), 1 + i % 30)) for i in range(400)]
    v = own.variants - 1
    assert [np.frombuffer(x, np.int32).tolist() for x in own.merge_many(units, v)] == [own.merge(u, v) for u in units]


def test_dropout_varies_is_seeded_and_loses_nothing(docs):
    a = {r.doc_id: r for r in piece_dropout.round_trip(docs).collect()}
    b = {r.doc_id: r for r in piece_dropout.round_trip(docs.repartition(3)).collect()}
    other = {r.doc_id: r for r in piece_dropout.round_trip(docs, seed=6).collect()}
    assert all(r.lossless for r in a.values()) and all(a[k].piece_ids == b[k].piece_ids for k in a)
    assert sum(a[k].piece_ids != other[k].piece_ids for k in a) > len(a) / 2
    same = piece_dropout.round_trip(docs.withColumn("text", F.lit("internationalisation of everything and more")))
    assert len({tuple(r.piece_ids) for r in same.collect()}) >= 10


# --- mix


def test_mix_meets_targets(docs):
    rows = source_mix.mix(docs, slots=1 << 12, least_block=16).collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    total, by = Counter(), defaultdict(list)
    for r in rows:
        total[r.source] += r["size"]
        by[r.source].append(r)
    names = sorted(total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set[str] = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = 2 * total[s] if s in full else level * weight[s]
        assert all(math.isclose(r.target, target, rel_tol=1e-9) and r.source_size == total[s] and r.taken <= 2 * r["size"] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 1
    again = source_mix.mix(docs.repartition(5), slots=1 << 12, least_block=16).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_schedule_is_even(spark):
    facts = [("a", 0, 6000, 6000, 60, 60), ("b", 1, 3000, 3000, 30, 30), ("c", 2, 1000, 1000, 10, 10)]
    sources = spark.createDataFrame(facts, "skey string, rank long, source_size long, take long, n_blocks long, needed long")
    plan = [r.skey for r in source_mix.schedule(sources, 100).orderBy(F.col("slot").asc_nulls_last()).collect()]
    for start in range(0, 80, 20):
        part = Counter(plan[start : start + 20])
        assert abs(part["a"] - 12) <= 2 and abs(part["b"] - 6) <= 2 and abs(part["c"] - 2) <= 2


# --- toxicity


def maximal(w):
    """All maximal segments by definition: recursively the best segment, then what is left and right of it."""
    if not len(w) or max(w) <= 0:
        return []
    best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)))
    _, _, i, j = best
    return maximal(w[:i]) + [(i, j)] + [(a + j, b + j) for a, b in maximal(w[j:])]


def test_segments_are_the_maximal_ones():
    for _ in range(150):
        w = RANDOM.integers(-6, 6, RANDOM.integers(0, 14)) + RANDOM.normal(0, 1e-3)
        assert sorted((a, b) for a, b, _ in toxic_spans.segments(w)) == sorted(maximal(w.tolist()))


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    operator = toxic_spans if kind == "toxic" else rule_ensemble
    found = operator.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(found["score"].to_numpy(), found[kind].to_numpy()) > 0.95
    assert (found["predicted"] == found[kind]).mean() > 0.96


# --- licences


def test_long_notices_are_one_licence_and_order_counts():
    known = license_rules.Recogniser()
    notice = (
        "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n"
        "# You may obtain a copy of the License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n#\n"
        "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n"
        "# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n"
        "# limitations under the License.\n"
    )
    found, unknown = known.read("Copyright 2020 Someone\n" + notice + "Released under the MIT License. The licence of the rest is odd.")
    assert known.licenses(found) == ["Apache-2.0", "MIT"] and unknown == ["the licence of the rest is odd"]
    grant, source, binary = (license_rules.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert known.licenses(known.read(f"{grant}:\n{source}.\n{binary}.")[0]) == ["BSD-2-Clause"]
    assert known.licenses(known.read(f"{source}.\n{grant}.\n{binary}.")[0]) == []
    assert known.licenses(known.read("SPDX-License-Identifier: MIT\nOther words")[0]) == ["MIT"]


# --- counts


def test_rollup_equals_a_count_of_the_end_state(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.MODEL)
    want = defaultdict(lambda: np.zeros(3, int))
    for r in docs.collect():
        text = re.sub(count_rollup.SECRET, r"\1removed", r.text)
        if len(text) >= count_rollup.BRIEF:
            for v, n in ((count_rollup.version(), len(library.encode(text))), (count_rollup.WORDS, len(text.encode().split()))):
                want[r.source, r.lang, v] += (1, n, len(text))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in registry.QUERIES["op5_count_rollup"](spark, DATA).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


def test_commits_are_idempotent_and_survive_a_lost_writer(spark, docs, tmp_path):
    counts = count_rollup.counted(docs)
    rollup = count_rollup.Rollup(spark, f"{tmp_path}/r")
    assert rollup.totals().collect() == []
    assert rollup.commit("a", count_rollup.signed(counts, 1)) and not rollup.commit("a", count_rollup.signed(counts, 1))
    once = sorted(map(tuple, rollup.totals().collect()))
    lost = Path(f"{tmp_path}/r/deltas/batch=b")
    lost.mkdir()  # a writer that ended before its success file
    assert sorted(map(tuple, rollup.totals().collect())) == once
    assert rollup.commit("b", count_rollup.signed(counts, -1)) and rollup.totals().collect() == []
    rollup.compact()
    assert rollup.totals().collect() == []
    assert rollup.commit("c", count_rollup.signed(counts, 1)) and sorted(map(tuple, rollup.totals().collect())) == once


# --- exact copies


@pytest.mark.parametrize("capacity", [1, 1000])
def test_chains_compare_bytes_when_keys_collide(spark, monkeypatch, capacity):
    monkeypatch.setattr(extendible_dedup, "_key", lambda body: (len(body) % 3 - 1) << 61)
    texts = ["".join(RANDOM.choice(list("aAbB"), RANDOM.integers(0, 5))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    got = extendible_dedup.exact_groups(df, capacity).collect()
    assert len(got) == len(texts)
    for r in got:
        g = groups[texts[r.doc_id].lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))


def test_directory_doubles_until_buckets_fit():
    counts = RANDOM.integers(0, 3, 1 << 10)
    counts[:4] = 100
    d = extendible_dedup.Directory.grow(counts, 50)
    assert len(d.slots) == 1 << d.global_depth and d.global_depth == 10
    load = Counter()
    for prefix, n in enumerate(counts):
        load[int(d.slots[prefix])] += n
    assert all(n <= 50 or d.local_depth[b] == 10 for b, n in load.items()) and sum(load.values()) == counts.sum()
    assert all((d.slots == b).sum() == 1 << (d.global_depth - d.local_depth[b]) for b in range(len(d.local_depth)))


# --- near copies


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints(docs):
    got = {r.doc_id: r.fp for r in simhash_ring.fingerprints(docs).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {r.doc_id: fingerprint(r.text) for r in docs.collect()}


@pytest.mark.parametrize("bucket_rows", [2, 16, 4096])
def test_no_link_is_lost_in_buckets_of_any_size(spark, bucket_rows):
    base = [int(x) for x in RANDOM.integers(0, 1 << 63, 12)]
    prints = set(base)
    for _ in range(600):  # chains of one to four bits around few centres, so that buckets are full
        x = sorted(prints)[RANDOM.integers(0, len(prints))]
        for _ in range(RANDOM.integers(1, 5)):
            x ^= 1 << int(RANDOM.integers(0, 64))
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash_ring.links(df, bucket_rows).collect()
    word = lambda p: p % (1 << 64)
    assert all(0 < (word(r.a) ^ word(r.b)).bit_count() <= 4 * 64 for r in found)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if (word(a) ^ word(b)).bit_count() <= 2]
    assert classes([(r.a, r.b) for r in found], signed) == classes(near, signed)
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(found)).collect()} == {
        k: v for k, v in classes(near, signed).items() if any(k in p for p in near)
    }


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star + star[:5], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(500)}}


# --- vectors


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_vector_links_are_those_of_all_pairs(spark, block_rows):
    centres = RANDOM.normal(size=(12, 24))
    near = [c / np.linalg.norm(c) + RANDOM.normal(size=24) * s for c in centres for s in RANDOM.uniform(0, 0.06, 25)]
    x = np.array([*near, *RANDOM.normal(size=(60, 24)), near[0], near[0]], np.float32)
    df = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in crosspolytope.near_duplicates(df, block_rows=block_rows).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    links = linked.sum(1)
    mine = np.array([got[100 + i].n_links for i in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    want = classes([(100 + i, 100 + j) for i, j in zip(*np.nonzero(linked))], [100 + i for i in range(len(x))])
    assert np.mean([got[k].component_id == v for k, v in want.items()]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_on_the_given_vectors(spark):
    at = "/root/testdata/check_s/embeddings.parquet"
    if not Path(at).exists():
        pytest.skip("larger tables absent")
    df = spark.read.parquet(at)
    got = crosspolytope.near_duplicates(df).toPandas().sort_values("vec_id")
    x = np.stack(df.toPandas().sort_values("vec_id")["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(x[i : i + 1000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 1000)])
    assert (got["n_links"].to_numpy() <= links).all() and got["n_links"].sum() >= 0.9 * links.sum()


# --- revisits


def test_revisits_of_one_busy_url(spark):
    start, rows, n = datetime(2024, 1, 1), [], 300
    for i in range(n):
        full = RANDOM.random() < 0.1
        ts = start + timedelta(seconds=int(RANDOM.integers(0, 200)))
        etag = [None, "a", "W/b", "b"][RANDOM.integers(0, 4)]
        last = [None, "x", "y"][RANDOM.integers(0, 3)]
        headers = {"ETag": etag or "-", "Content-Type": f"t{i}"} if full else {"etag": f"e{i}", "Content-Type": "no", "Vary": "v"}
        rows.append((i, "response" if full else "revisit", ["http://www.A.org/x/", "https://a.org/x#p", "http://b.org/x?utm_source=q"][min(i % 7, 2)], ts, etag, last, f"d{i}", headers))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts timestamp_ntz, etag string, last_modified string, digest string, headers map<string,string>")
    key = lambda u: "b.org/x" if "b.org" in u else "a.org/x"
    bare = lambda t: t.removeprefix("W/") if t else None
    got = {r.revisit_id: r for r in warc_revisits.resolve(df.repartition(5)).collect()}
    assert len(got) == sum(r[1] == "revisit" for r in rows)
    for r in rows:
        if r[1] == "revisit":
            before = [x for x in rows if x[1] == "response" and key(x[2]) == key(r[2]) and x[3] < r[3]]
            base = max(before, key=lambda x: (x[3], x[0]), default=None)
            tags, times = base and r[4] and base[4], base and r[5] and base[5]
            status = "orphan" if not base else ("resolved" if bare(r[4]) == bare(base[4]) else "changed") if tags else ("resolved" if r[5] == base[5] else "changed") if times else "unvalidated"
            assert (got[r[0]].url_key, got[r[0]].status, got[r[0]].response_id) == (key(r[2]), status, base and base[0])
            if status == "resolved":
                assert got[r[0]].headers == {"etag": f"e{r[0]}", "vary": "v", "content-type": f"t{base[0]}"} and got[r[0]].digest == base[6]


@pytest.mark.parametrize(
    "url,key",
    [("HTTP://WWW.Ex.org:80/A/?utm_source=x&b=1&ref=q#z", "ex.org/A?b=1"), ("https://m.ex.org", "ex.org"), ("ex.org/?", "ex.org"), ("  ", None), (None, None)],
)
def test_canonical_urls(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc_revisits.canonical_url(F.col("u"))).first()[0] == key


def test_counts_of_two_models_stay_apart(spark, docs, tmp_path):
    model = Path(count_rollup.MODEL).read_bytes()
    same, other = tmp_path / "same.model", tmp_path / "other.model"
    same.write_bytes(model)
    other.write_bytes(model + b"\xf2\x7e\x01x")  # a field that readers of the format pass over
    assert count_rollup.version(str(same)) == count_rollup.version() != count_rollup.version(str(other))
    some = docs.limit(20)
    both = count_rollup.counted(some).unionByName(count_rollup.counted(some, model=str(other)))
    totals = count_rollup.delta(count_rollup.signed(both, 1)).groupBy("version").agg(F.sum("n_docs").alias("n")).collect()
    assert {r.version: r.n for r in totals} == {count_rollup.version(): 20, count_rollup.version(str(other)): 20, count_rollup.WORDS: 40}


def test_cosines_of_doubles(spark):
    """Pairs a hair above and below the threshold, and components that no float holds."""
    draw = np.random.default_rng(9)
    rows, want = [], {}
    for i in range(60):
        a, b = draw.normal(size=32), draw.normal(size=32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, (a * 10.0 ** (i % 5 * 60)).tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
        want[2 * i] = want[2 * i + 1] = i % 2
    found = crosspolytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum({r.vec_id: r.n_links for r in found}[k] == n for k, n in want.items()) >= 0.95 * len(want)
    assert all(r.n_links <= want[r.vec_id] for r in found)


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "mix":
            assert len({r.doc_id for r in rows}) == len(rows)
        seen.append({r.doc_id: r.text for r in rows})
    raw, good, exact, near, mixed = seen
    wrong = [k for k, v in labels.items() if (k in good) != bool(v.quality)]
    assert len(wrong) <= 0.05 * len(labels)
    assert sorted(exact) == sorted({t.lower() if t.isascii() else t.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})): k for k, t in sorted(good.items())}.values())
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.encode().lower().split()) for k, t in exact.items())}
    pairs = [(a, b) for a in exact for b in exact if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(near) == sorted(set(classes(pairs, list(exact)).values()))
    assert set(mixed) <= set(near)
    end = corpus_pipeline.run(spark, at).collect()
    assert Counter(r.doc_id for r in end) == Counter(r.doc_id for r in docs.collect()) and all(r.lossless for r in end)


def test_lasso_is_at_its_optimum():
    x = (RANDOM.random((400, 6)) < 0.4).astype(float)
    y = (RANDOM.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1])))).astype(float)
    w, b = rule_ensemble.lasso(x, y, 0.01, 3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    pull = x.T @ (y - p) / len(y)
    assert abs((y - p).mean()) < 1e-6
    assert all(abs(g - 0.01 * np.sign(v)) < 1e-6 if v else abs(g) <= 0.01 + 1e-6 for g, v in zip(pull, w))
    assert w[0] > 0 > w[1] and np.count_nonzero(w) < 6
