"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mendline.llm import (
    count_rollup,
    crosspolytope,
    extendible_dedup,
    license_rules,
    piece_dropout,
    rule_ensemble,
    simhash_ring,
    source_mix,
    toxic_spans,
    warc_revisits,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, fp string, row string, key string, y string, words string, gone string, h string, gone_id string, gone_h string, stats string, text_ string, mix_id string, mix_slot string, mix_size string, mix_words string, slot string, stays string"
CLASH = tuple("abcdefghijklmnopqrst")
LABELS = "doc_id long, quality int, toxic int, y string, text string"


def messy():
    texts = [
        "One two three four five.", "one two three four five.", "", None, " \t\n", "x" * 200_000, "word " * 50_000,
        "Licensed under CC BY-NC 4.0.", "idiot idiot scum", "naïve ▁ 漢字 😀 \u0000", "One two three four five.",
    ]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b", ""][i % 4], 3, *CLASH) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "one two three four five.", None, None, None, *[None] * 20), (None, None, None, None, None, *[None] * 20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i == 8), "z", "t") for i in range(11)]
    return spark.createDataFrame([*rows, rows[1], (None, 1, 1, None, None), (3, None, None, None, None), (99, 1, 0, None, None)], LABELS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)


def test_piece_dropout(docs, none):
    got = piece_dropout.round_trip(docs).collect()
    assert len(got) == len(messy()) and all(r.lossless for r in got)
    twice = piece_dropout.decode(piece_dropout.encode(docs)).select("text", "decoded", "piece_ids").collect()
    assert all((r.text or "") == r.decoded for r in twice)
    assert all((len(r.piece_ids) == 0) == (not r.text) for r in twice)
    assert piece_dropout.round_trip(none[0]).collect() == []


def test_source_mix(docs, none):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(messy())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert all(r["size"] == 0 for r in got if r.doc_id in (2, 3, 4))
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 4
    assert source_mix.mix(none[0]).collect() == []
    assert set(source_mix.mixed(docs).columns) == set(docs.columns)
    assert source_mix.mixed(none[0]).collect() == []


def test_toxic_spans(docs, labels, none):
    got = toxic_spans.classify(docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 for r in got)
    assert len(toxic_spans.classify(docs, none[1]).collect()) == len(messy())
    assert toxic_spans.classify(none[0], labels).collect() == []
    model = toxic_spans.fit(docs, labels)
    for p in toxic_spans.passages(docs, model).collect():
        text = next(m[1] for m in messy() if m[0] == p.doc_id)
        assert text[p.start : p.end] == p.passage


def test_license_rules(docs, none):
    got = license_rules.scan(docs).collect()
    assert len(got) == len(messy())
    assert [r.licenses for r in got if r.doc_id == 7] == [["CC-BY-NC-4.0"]]
    assert all(r.licenses == r.sentence_ids == r.unknown == [] for r in got if r.doc_id != 7)
    assert license_rules.scan(none[0]).collect() == []


def test_count_rollup(docs, none, rows):
    got = count_rollup.delta(count_rollup.signed(count_rollup.counted(docs), 1))
    words = got.filter(F.col("version") == count_rollup.WORDS)
    assert words.agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (len(messy()), sum(len((m[1] or "").encode().split()) for m in messy()))
    assert count_rollup.maintained(none[0]).collect() == []


def test_exact(docs, none):
    got = extendible_dedup.exact_groups(docs, capacity=1).collect()
    assert len(got) == len(messy())
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    assert {r.keep_id for r in got if r.doc_id in (0, 1, 10)} == {10}
    left = extendible_dedup.keep_one(docs)
    assert left.columns == docs.columns and left.count() == len(by)
    assert extendible_dedup.exact_groups(none[0]).collect() == [] and extendible_dedup.keep_one(none[0]).collect() == []


def test_simhash(docs, none):
    got = simhash_ring.near_duplicates(docs).collect()
    assert len(got) == len(messy())
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (0, 1, 10)} == {0}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert simhash_ring.near_duplicates(none[0]).collect() == []


def test_rules(docs, labels, none):
    got = rule_ensemble.classify(docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len(rule_ensemble.classify(docs, none[1]).collect()) == len(messy())
    assert rule_ensemble.classify(none[0], labels).collect() == []
    assert rule_ensemble.keep_good(docs, labels).columns == docs.columns


def test_crosspolytope(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v), (2, v), (2, v), (3, [1.0, 2.0, 3.001]), (4, None), (5, [0.0] * 3), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]),
        (8, [float("inf"), 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]), (None, v),
    ]
    df = spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], "vec_id long, embedding array<float>, v string, key string, n int")
    got = crosspolytope.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.n_links, r.component_id) for r in got if r.vec_id in (1, 2, 3, None)} == {(4, 1)}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if (r.vec_id or 0) > 3)
    assert crosspolytope.near_duplicates(df.limit(0)).collect() == []


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts timestamp_ntz, etag string, last_modified string, digest string, headers map<string,string>, base string, part string, turn int"
    assert warc_revisits.resolve(spark.createDataFrame([], schema)).collect() == []
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.org/", None), (1, "http://a.org/", None), (2, "", "x" * 100_000)], "page_id long, url string, html string")
    got = warc_revisits.resolve(warc_revisits.captures(pages)).collect()
    assert len(got) == 4 and {r.status for r in got if r.revisit_id == 5} == {"orphan"}


def test_stages_on_nothing(spark, none, tmp_path):
    none[1].select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none[0], str(tmp_path))
        assert out.count() == 0
        if i < 4:
            assert out.columns == none[0].columns


def test_stages_on_messy_rows(spark, docs):
    """Every internal name is also a column here; own columns come through with their values."""
    at = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {tuple(r[5:]) for r in rows} <= {CLASH, (None,) * len(CLASH)} and len(rows) > 0, name
        if name == "exact_copies":
            assert len(rows) == len({(r.text or "").lower() for r in docs.collect()})
        if name == "near_copies":  # the empty texts are one group, the rest as they are equal
            assert len(rows) == len({" ".join((r.text or "").lower().split()) for r in docs.collect()})
    assert {r.text for r in corpus_pipeline.mix(spark, docs, at).collect()} & {None, "", " \t\n"} == set()
    assert corpus_pipeline.encode(spark, docs, at).count() == len(messy())
