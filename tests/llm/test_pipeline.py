"""The pipeline's stages, each on its own input, against plain versions; then the whole run."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, ODD, clashing, documents

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from test_minhash import brute, corpus  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    texts = corpus(3) + [t for t in ODD if t is None or "\x00" not in t]
    return [(k, t, f"src{k % 4}" if k % 9 else None) for k, t in enumerate(texts)]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_dedup_stages(spark, rows):
    docs = documents(spark, rows)
    best = defaultdict(int)
    for k, t, _ in rows:
        best[t or ""] = max(best[t or ""], k)
    exact = pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns and ids(exact) == sorted(best.values())
    near = pipeline.near_dedup(spark, docs, "")
    want = brute([r[:2] for r in rows], 80)
    assert near.columns == docs.columns and ids(near) == sorted(k for k, (_, c) in want.items() if c == k)


def test_mixing_stage(spark, rows):
    docs = documents(spark, rows)
    mixed = pipeline.mix(spark, docs, "")
    assert mixed.schema == docs.schema
    taken = Counter(ids(mixed))
    assert max(taken.values()) <= 3 and ids(mixed) == ids(pipeline.mix(spark, docs, ""))
    size = {k: len((t or "").split()) for k, t, _ in rows}
    total, weights = sum(size.values()), {"src0": 1, "src1": 2, "src2": 3, "src3": 1, None: 2}
    for source, w in weights.items():
        words = sum(n * size[k] for k, n in taken.items() if rows[k][2] == source)
        assert abs(words - total * w / 9) < 0.1 * total * w / 9


def test_repeated_ids_are_mixed_as_often_as_the_mix_says(spark, rows):
    from prosemill.llm.mixing import mix_sources

    three = [r for r in rows[:60] for _ in range(3)] + [(None, "of no id " * 9, "src1")] * 7 + [(rows[1][0], "another text of this id", "src3")]
    docs = clashing(documents(spark, three))
    mixed = pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +want


def test_exact_stage_judges_each_text_of_an_id(spark):
    rows = [(5, "same"), (5, "other"), (7, "same"), (7, "third"), (None, "same"), (None, None), (3, "")]
    got = sorted(((r.doc_id, r.text) for r in pipeline.exact_dedup(spark, documents(spark, rows), "").collect()), key=str)
    assert got == sorted([(5, "other"), (7, "same"), (7, "third"), (None, "same"), (None, None), (3, "")], key=str)


def test_classifier_stage(spark):
    from prosemill.llm.ranking import CUT, features, learn

    sf = "/root/testdata/sf0.001"
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = real + [(None, t) for t in ODD] + [(real[0][0], real[1][1])] * 3 + [(10**9, "many words. " * 200_000)]
    docs = clashing(documents(spark, rows))
    ranker = learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter(r for r in rows if ranker.scores(np.array([features(r[1] or "")]))[0] >= CUT)
    out = pipeline.quality_classifier(spark, docs, sf)
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert 0 < want.total() < len(rows)


def test_packing_stage(spark):
    from test_tokens import crc, library_ids

    texts = [t for t in ODD if t is None or len(t) < 4000] + ["many words of one text " * 1500]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (1, "again"), (1, "again")]
    got = pipeline.pack(spark, clashing(documents(spark, rows)), "").collect()
    want = []
    for k, t in rows:
        ids = library_ids(t) + [0]
        want += [(k, n, n * 2048, len(ids[n * 2048 : (n + 1) * 2048]), crc(ids[n * 2048 : (n + 1) * 2048])) for n in range(-(-len(ids) // 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in by.values())


def test_stages_on_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, "/root/testdata/sf0.001")
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_whole_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts.append(docs.count())
    assert len(pipeline.STAGES) == 5 and 100 < counts[2] <= counts[1] <= counts[0] < 200
    packed = pipeline.run(spark, sf).select("doc_id", "length", "offset", "sequence_id").collect()
    assert len(packed) == counts[-1]
    ends = defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 2048
    assert pipeline.ORACLE_SQL is None


def test_workers_hold_results_of_few_texts(spark, monkeypatch):
    """The functions that run in workers give back a large batch part by part, and each text is sent once."""
    import pyarrow as pa

    from prosemill.llm import ranking
    from prosemill.llm.common import SLICE
    from prosemill.llm.packing import document_pieces
    from prosemill.llm.queries import vocabulary

    given = []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: given.append((self.columns, f)) or self)
    n = 3 * SLICE + 1
    document_pieces(docs, vocabulary("word_bpe_49k.json"), 2048)
    ranking.keep_good(docs, ranking.Ranker(np.zeros(ranking.N_FEATURES), np.ones(ranking.N_FEATURES), np.zeros(ranking.N_FEATURES), 0.0, 1.0))
    (_, cut), (sent, good) = given
    texts = pa.array([None, "", *["some words"] * (n - 2)])
    pieces = list(cut(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), texts.fill_null("")], names=["doc_id", "t"])])))
    assert [b.num_rows for b in pieces] == [SLICE] * 3 + [1] and sum(pieces[0].column("length").to_pylist()) > SLICE
    rows = [pa.RecordBatch.from_arrays([pa.array(range(n)), texts, texts], names=docs.columns)]
    kept = list(good(iter(rows)))
    assert sent == docs.columns and [b.num_rows for b in kept] == [SLICE] * 3 + [1] and pa.Table.from_batches(kept) == pa.Table.from_batches(rows)
