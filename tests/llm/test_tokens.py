"""Packing, token counts and token tables against the libraries themselves."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, ODD, clashing, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

MORE = ["It's 'street' I'LL", "<|endoftext|> x<|startoftext|>y", "Σ ΑΣ İstanbul", "▁▁a ▁ b", "x² m³ 1a2b", "a  b\n\n c ", "हिन्दी ไทย"]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark, [(k * 3 - 9, t) for k, t in enumerate(ODD + MORE)] + [(None, "no id"), (0, "twice"), (0, "twice")])).repartition(3)


def test_counts_equal_sentencepiece(docs):
    from prosemill.llm.token_counts import count_tokens
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(tuple, count_tokens(docs, PIECES, limit=50).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 50) for r in docs.collect()]
    assert got == sorted(want, key=str)


def test_counts_equal_tokenizers(docs):
    from prosemill.llm.token_counts import count_tokens

    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in count_tokens(docs, WORDS).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(library_ids(r.text))) for r in docs.collect())


def test_encoder_equals_library_on_random_texts():
    import random

    from prosemill.llm.encoding import IdEncoder, PieceCounter

    encoder, counter, rng = IdEncoder(WORDS), PieceCounter(PIECES), random.Random(5)
    assert encoder.short and counter.split
    signs = " \n\tabcdeéÉñßA'.,!#1٣_-▁<|>😀́ж日²"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(50)))
        assert encoder.encode(text) == encoder._library(text)
        assert counter.count(text) == len(counter.model.encode(text))


def test_memos_that_turn_over_change_no_count(spark, monkeypatch):
    from prosemill.llm import encoding
    from prosemill.llm.token_counts import count_tokens
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(encoding, "MEMO_PARTS", 5)
    model, words = SentencePieceProcessor(model_file=PIECES), "the water of the house was found "
    counter = encoding.PieceCounter(PIECES)
    texts = [f"{words * (k % 7)} {k} " + "z" * (k * 40) for k in range(60)]
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) for t in texts]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, [(1, words * 60_000), (2, None), (3, "")]), PIECES).collect()}
    assert got == {1: len(model.encode(words * 60_000)), 2: 0, 3: 0}


@pytest.mark.parametrize("size", [4, 2048])
def test_packing_round_trip(docs, size):
    from prosemill.llm.packing import pack_documents

    rows = pack_documents(docs, WORDS, size=size, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 <= size and r.start == r.piece * size
        by_doc[r.doc_id].append((r.piece, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for r in docs.where("doc_id is not null and doc_id != 0").collect():
        ids = np.frombuffer(b"".join(x for _, x in sorted(by_doc[r.doc_id])), "<u4").tolist()
        assert ids == library_ids(r.text) + [0]
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // size) * 1.3 + 1


def test_place_fills_sequences():
    import random

    from prosemill.llm.packing import place

    lengths = sorted((random.Random(k).randrange(1, 700) for k in range(3000)), reverse=True)
    where, offset = place(lengths, 1000)
    assert max(where) + 1 <= -(-sum(lengths) // 1000) + 2
    new, _ = place(lengths, 1000, weigh_new=True)
    assert max(where) <= max(new) <= 1.02 * max(where)
    assert place([], 10) == ([], []) and place([10, 10, 5, 5], 10)[0] == [0, 1, 2, 2]


@pytest.mark.parametrize("weigh_new", [False, True])
def test_place_makes_the_sum_of_squares_smallest(weigh_new):
    import random

    from prosemill.llm.packing import place

    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.randrange(1, 13) for _ in range(40)]
        for n in range(1, 40):  # one piece more each time: the sum after it is the smallest there is
            before, _ = place(lengths[:n], 12, weigh_new)
            where, offset = place(lengths[: n + 1], 12, weigh_new)
            assert where[:n] == before
            filled = Counter()
            for k, at in enumerate(where[:n]):
                filled[at] += lengths[k]
            s = lengths[n]
            options = [k for k, f in filled.items() if f + s <= 12]
            if weigh_new or not options:
                options.append(len(filled))
            cost = lambda at: sum(m * m for m in Counter(12 - f for f in (filled + Counter({at: s})).values() if f < 12).values())
            assert where[n] in options and cost(where[n]) == min(map(cost, options)) and offset[n] == filled[where[n]]


def test_equal_rows_are_dealt_to_groups_of_bounded_size(spark):
    from prosemill.llm.packing import pack_pieces

    rows = [(None, 0, 1, 5)] * 900 + [(k, 0, k, 7) for k in range(100)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, ids_crc32 long, length long")
    packed = pack_pieces(pieces, 20, ["doc_id", "piece", "ids_crc32"], per_group=50).collect()
    groups = Counter(r.sequence_id >> 32 for r in packed)
    assert sum(groups.values()) == 1000 and len(groups) == 20 and max(groups.values()) < 100


def test_token_tables(spark, docs):
    from prosemill.llm.sstable import open_shard, read_shards, write_shards
    from prosemill.llm.common import shared_path

    manifest = write_shards(docs, shared_path(spark, "t"), WORDS, 2, 4)
    got = [tuple(r) for r in read_shards(manifest).orderBy("start").collect()]
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for r in ordered:
        ids = library_ids(r.text) + [2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    readers = [open_shard(r.path) for r in manifest.collect()]
    for r in ordered:
        found = [v for reader in readers for v in reader.lookup(r.doc_id)]
        assert np.array(library_ids(r.text) + [2], "<u4").tobytes() in found
        assert len(found) == sum(x.doc_id == r.doc_id for x in ordered)
    assert not any(reader.lookup(10**12) for reader in readers)


def test_many_blocks():
    import io

    from prosemill.llm import sstable

    out = io.BytesIO()
    writer = sstable.TableWriter(out)
    values = {k * 7: np.arange(k % 9000, dtype="<u4").tobytes() for k in range(800)} | {7_000_000: np.array([70000], "<u4").tobytes()}
    for k in sorted(values):
        writer.add(sstable.key_of(k), values[k])
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(-1), b"")
    writer.finish()
    reader = sstable.TableReader(io.BytesIO(out.getvalue()))
    assert len(reader.blocks) == 3
    assert {sstable.id_of(k): v for k, v in reader} == values
    assert all(reader.lookup(k) == [v] for k, v in values.items()) and reader.lookup(3) == []
    damaged = bytearray(out.getvalue())
    damaged[-sstable.FOOTER.size - 3] ^= 1
    with pytest.raises(ValueError):
        sstable.TableReader(io.BytesIO(bytes(damaged)))


def test_empty_table(spark):
    from prosemill.llm.packing import pack_documents
    from prosemill.llm.sstable import token_tables
    from prosemill.llm.token_counts import count_tokens

    none = spark.createDataFrame([], DOCS)
    assert count_tokens(none, PIECES).count() == 0
    assert pack_documents(none, WORDS).count() == 0
    assert token_tables(none, WORDS).count() == 0


def test_token_tables_of_tables_that_are_no_plain_scan(spark):
    from prosemill.llm.common import shared_path
    from prosemill.llm.sstable import MOST_SHARDS, token_tables, write_shards

    one = documents(spark, [(4, "one row")])
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_tables(one, WORDS).collect()] == [(4, 0, len(library_ids("one row")) + 1)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    joined = docs.join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id", "left")
    assert token_tables(joined, WORDS).count() == docs.count()
    assert token_tables(one.limit(0), WORDS, shards=3).count() == 0
    for shards in (0, MOST_SHARDS + 1):
        with pytest.raises(ValueError):
            write_shards(one, shared_path(spark, "t"), WORDS, 2, shards)


def test_an_id_of_many_rows_takes_several_shards_and_strays_go(spark, tmp_path):
    from prosemill.llm.sstable import open_shard, read_shards, write_shards

    (tmp_path / "shard-00000000-of-a-lost-attempt.sst").write_bytes(b"half")
    rows = [(7, f"text {k} of one id") for k in range(300)] + [(None, f"no id {k}") for k in range(300)] + [(9, "last")]
    manifest = write_shards(documents(spark, rows), f"file://{tmp_path}", WORDS, 2, 6)
    files = manifest.collect()
    assert {r.path.rpartition("/")[2] for r in files} == {p.name for p in tmp_path.glob("*.sst")}
    assert max(r.n_docs for r in files) < 200
    got = read_shards(manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.ids_crc32) for r in got] == [(k, crc(library_ids(t) + [2])) for k, t in ordered]
    assert sum(len(open_shard(r.path).lookup(7)) for r in files) == 300
