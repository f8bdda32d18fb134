import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavemark.llm.common import fresh_path
from wavemark.llm.tokens import ChunkTokenizer, SequenceFile, SequenceWriter, TokenFileConfig, deflated, inflated, read_files, round_trip, sequence_schema, write_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
CFG = TokenFileConfig(PATH, length=32, rows=4, docs_per_file=40)


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def chunked():
    return ChunkTokenizer(open(PATH, encoding="utf-8").read())


PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " \n", "a", "the", "don't", "'s", "'", "12", "é", "ß", "\U0001f600", "...", "!!", "\x1c", "\x1f", "\x85", "\xa0", "　", "<|endoftext|>", "<|", "_", "x1", "'ll go"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_chunks_encode_alike(own, chunked, text):
    assert np.frombuffer(chunked.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1'_. \n!tsréll²½ª"), max_size=14))
def test_latin_text_encodes_alike(own, chunked, text):
    assert np.frombuffer(chunked.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(own, chunked, text):
    assert np.frombuffer(chunked.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, docs, corpus, own):
    rows = round_trip(docs, CFG).collect()
    expected = {}
    for r in corpus:
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        expected.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    got, start = {}, 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert len({r.file for r in rows}) > 1


def test_edges(spark, empty, odd_columns, corpus):
    assert round_trip(empty, CFG).count() == 0
    assert round_trip(odd_columns, CFG).count() == len(corpus)


def test_sequences_by_arithmetic_without_copy(tmp_path):
    cfg = TokenFileConfig(PATH, length=512, rows=16)
    ids = [np.arange(1, n + 1, dtype=np.uint16) for n in (5, 4000, 1, 30000, 7, 9000)]
    with pa.OSFile(str(tmp_path / "t.arrows"), "wb") as f:
        w = SequenceWriter(f, cfg, sequence_schema(cfg, 50257))
        for x in ids:
            w.add(x)
        w.close()
    flat = np.concatenate(ids)
    before = pa.total_allocated_bytes()
    with pa.memory_map(str(tmp_path / "t.arrows")) as f:
        file = SequenceFile(f)
        assert file.batches == -(-len(flat) // 8192)
        for i in (0, 5, 17, -(-len(flat) // 512) - 1):
            tokens, mask = file.sequence(i)
            assert np.array_equal(tokens[mask], flat[512 * i : 512 * i + 512])
            assert not tokens.flags.owndata and not mask.flags.owndata
        batch = file.batch(2)
        assert batch.nbytes > 16000 and pa.total_allocated_bytes() - before < 4096
        assert batch.column(0).type.list_size == 512
    # Any Arrow reader can read the stream.
    with pa.OSFile(str(tmp_path / "t.arrows")) as f:
        table = pa.ipc.open_stream(f).read_all()
    joined = np.concatenate([c.flatten().to_numpy() for c in table.column("ids").chunks])
    mask = np.concatenate([c.flatten().to_numpy() for c in table.column("mask").chunks]).view(bool)
    assert np.array_equal(joined[mask], flat) and mask[: len(flat)].all()


def test_large_vocabularies_take_four_bytes():
    assert sequence_schema(CFG, 70_000).field("ids").type.value_type == pa.uint32()
    assert sequence_schema(CFG, 65_536).field("ids").type.value_type == pa.uint16()


def test_other_splittings_are_encoded_whole(own):
    told = json.loads(open(PATH, encoding="utf-8").read())
    assert ChunkTokenizer(json.dumps(told)).cuts
    told["pre_tokenizer"]["add_prefix_space"] = True
    other = ChunkTokenizer(json.dumps(told))
    text = "word and word's 12"
    assert not other.cuts and np.frombuffer(other.encode([text])[0], "<u4").tolist() == Tokenizer.from_str(json.dumps(told)).encode(text, add_special_tokens=False).ids


def test_a_torn_file_is_noticed(spark, docs):
    out = fresh_path(spark, "torn")
    files = write_files(docs, CFG, out)
    path = files.first().docs_path.removeprefix("file:")
    with pa.OSFile(path) as f:
        table = pa.ipc.open_stream(f).read_all()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table.slice(1))
    with pytest.raises(Exception, match="does not hold"):
        read_files(spark, files, out).collect()


def test_texts_travel_small(corpus):
    texts = [r[1] for r in corpus]
    raw = [x.encode() if x is not None else None for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(range(len(raw))), pa.array(raw, pa.binary())], ["doc_id", "text_key", "text"])
    (out,) = deflated([batch])
    assert inflated(out.column(2), out.column(3)) == [x or "" for x in texts]
    assert out.column(3).nbytes < 0.6 * sum(len(x or b"") for x in raw)
