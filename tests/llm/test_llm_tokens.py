import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import pieces, token_files
from logloom.llm.queries import BPE, PIECES

ODD = [None, "", " ", "\n", "a  b", " a", "b ", "tab\there", "a\n\nb", "</s>[INST] <unk> <s>", "É ü 　x", "né" * 3000, "日本語 の 文 と 🙂🙂", "\0 zero \0", "▁under ▁bar", "x" * 20_000, "many words " * 20_000, "A B\nC D", "it's we'll 12345 ...", "<|endoftext|>", "one <|endoftext|> two<|endoftext|>three"]


def documents(spark, sf="sf0.001"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_ranks_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(v)
    assert len(control) == -(-len(v) // 4)
    assert token_files.decode_ranks(control, data, len(v)).tolist() == values


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out, start = [], 0
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_files_against_the_library(spark, tmp_path, block):
    rows = [*documents(spark)[:60], *[(100_000 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(d, t, "z", 5) for d, t in rows], "doc_id long, text string, part string, row int").repartition(7)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, BPE, block_ids=block)
    got = token_files.with_crc(token_files.read_token_files(spark, path)).collect()
    assert sorted(map(tuple, got)) == expected_tokens(sorted(rows))


def test_files_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "first"), (3, "same"), (3, "same"), (3, "other"), (1, None)]
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE)
    got = sorted(token_files.with_crc(token_files.read_token_files(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    one = {t: c for _, _, _, c in expected_tokens([(0, "same")]) for t in ["same"]}
    assert sum(r.ids_crc32 == one["same"] for r in got) == 2


def test_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", BPE)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_pieces_against_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*documents(spark)[:120], *[(100_000 + i, t) for i, t in enumerate(ODD) if t is None or "\0" not in t]]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_pieces string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode_pieces(docs, PIECES).collect()}
    for d, t in rows:
        assert got[d] == sp.encode(t or ""), t
    back = {r.doc_id: r for r in pieces.round_trip(docs, PIECES).collect()}
    assert set(next(iter(back.values())).asDict()) == {"doc_id", "text", "n_pieces", "ids_crc32", "decoded_crc32", "decoded_chars", "same"}
    for d, t in rows:
        assert back[d].n_pieces == len(got[d]) and back[d].decoded_chars == len(t or "")
        assert back[d].same == ("▁" not in (t or ""))
        assert back[d].decoded_crc32 == zlib.crc32(sp.decode(got[d]).encode())


def test_pieces_of_an_empty_table_and_repeated_rows(spark):
    assert pieces.round_trip(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0
    got = pieces.encode_pieces(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), PIECES).collect()
    assert sorted(len(r.ids) > 0 for r in got) == [False, True, True]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 400)
    order = pieces.suffix_array(codes, 16)
    keys = [tuple(codes[i : i + 16].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(400)) and keys == sorted(keys)


def test_tokenizers_of_another_kind_are_refused():
    import public_tokenizers
    import pytest

    from logloom.llm.token_files import TextEncoder

    with pytest.raises(ValueError, match="byte-level"):
        TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
