"""Ids, spans and decoded texts against the library: for the model as it is, and for the same model with compiled character maps and other rules for white space."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from rosterlink.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab .,'▁\n é名👨²0<>s/(\"\t-_"
MAPPED = LETTERS + "ｱﾞ㍿ ﬁ　 ​AÅ̈か゛ｶﾞ①½…¨"
FIXED = ["", " ", "  ", "a", " a", "a ", "a  b", "▁a", "名前 テスト", "x\ny\t z", "é́ ñ", "<0x0A><s></s><unk>", "\x00\x01", "q" * 3000, "²².²", "👨‍👩‍👧 x", "   lead", "tail   ", "x ▁ "]


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def agree(path, texts):
    own, library = sentence_pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, bounds, starts, ends = own.encode(pa.array(texts))
    decoded = own.decode(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))).to_pylist()
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        found = library.encode(text, return_type="proto").pieces
        assert list(zip(ids[a:b], starts[a:b], ends[a:b], strict=True)) == [(p.id, p.begin, p.end) for p in found], text
        assert decoded[i] == library.decode(ids[a:b].tolist()), text


def test_model_as_it_is():
    rng = random.Random(1)
    agree(PATH, FIXED + ["".join(rng.choices(LETTERS, k=rng.randint(0, 30))) for _ in range(1500)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_compiled_maps(tmp_path, rule, squeeze, prefix):
    rules = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec() + bytes([0x18, prefix, 0x20, squeeze])
    with open(PATH, "rb") as f:
        (tmp_path / "m").write_bytes(f.read() + b"\x1a" + varint(len(rules)) + rules)
    rng = random.Random(squeeze * 2 + prefix)
    agree(str(tmp_path / "m"), FIXED + ["".join(rng.choices(MAPPED, k=rng.randint(0, 30))) for _ in range(800)])


def test_decoding_any_ids():
    own, library, rng = sentence_pieces.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(4)
    lists = [[rng.randrange(32000 if rng.random() < 0.5 else 300) for _ in range(rng.randint(0, 6))] for _ in range(2000)]
    assert own.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in lists]


def test_frames(spark):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "", "z"), (2, "名 " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = sentence_pieces.decode(sentence_pieces.encode(docs, PATH), PATH, to="starts")
    assert found.columns == ["doc_id", "ids", "ends", "starts"]
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.ids, r.starts) for r in found.collect()))) == sorted(map(str, want))
    assert sentence_pieces.encode(docs.limit(0), PATH).collect() == []
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {r.text for r in sentence_pieces.decode(null, PATH).collect()} == {None, ""}
