import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterlink.llm import bpe, token_count, tokens
from rosterlink.llm.tokens import memo

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
TEXTS = ["", " ", "  a  b", "a b", "don't  stop ", "x  y", "one\n\n two\t three", "<|endoftext|> a<|endoftext|>b", "É́ éx", "ab\x01 cd", "名前 テスト", "a" * 700, "ΣΑΣ ς", "\r\n", "!!! ??? ...", "İstanbul ǅ", "it's we'll", "\x1c x\x1d y", "😀 👩‍👩‍👧 z"]
letters = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1.,é́ 　ñ<|endoftext|>Σ"), st.characters(codec="utf-8")), max_size=60)


def expected(text, path):
    return LIB[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    for path in (BYTE, WORD):
        ids, starts = memo(path).ids(pa.array([*texts, *TEXTS, None], pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
        assert got == [expected(x, path) for x in [*texts, *TEXTS, ""]]
        assert memo(path).counts(pa.array([*texts, *TEXTS], pa.string())).tolist() == [len(x) for x in got[:-1]]


def test_words_and_marks_give_the_librarys_ids(monkeypatch):
    """Every letter and mark that is not sent through the whole library, in each place, also when hardly anything is remembered."""
    monkeypatch.setattr(tokens, "GENERATION", 50)
    one = [c for c in map(chr, range(33, 0x530)) if re.fullmatch(f"[{tokens.LETTERS}{tokens.MARKS}0-9]", c)]
    assert len(one) > 500
    texts = [f.format(c) for c in one for f in ("{0}", "a{0}b ({0}). {0}{0}", "x {0}y 1{0}2 Ab{0}, '{0}", ".{0}12, {0}'s")]
    for path in (BYTE, WORD):
        own = tokens.PieceMemo(path)
        assert own.form
        ids, starts = own.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [expected(x, path) for x in texts]
        assert max(map(len, (own.units.young, own.units.old))) <= 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abÄßЖ09.,(\"-_<|>' \n", max_size=30), max_size=8))
def test_mixed_words_and_marks(texts):
    for path in (BYTE, WORD):
        ids, starts = memo(path).ids(pa.array([*texts, "<|endoftext|>"]))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])][:-1] == [expected(x, path) for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeéz", min_size=30, max_size=400), st.integers(1, 40))
def test_tree_concatenation_of_unsplit_text(text, leaf):
    assert bpe.unsplit_ids(text.encode(), BYTE, leaf) == expected(text, BYTE)


@settings(max_examples=60, deadline=None)
@given(letters.map(lambda x: x * 7), st.integers(4, 50))
def test_tree_concatenation_of_texts(text, most):
    parts = [(x, bpe.text_ids(x, BYTE)) for x in bpe.halves(text, most)]
    assert bpe.concatenated(parts, BYTE) == expected(text, BYTE)


def test_long_unsplit_texts_whole():
    for text in ("ab" * 5000, "x" * 3000 + " y" + "é" * 2000, " " * 4000 + "z", "\n" * 5000, "!?" * 2500, "a<|endoftext|>" + "q" * 3000, "\x01 " * 900 + "w" * 2000):
        assert bpe.text_ids(text, BYTE) == expected(text, BYTE)
        ids, starts = bpe.ids_of(pa.array([text, "a", None, text]).fill_null(""), BYTE)
        assert ids[starts[3] :].tolist() == expected(text, BYTE)


@settings(max_examples=60, deadline=None)
@given(letters.map(lambda x: x * 9), st.integers(8, 60), st.integers(2, 20))
def test_overlap_resynchronisation(text, chunk, overlap):
    assert token_count.spliced_count(text, BYTE, chunk, overlap) == len(expected(text, BYTE))


def test_counts_and_round_trip(spark):
    texts = [*TEXTS, None, "word " * 9000, "q" * 40_000, "naïve\n" * 7000]
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, "twice", "x", 1)] * 2, "doc_id long, text string, ids string, part int")
    counts = {(r[0], r.n_bytes): r.n_tokens for r in token_count.count_tokens(docs, BYTE).collect()}
    assert counts == {(r.doc_id, len((r.text or "").encode())): len(expected(r.text or "", BYTE)) for r in docs.collect()}
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert len(got) == docs.count()
    key = lambda i, t: (i or 0, hashlib.sha256((t or "").encode()).hexdigest())
    want = {key(r.doc_id, r.text): expected(r.text or "", BYTE) for r in docs.collect()}
    assert {key(r.doc_id, r.text): r.ids for r in got} == want
    assert bpe.encode(docs.limit(0), BYTE).count() == 0 and token_count.count_tokens(docs.limit(0), BYTE).count() == 0
    assert np.all([b"".join(bpe.byte_table(BYTE)[i] for i in r.ids).decode() == r.text for r in got])


def test_decoding_of_any_ids():
    rows = [[220], [], [50256, 64], [158, 242], [242], expected("é 😀", BYTE)[:-1], expected("é 😀", BYTE)]
    got = bpe.texts_of(pa.array([*rows, None], pa.list_(pa.int32())), bpe.byte_table(BYTE)).to_pylist()
    assert got == [LIB[BYTE].decode(x, skip_special_tokens=False) for x in rows] + [None]
    assert bpe.texts_of(pa.array([[220], expected("é x", BYTE)], pa.list_(pa.int32())), bpe.byte_table(BYTE)).to_pylist() == [" ", "é x"]


def test_texts_that_are_cut_into_halves(spark):
    """Texts over the limit, whose parts other tasks encode: null and repeated ids, unsplit text, white space, other scripts."""
    texts = ["word and, more words " * 5000, "q" * 70_000 + " z", "\n \t " * 20_000, "名前 テスト " * 9000, "a<|endoftext|> b" * 6000, "short", None, ""]
    rows = [(i // 2 if i % 3 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (bpe.LONG_TEXT, 5000):
        got = sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode(docs, BYTE, long_text=limit).collect())
        assert got == sorted((str(i), expected(t or "", BYTE)) for i, t in rows)
    counts = sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(docs, BYTE).collect())
    assert counts == sorted((str(i), len(expected(t or "", BYTE))) for i, t in rows)
