import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import suffix_dedup
from rosterlink.llm.suffix_array import suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(0, 40))
def test_suffix_array(head, again):
    text = np.array(head + head[:again], np.uint8)
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_suffix_array_of_longer_texts():
    for text in (b"a" * 700, b"abracadabra " * 60, bytes(random.Random(1).choices(range(256), k=3000)) * 2):
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, length):
    """rows: (rid, text) in order -> {rid: (spans, kept)}"""
    seen, out = set(), {}
    for rid, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans, a = [], None
        for i, g in enumerate([*gone, 0]):
            if g and a is None:
                a = i
            elif not g and a is not None:
                spans.append([a, i])
                a = None
        out[rid] = (spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = ["", None, "short", "a" * 500, "ab" * 300, "é" * 200, "x" * 99, "y" * 100, "y" * 101, " " * 1000]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            parts += [p if rng.random() < 0.5 else p[rng.randrange(len(p)) :], " ".join(word() for _ in range(rng.randint(0, 20)))]
        texts.append("\n".join(parts))
    texts += rng.sample(texts, 12)
    for t in rng.sample([t for t in texts if t and len(t) > 60], 20):
        i = rng.randrange(len(t))
        texts.append(t[:i] + "Q" + t[i + 1 :])
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("length,gram,hot", [(100, 32, 4096), (40, 12, 4096), (40, 12, 3)])
def test_against_brute_force(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    texts = made(length + hot)
    docs = spark.createDataFrame([(i * 3, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, rid string").repartition(5)
    want = brute([(i * 3, t) for i, t in enumerate(texts)], length)
    got = suffix_dedup.remove_repeats(docs, length, gram).collect()
    assert {r.doc_id: (r.spans, bytes(r.kept)) for r in got} == want
    for r in got:
        assert not r.spans or set(r.kept.decode("utf-8", "ignore")) <= set(r.text)


def test_stored_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert {r.doc_id: (r.spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_repeated_and_missing_ids(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(40)) * 4
    docs = spark.createDataFrame([(2, t), (2, t), (None, t), (None, None), (1, "z" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept), r.text is None) for r in suffix_dedup.remove_repeats(docs).collect())
    kept = {str(k): len(v[1]) for k, v in brute([(1, "z" + t), (2, t), (3, t)], 100).items()}
    assert got == sorted([("1", kept["1"], False), ("2", 0, False), ("2", 0, False), ("None", 0, False), ("None", 0, True)])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_too_many_equal_blocks_for_one_suffix_array(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 300)
    raw = np.frombuffer(b"".join(bytes([65 + k % 3]) * 50 for k in range(40)), np.uint8)
    blocks = {"h": np.full(40, 7, np.uint64), "rid": np.arange(40), "s": np.zeros(40, np.int64), "n": np.full(40, 1)}
    marks = suffix_dedup.sorted_blocks(blocks, raw, 50)
    assert marks["rid"].tolist() == list(range(3, 40)) and set(marks["n"].tolist()) == {1}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=3, max_size=60), st.integers(1, 30), st.integers(0, 3))
def test_windows_sorted_by_their_bytes(raw, length, zeros):
    text = np.frombuffer((raw * 4 + bytes(zeros)) + bytes(length), np.uint8)
    starts = np.arange(len(text) - length + 1)
    got = suffix_dedup.whole_windows(text, starts, length)
    want = [text[s : s + length].tobytes() for s in starts]
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_texts_over_a_segment(monkeypatch):
    """A text cut into segments: every window lies in one block, whatever the segment."""
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 101, 5000)))
    for segment in (1 << 20, 700, 100):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        windows = []
        for found in suffix_dedup.blocks_of(pa.array([text]), np.array([5]), 100, 32):
            for r, s, n in zip(found["rid"], found["s"], found["n"]):
                windows += [(int(r), int(s) + k) for k in range(int(n))]
        assert sorted(windows) == [(5, k) for k in range(4901)]
