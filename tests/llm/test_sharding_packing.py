import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from rosterlink.llm import packing, sharding

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_shards(spark):
    rows = [(i if i % 9 else None, f"text {i % 5} é" if i % 4 else None, i, 1) for i in range(500)] + [(3, "", 1, 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, shard int")
    got = sharding.shuffle_to_shards(docs, 7, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert sorted(slots) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_to_shards(docs.filter("doc_id is not null").repartition(3), 7, bucket_bytes=2000).collect()
    once = sharding.shuffle_to_shards(docs.filter("doc_id is not null"), 7, bucket_bytes=2000).collect()
    assert Counter(tuple(r)[:2] + tuple(r)[2:] for r in again) == Counter(tuple(r) for r in once)  # the order doesn't depend on the input's
    assert sharding.shuffle_to_shards(docs.limit(0), 7).count() == 0


def test_no_id_fills_a_bucket(spark):
    rows = spark.range(800).selectExpr("case when id < 400 then 7 when id < 600 then null else id end as doc_id", "concat('t', id) as text", "id as rid", "id as bucket", "id as record")
    got = sharding.shuffle_to_shards(rows, 9, bucket_bytes=400).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len({r.rid for r in got}) == 800 and all(r.rid == r.bucket == r.record for r in got) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    near = sum(abs(a.slot - b.slot) <= 2 for a, b in zip(*(sorted((r for r in got if r.doc_id == 7), key=lambda r: r.rid)[k:] for k in (0, 1))))
    assert near < 40  # equal ids lie far apart


def test_places_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    counts = [(b, b * b % 7) for b in range(0, 50, 3)]
    got = {r.bucket: r.base for r in sharding.places(spark.createDataFrame(counts, "bucket int, n long")).collect()}
    assert got == {b: sum(n for c, n in counts if c < b) for b, _ in counts}


def test_packing(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(i if i else None, t) for i, t in enumerate(["", None, "Ünïted states's  a1b2", "word " * 3000, "<|endoftext|>x", "é　É", "a", "q" * 20_000])] + [(5, "same")] * 3
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, ids string").repartition(3)
    pieces = packing.pack(docs, WORD, 2, window=64).collect()
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows)
    sequences, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.ids)
        sequences[p.sequence_id].append((p.offset, p.length))
        whole[p.doc_id if p.doc_id != 5 else (5, p.sequence_id)].append((p.start, ids, p.doc_tokens))
    n = sum(len(t) * k for t, k in want.items())
    for s, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
        assert sum(x for _, x in parts) == (64 if s < n // 64 else n % 64)
    assert sorted(sequences) == list(range(-(-n // 64)))
    for key, parts in whole.items():
        if key != (5, key[1] if isinstance(key, tuple) else 0):
            ids = sum((x for _, x, _ in sorted(parts)), ())
            assert want[ids] and len(ids) == parts[0][2]
    assert packing.pack(docs.limit(0), WORD, 2).count() == 0
