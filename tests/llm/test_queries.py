"""The queries themselves, over small tables with nulls, copies, repeated passages and a long text: against SQL, the tokenizers library, or plain Python."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rosterlink.llm import queries

from .test_spelling import brute as spelling_brute
from .test_spelling import rows_of as spelling_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("tables")
    words = [f"{a}{b}" for a in ("ba", "Lo", "mi", "ñu", "TE", "sa") for b in ("ra", "to", "é", "x1", "ng")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    passage, base = prose(70), prose(60)
    texts = [prose(rng.randint(1, 80)) for _ in range(40)]
    texts += [base, base, base.replace(".", " ."), base + " added", f"{prose(5)} {passage} {prose(6)}", f"{passage}\n{prose(9)}", passage + passage]
    texts += [None, "", " ", "one", "two words", "<|endoftext|> it's  odd\x01 x", prose(7000), "q" * 3000, "ab" * 150, "名前 テスト " * 30, "Salt and pepper, and salt " * 130, "wandern " * 40 + "Wandernn wandernd Überfall überfall " * 3]
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)]
    vectors += [(60 + i, [x * (i + 1) for x in vectors[i][1]], vectors[i][2]) for i in range(9)]
    vectors += [(70, None, 1), (71, [0.0] * 6, 1), (72, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (73, vectors[0][1], None), (74, [float("nan")] * 6, 0), (75, vectors[0][1][:5], 0), (76, [float("inf")] + [0.0] * 5, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    urls = ["http://a.com/en/1", "https://EXAMPLE.com/en/71?x", "http://b.net/de/8", "http://x.example.net/de/8/9#z", "http://c.org/es/", "http://c.org/fr", None, "no scheme", "http://", "ftp://a.com", "http://a.com/en/2", "http://a.com/de/2"]
    spark.createDataFrame([(i, u, '<a href="/x">x</a>' if i % 2 else None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), rows


def rows_of(found):
    return found.collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tables, name):
    folder, _ = tables
    got = queries.QUERIES[name](spark, folder)
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert want and Counter(map(tuple, got.collect())) == Counter(want)


def test_round_trip(spark, tables):
    folder, docs = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(queries.op2_bpe_round_trip(spark, folder))) == want


def test_counts(spark, tables):
    folder, docs = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, len((t or "").encode()), n, n > 512) for i, t, *_ in docs for n in [len(library.encode(t or "", add_special_tokens=False).ids)]}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(queries.op3_token_counts(spark, folder))} == want


def test_spelling(spark, tables):
    folder, docs = tables
    got = queries.op11_spelling_variants(spark, folder)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_rows(got) == spelling_brute([(i, t) for i, t, *_ in docs])


def test_sentence_pieces(spark, tables):
    folder, docs = tables
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, text, *_ in docs:
        ids = library.encode(text or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(queries.op12_sentencepiece(spark, folder))} == want


def test_quality(spark, tables, tmp_path):
    """Scores do not change with what must not be read: labels of held-out rows, lang, source and ids."""
    folder, docs = tables
    got = {r.doc_id: r for r in rows_of(queries.op5_quality(spark, folder))}
    assert len(got) == len(docs) and got[docs[0][0]].score is not None
    for i, *_ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
    spark.createDataFrame([(i, t, "yy", "other", 0) for i, t, *_ in docs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r.doc_id, 1 - r.quality if got[r.doc_id].held_out else r.quality, 1) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id: r.score for r in rows_of(queries.op5_quality(spark, str(tmp_path)))} == pytest.approx({i: r.score for i, r in got.items()})


def test_shards(spark, tables):
    folder, docs = tables
    rows = rows_of(queries.op8_sharding(spark, folder))
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs} and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(40)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_packing(spark, tables):
    folder, docs = tables
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(queries.op10_packing(spark, folder)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in pieces.items():
        parts.sort()
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(ids[i])
    assert set(pieces) == set(ids)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(sequences) == -(-sum(map(len, ids.values())) // 4096)
