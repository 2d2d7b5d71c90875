"""Token files, counts and BPE against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rodada.llm import simple8b
from rodada.llm.bpe import Bpe, MergeList, StreamEncoder, round_trip
from rodada.llm.chunks import PieceCache, PieceEncoder, load_tokenizer
from rodada.llm.queries import tokenizer_path
from rodada.llm.token_counts import token_counts
from rodada.llm.token_store import read_token_files, token_store, write_token_files

PATH = tokenizer_path()
ODD = [
    "", " ", "  ", "a  b   c \n\n d \t e\n", "<|endoftext|>x <|endoftext|> \n <|endoftext|>", "  <|endoftext|>", "x\n\n\n   y", "don't we'll I'M a's c'll'", "\n \nfoo   ",
    "é. naïve, Ünï! 中文。 x² ½ ٣٤", "a_ b- c_d.", "\nx\n\ny\n \nz \r\nü\n", "\n", "\n\n", "a\t\nb\x0b\nc\u2028\nd\x85\ne", "word### w.&&& w,!! it''s x'' a`` b~~\nc---\nd", "é" * 3000, "a" * 4000, "=-" * 900, "word. " * 400, " x y \x1cz", "é à.",
]
SCHEMA = "doc_id long, text string, n_tokens string, start string"


def _texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("ab '\n\n\té1.é<|>s,._#!  ") for _ in range(r.randint(0, 40))) for _ in range(400)]


def _docs(spark):
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(ODD)] + [(7, None, None, None), (100, "the same", "", ""), (100, "the same", "", "")]
    random.Random(2).shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_encoders_equal_the_library():
    texts, tok = _texts(), load_tokenizer(PATH)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    pieces, bpe = PieceEncoder(PATH, limit=50), Bpe(PATH, cache=60)
    assert [pieces.encode(t).tolist() for t in texts] == want
    assert [bpe.encode(t).tolist() for t in texts] == want
    for ids, t in zip(want, texts, strict=True):
        assert "".join(bpe.decode(ids, block=7)) == t == tok.decode(ids, skip_special_tokens=False)


def test_stream_is_bounded_and_needs_no_whole_input():
    merges = MergeList(PATH)
    r, stream = random.Random(4), StreamEncoder(merges)
    data = "".join(r.choice("thenaior") for _ in range(20_000)).encode()
    out, held = [], 0
    for at in range(0, len(data), 100):
        stream.push(data[at : at + 100])
        out += stream.settled()
        held = max(held, len(stream.last))
    out += stream.finish()
    assert held < 100 + 8 * merges.lookahead
    tok = load_tokenizer(PATH)
    assert [merges.ids[t] for t in out] == tok.encode(data.decode(), add_special_tokens=False).ids
    assert b"".join(merges.bytes[t] for t in out) == data


def test_invalid_bytes_are_replaced():
    bpe = Bpe(PATH)
    cut = [bpe.m.ids[0xC3], bpe.m.ids[0x28], bpe.m.ids[0xE2]]
    assert "".join(bpe.decode(cut)) == load_tokenizer(PATH).decode(cut, skip_special_tokens=False)


def test_piece_cache_keeps_frequent_entries():
    asked = []
    c = PieceCache(lambda s: asked.append(s) or len(s), limit=4, glue=False)
    for k in range(40):
        assert c["often"] == 6 and c[f"x{k}"] == 1 + len(f"x{k}")
    assert asked.count(" often") == 1 and len(c) + len(c.old) <= 8


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(0, 300))
        v = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) >> r.integers(0, 64, n).astype(np.uint64)
        words, escapes = simple8b.encode_block(v)
        assert (simple8b.decode_block(words, escapes, n) == v).all()
    words, _ = simple8b.encode_block(np.zeros(120, np.uint16))
    assert len(words) == 2


def test_token_store(spark):
    rows, docs = _docs(spark)
    tok = load_tokenizer(PATH)
    got = token_store(docs, PATH).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    start, by_id = 0, {}
    for doc_id, text, *_ in rows:
        by_id.setdefault(doc_id, [*tok.encode(text or "", add_special_tokens=False).ids, 2])
    for r in got:
        ids = by_id[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store(docs.limit(0), PATH).count() == 0


def test_token_files_hold_the_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the word " * (i % 7) * 900) for i in range(40)], "doc_id long, text string")
    where = f"file://{tmp_path}/tokens"
    manifest = write_token_files(docs, where, PATH, end_id=None, partitions=3)
    assert sum(m["n_docs"] for m in manifest) == 40 and len(list((tmp_path / "tokens").iterdir())) == len(manifest)
    tok = load_tokenizer(PATH)
    for r in read_token_files(spark, where, manifest, digest_only=False).collect():
        assert r["ids"] == tok.encode("the word " * (r["doc_id"] % 7) * 900, add_special_tokens=False).ids


def test_token_counts(spark):
    rows, docs = _docs(spark)
    tok = load_tokenizer(PATH)
    got = sorted(tuple(r) for r in token_counts(docs, PATH, table_size=50, cache_size=20).collect())
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows)
    assert got == want
    assert token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_tokenizers(spark, name):
    path = tokenizer_path(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame([(1, "Some  Words here."), (2, None)], "doc_id long, text string"), path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Some  Words here."))
    else:
        want = len(load_tokenizer(path).encode("Some  Words here.", add_special_tokens=False).ids)
    assert got == {1: want, 2: 0}


def test_round_trip(spark):
    rows, docs = _docs(spark)
    tok = load_tokenizer(PATH)
    got = sorted(tuple(r) for r in round_trip(docs, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert round_trip(docs.limit(0), PATH).count() == 0
