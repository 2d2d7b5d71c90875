"""The pipeline's stages on a small corpus whose outcome is known."""

import random
import weakref

import pyarrow as pa

import corpus_pipeline
from rodada.llm.common import kept, release
from rodada.operators.work import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    vocabulary = {"en": [f"{a}{b}" for a in ("the", "and", "wor", "ing") for b in ("th", "er", "on", "ly", "sh", "and")], "de": [f"{a}{b}" for a in ("der", "und", "ich", "ß") for b in ("en", "er", "ü", "sch", "ein", "auf")]}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, 120), lang, "s", 1, "x") for i, lang in enumerate(["en", "de"] * 30)]
    item, passage = text("en", 30), text("en", 80)
    rows += [(100, rows[4][1], "en", "s", 1, "x"), (101, rows[5][1] + " ende", "de", "s", 1, "x"), (102, f"{text('en', 60)} {item} {text('en', 60)}", "en", "s", 1, "x"), (103, None, "en", "s", 1, ""), (104, "123 456", None, None, None, None)]
    rows += [(110 + k, f"{text('en', 90)} {passage} {text('en', 90)}", "en", "s", 1, "x") for k in range(2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)))
        kept.append({x["doc_id"]: x for x in docs.collect()})
        assert docs.columns == list(corpus_pipeline.COLUMNS) or name == corpus_pipeline.STAGES[-1][0]
    clean = set(range(60))
    assert set(kept[0]) == clean | {100, 101, 102, 110, 111}
    assert set(kept[1]) == clean | {102, 110, 111}
    assert set(kept[2]) == set(kept[1]) and all(passage not in kept[2][k]["text"] and kept[2][k]["n_chars"] == len(kept[2][k]["text"]) for k in (110, 111))
    assert all(kept[2][k]["text"] == rows[k][1] for k in clean)
    assert set(kept[3]) == clean | {110, 111} and set(kept[4]) == set(kept[3])
    assert all(len(x["ids"]) == x["n_tokens"] for x in kept[4].values())
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(kept[4])


def test_pipeline_of_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_a_doc_id_keep_their_texts(spark, tmp_path):
    r = random.Random(3)
    word = lambda: r.choice(["the", "and", "water", "house", "thing", "other", "there", "where", "wood"]) + r.choice(["", "s", "ing", "er", "land"])
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    rows = [(i, text(120), "en", "s", 1, "x") for i in range(20)]
    rows += [(50, f"{text(70)} {passage}", "en", "s", 1, "x"), (50, f"{passage} {text(90)}", "en", "t", 1, "x"), (50, rows[3][1], "en", "s", 1, "x"), (51, rows[4][1], "en", "s", 1, "x"), (51, rows[4][1], "en", "s", 1, "x")]
    rows += [(60, text(40_000), "en", "s", 1, "x"), (None, text(50), "en", "s", 1, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # 50 shares a text with 3, so its three texts are in the component of 3 and go; 51 copies 4; the row without id goes
    assert got == [*range(20), 60]
    rows = [x for x in rows if x[:2] != (50, rows[3][1])]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = sorted(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [*range(20), 50, 50, 60]


def test_stages_that_keep_nothing_free_the_workers(spark):
    def held(batches):
        from rodada.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._KEPT)] * batch.num_rows, pa.int64())], names=["n"])

    most = lambda: spark.range(64).repartition(64).mapInArrow(held, "n long").groupBy().max("n").first()[0]
    docs = spark.range(64).repartition(64).selectExpr("id AS doc_id", "concat('these are words ', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.tokens(spark, docs, "")
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert all(len(x["ids"]) == x["n_tokens"] for x in got.collect()) and most() == 1
    assert len(corpus_pipeline.language(spark, docs, "").collect()) == 64
    assert most() == 0


def test_what_a_worker_gave_up_is_freed_at_once():
    class Circle:
        def __init__(self, name):
            self.name, self.me = name, self

    a = weakref.ref(kept(Circle, "a"))
    assert kept(Circle, "a") is a()
    b = weakref.ref(kept(Circle, "b"))
    assert a() is None and b().name == "b"
    release()
    assert b() is None
