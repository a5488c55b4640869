"""Language of held-out documents, odd rows and codewords."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et la souris", "fr", 1), (3, None, "en", 1), (5, "123 !?", "en", 1), (None, "", None, 1), (6, "…—", None, 2), (8, "Ж", None, 3), (8, "Ж", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted((str(r.doc_id), r.lang_pred == "und", r.score == 0) for r in language.identify(docs).collect())
    assert [g[:2] for g in got] == [("1", False), ("2", False), ("3", True), ("5", True), ("6", True), ("8", False), ("8", False), ("None", True)]
    assert all(zero for _, und, zero in got if und)
    assert language.identify(docs.where("false")).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 20):
        words = language.codewords(n)
        assert len({w.tobytes() for w in words}) == n
        assert n < 4 or min((words[a] != words[b]).sum() for a in range(n) for b in range(a)) >= 3
