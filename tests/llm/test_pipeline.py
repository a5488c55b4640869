"""The pipeline's stages against plain loops over the small table, and odd rows through all of them."""

import re

import pytest

import corpus_pipeline as cp
from maskwright.llm import mixing, pii
from tests.llm.test_minhash import components, sets_of

SF = "/root/testdata/sf0.001"


def passages(text, items):
    """Items with a window of 16 words (or all words) of which 80 % stand in the text, place by place."""
    words = (text or "").lower().split()
    out = []
    for i, t in items:
        own = t.lower().split()
        wide = min(16, len(own))
        if any(
            sum(words[p + k] == own[o + k] for k in range(wide)) * 100 >= 80 * wide
            for o in range(len(own) - wide + 1) for p in range(len(words) - wide + 1) if sum(words[p + k] == own[o + k] for k in range(0, wide, 3)) >= 3
        ):
            out.append(i)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, top = [("documents", docs.collect())], cp.shared_dir(spark) + "/test_pipeline"
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out.append((name, docs.collect()))
    return out


def test_stages_by_brute_force(spark, stages):
    rows = dict(stages)
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "mix"]
    before = {n: rows[stages[k][0]] for k, (n, _) in enumerate(stages[1:])}
    ids = lambda r: sorted(x.doc_id for x in r)
    assert ids(rows["language"]) == ids(x for x in before["language"] if any(c.isalpha() for c in x.text or ""))
    texts = {r.doc_id: r.text for r in before["near_dedup"]}
    want = components(list(texts), sets_of(list(texts.values())), 80)
    assert ids(rows["near_dedup"]) == sorted(set(want.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(rows["decontaminate"]) == ids(x for x in before["decontaminate"] if not passages(x.text, items))
    assert ids(rows["pii"]) == ids(before["pii"])
    cleaned = {r.doc_id: r for r in rows["pii"]}
    for r in before["pii"]:
        after = cleaned[r.doc_id]
        assert after.n_chars == len(after.text) and pii.base_spans(after.text) == [] and (r.source, r.lang) == (after.source, after.lang)
        assert (after.text == r.text) == (not pii.base_spans(r.text))
    mixed = {r.doc_id: r.repeats for r in rows["mix"]}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before["mix"]}
    of = {}
    for r in before["mix"]:
        of.setdefault(r.source, []).append(r.doc_id)
    due = mixing.targets([sum(size[i] for i in of[s]) for s in sorted(of)])
    for s, d in zip(sorted(of), due):
        assert abs(sum(size[i] * mixed.get(i, 0) for i in of[s]) - d) <= max(size[i] for i in of[s])
    assert set(mixed) <= set(size) and all(1 <= n <= 3 for n in mixed.values())


def test_columns(stages):
    assert all(rows[0].asDict().keys() == set(cp.COLUMNS) for _, rows in stages[:-1])
    assert set(stages[-1][1][0].asDict()) == {*cp.COLUMNS, "repeats"}


def test_odd_rows_pass(spark):
    rows = [(1, None, None, None, None), (None, "a b c d e f mail x@y.zz", None, "s", 3), (2, "", "en", None, 0), (3, "the word", "en", "s", 8), (3, "the word", "en", "s", 8), (4, "12 34", "en", "s", 5), (5, "The WORD", "en", "t", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("seed", cp.F.lit(1))
    out = docs
    for name, stage in cp.STAGES:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), out.select(*cp.COLUMNS).schema.add("repeats", "integer") if name == "mix" else out.select(*cp.COLUMNS).schema)
        if name == "near_dedup":
            assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("3", "the word"), ("None", "a b c d e f mail x@y.zz")]
        if name == "pii":
            assert "a b c d e f mail [EMAIL]" in [r.text for r in out.collect()]
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        empty = spark.createDataFrame([], empty.schema)


def test_rows_without_ids_are_decided_like_others(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long, "en", "s", 1), (None, long, "en", "s", 1), (None, long + " more", "en", "t", 1), (7, long + " x", "en", "s", 1), (None, f"a b {item} c", "en", "s", 1), (None, "quite other", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("7", long + " x"), ("None", f"a b {item} c"), ("None", "quite other")])
    clean = cp.decontaminate(spark, docs, SF)
    assert sorted(r.text for r in clean.collect()) == sorted(r[1] for r in rows if item not in r[1])
    many = spark.createDataFrame([(i if i % 3 else None, f"word {i % 50}", "en", "ab"[i % 2], 8) for i in range(600)], docs.schema)
    sums = {}
    for r in mixing.mix_sources(many).collect():
        sums.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= 2 for (_, target), v in sums.items())
    assert cp.mix(spark, many, SF).agg({"repeats": "sum"}).first()[0] * 2 == sum(map(sum, sums.values()))
