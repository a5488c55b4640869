"""Passages of a benchmark with and without changed words, odd rows, and the planner's way for many seeds."""

import itertools
import random

import pytest

from maskwright.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, seed string").repartition(3)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    filler = lambda n: [f"w{rng.randint(0, 999)}" for _ in range(n)]

    def changed(every):
        return [w if (k + 1) % every else "XX" for k, w in enumerate(ITEM)]

    texts = [
        " ".join(filler(30) + ITEM + filler(30)), " ".join(ITEM).upper(), "\n".join(filler(3) + ITEM[3:19] + filler(9)), " ".join(filler(9) + changed(5) + filler(9)),
        " ".join(filler(9) + changed(6)), " ".join(filler(9) + changed(2) + filler(9)), " ".join(filler(9) + ITEM[:7] + filler(40) + ITEM[7:14]), " ".join(filler(400)), None, "", " \t", "x short item of six words y",
    ]
    bench = spark.createDataFrame([(7, " ".join(ITEM), "q"), (8, "short item of six words", "q"), (9, "tiny one", "q"), (10, None, "q"), (None, "no id " * 9, "q")], "item_id long, text string, at string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    assert {i for i, r in got.items() if r.contaminated} == {0, 1, 2, 3, 4, 11}
    assert got[0].item_ids == "7" and got[11].item_ids == "8" and got[7].item_ids == ""
    assert [got[i].n_words for i in (0, 7, 8, 9, 10)] == [84, 400, 0, 0, 0]


def test_empty_tables_repeated_rows_and_null_ids(spark):
    bench = spark.createDataFrame([(7, " ".join(ITEM)), (7, " ".join(ITEM))], "item_id long, text string")
    docs = spark.createDataFrame([(None, " ".join(ITEM)), (1, " ".join(ITEM)), (1, " ".join(ITEM)), (2, "a b c d e f g h")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.n_items, r.contaminated) for r in decontaminate.contaminated(docs, bench).collect())
    assert rows == [("1", 1, True), ("1", 1, True), ("2", 0, False), ("None", 1, True)]
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contaminated(docs, bench.where("false")).collect())


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string")
    plan = decontaminate.contaminated(docs_of(spark, ["a b c d e f"]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def holds(words, item):
    """By the rule itself: some window agrees in 80 % of its words, place by place."""
    wide = min(16, len(item))
    return any(
        sum(words[p + k] == item[o + k] for k in range(wide)) * 100 >= 80 * wide for o in range(len(item) - wide + 1) for p in range(len(words) - wide + 1)
    )


def test_items_of_every_length_with_as_many_changes_as_the_rule_allows(spark):
    """All places of the changed words for lengths of 1 to 17; documents with one change more hold nothing."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    items, texts, want = [], [], []
    for size in range(1, 18):
        item = [word() for _ in range(size)]
        items.append((size, " ".join(item), 0))
        for more in (0, 1):
            changes = min(size, 16) - -(-min(size, 16) * 80 // 100) + more
            places = list(itertools.combinations(range(size), changes))
            for chosen in rng.sample(places, min(len(places), 60)):
                own = [word() for _ in range(3)] + [word() if k in chosen else w for k, w in enumerate(item)] + [word() for _ in range(2)]
                texts.append((len(texts), " ".join(own)))
                want.append(holds(own, item))
    assert sum(want) > 300 and not all(want)
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string, words int")).collect()}
    assert [got[k][0] for k in range(len(texts))] == want


def test_masks_cover_every_window():
    """No choice of differing words that the rule allows leaves a window without a seed."""
    for size in range(1, 17):
        read = [[k for k, bit in enumerate(m) if bit == "1"] for m in decontaminate.MASKS if len(m) <= size]
        read += [[k for k, bit in enumerate(m) if bit == "1"] for m, own in decontaminate.SHORT_MASKS.items() if size in own]
        for chosen in itertools.combinations(range(size), size - -(-size * 80 // 100)):
            assert any(all(p + k not in chosen for k in r) for r in read for p in range(size - r[-1])), (size, chosen)


def test_a_phrase_that_a_third_of_both_tables_shares(spark):
    phrase = "this common phrase opens very many texts and items"
    items = [(k, f"{phrase} {' '.join(f'i{k}x{j}' for j in range(20))}") for k in range(30)]
    texts = [(k, f"{phrase} {' '.join(f'd{k}x{j}' for j in range(30))}") for k in range(60)] + [(100 + k, f"a b {items[k][1]} c") for k in range(10)]
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert got == {100 + k: str(k) for k in range(10)}
