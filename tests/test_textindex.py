import re

import pytest

from lumenfold.operators import text, textindex

TEXTS = [(1, "The quick brown fox"), (2, "quick fox, quick and brown"), (3, "Unicorns are naïve foxes"), (4, ""), (5, None), (6, "A lazy dog x")]
QUERIES = ["quick fox", "fox OR dog", '"brown fox"', "unic*", "x*", "fox NOT brown", "naive", "missing", '"open', "(dog OR fox) quick"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id long, text string")


def answers(index):
    return {q: sorted((r.file_id, round(r.rank, 9)) for r in text.search(index, q).collect()) for q in QUERIES}


def test_changes_and_merges_answer_as_a_new_index(spark, tmp_path):
    stored = textindex.StoredIndex(spark, f"file://{tmp_path}/index")
    assert stored.sync(frame(spark, TEXTS)) == 6 and stored.sync(frame(spark, TEXTS)) == 0
    assert answers(stored.index()) == answers(text.build(frame(spark, TEXTS)))
    later = [(1, "The slow brown dog"), *TEXTS[2:5], (7, "quick quick quick fox fox"), (6, "")]
    assert stored.sync(frame(spark, later)) == 4
    want = answers(text.build(frame(spark, later)))
    assert answers(stored.index()) == want and len(stored.segments()[1]) == 2
    # Gone, and there again.
    stored.change(frame(spark, []), frame(spark, [(7, None)]))
    assert {i for i, _ in answers(stored.index())["fox OR dog"]} == {1}
    stored.change(frame(spark, [later[-2]]))
    assert answers(stored.index()) == want
    stored.merge()
    assert stored.segments() == (1, [0]) and stored.vacuum() == 1 and answers(stored.index()) == want
    assert stored.sync(frame(spark, later)) == 0 and stored.totals() == (3, 13)


def test_a_change_that_broke_off_does_not_count(spark, tmp_path):
    stored = textindex.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.sync(frame(spark, TEXTS))
    want = answers(stored.index())
    whole = stored._write

    def lost(g, k, *rest):
        whole(g, k, *rest)
        spark._jvm.java.io.File(f"{tmp_path}/index/gen={g}/stats/segment={k}/_SUCCESS").delete()

    stored._write = lost
    stored.sync(frame(spark, TEXTS[:2]))
    assert answers(stored.index()) == want
    del stored._write
    stored.sync(frame(spark, TEXTS[:2]))
    assert answers(stored.index()) == answers(text.build(frame(spark, TEXTS[:2])))


@pytest.mark.parametrize("query, most", [("quick", 1), ("quick OR unic*", 2), ('"brown fox"', 2)])
def test_only_the_query_s_buckets_are_read(spark, tmp_path, query, most):
    stored = textindex.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.sync(frame(spark, TEXTS))
    found = text.matching(stored.index(), text.parse(query))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert "Exchange" not in plan
    scanned = found._jdf.queryExecution().sparkPlan().collectLeaves().apply(0).selectedPartitions()
    assert 0 < scanned.partitionCount() <= most


def test_postings_are_made_where_their_text_is(spark):
    """No occurrence is sent before its document's are put together."""
    made = text.build(frame(spark, [*TEXTS, (9, "b a b é b a")])).postings
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {(r.term, r.n_terms, r.tf, tuple(r.positions)) for r in made.where("file_id = 9").collect()}
    assert rows == {("b", 6, 3, (0, 2, 4)), ("a", 6, 2, (1, 5)), ("e", 6, 1, (3,))} and made.where("file_id in (4, 5)").count() == 0
