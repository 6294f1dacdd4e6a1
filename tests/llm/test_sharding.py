import pytest

from tabaudit.llm import sharding as S
from tests.llm.helpers import clashing, docs, rows


def test_table_is_full_and_even():
    table = S.fill_table(S.SHARDS[:7], 211)
    held = [table.count(s) for s in range(7)]
    assert sum(held) == 211 and max(held) - min(held) <= 1


def test_shards_claim_in_turns_by_preference():
    shards, size = ["a", "b", "c"], 7
    free, want = [None] * size, {s: [(S.preference(s, size)[0] + j * S.preference(s, size)[1]) % size for j in range(size)] for s in shards}
    turn = 0
    while None in free:
        s = shards[turn % 3]
        free[next(x for x in want[s] if free[x] is None)] = turn % 3
        turn += 1
    assert S.fill_table(shards, size) == free


def test_losing_a_shard_moves_few_other_slots():
    before, after = S.fill_table(S.SHARDS[:20], 2039), S.fill_table(S.SHARDS[:19], 2039)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.15 * 2039


@pytest.mark.parametrize("shards,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 10 ** 9 + 7)])
def test_bad_parameters(shards, size):
    with pytest.raises(ValueError):
        S.fill_table(shards, size)


def test_nulls_repeats_and_clashing_columns(spark):
    df = clashing(docs(spark, [(None, "x", None, None, None), (5, "a", "en", "s", 1), (5, "b", "en", "s", 1)]), "slot", "shard", "_slot")
    out = S.assign_shards(df.drop("_slot")).collect()
    assert len(out) == 3 and all(r["shard"].startswith("shard-") and 0 <= r["slot"] < S.TABLE_SIZE for r in out)
    by = [r["shard"] for r in out if r["doc_id"] == 5]
    assert by[0] == by[1]
    assert S.assign_shards(docs(spark, [])).count() == 0


def test_plan_has_no_shuffle_of_rows(spark):
    plan = S.assign_shards(docs(spark, rows("a", "b"))).select("doc_id", "shard")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
