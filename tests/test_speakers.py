import random

import duckdb
import pytest

from tidelane.operators import speakers
from tidelane.plans import catalog


def _differences(spark, folder, turns):
    """Rows of r24_relations that its SQL hasn't, and the other way round, over conversations of texts of these lengths."""
    rows = [(i, j, "ab"[j % 2], "x" * n) for i, own in enumerate(turns) for j, n in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    found = catalog.queries()["r24_relations"](spark, str(folder))
    duck = duckdb.connect(config={"threads": 1})  # more may add up a long conversation in parts
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.oracle_sql()['r24_relations']})").fetchall()
    plain = lambda data: {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in data}
    assert len(want) == len(turns)
    return plain(found.collect()) ^ plain(want), plain(want)


def test_relations_of_quick_answers_equal_sql(spark, tmp_path):
    draw = random.Random(0)
    differ, want = _differences(spark, tmp_path, [[draw.randrange(291, 300) for _ in range(draw.randrange(3, 9))] for _ in range(600)])
    assert not differ
    assert sum(r[5] == 0.1 for r in want) > 10 and {r[7] for r in want} == {"dynamic_conversation", "collaborative_discussion"}


def test_relations_of_long_conversations_equal_sql_at_halves(spark, tmp_path):
    draw = random.Random(1)
    turns = [[10 - i % 10] + [draw.randrange(300) for _ in range(319)] + [17 - i % 10] for i in range(60)]
    differ, want = _differences(spark, tmp_path, turns)
    assert not differ and {r[5] for r in want} <= {0.002187, 0.002188}


@pytest.mark.parametrize("change, kind", [(0.1, "collaborative_discussion"), (0.1001, "dynamic_conversation")])
def test_relation_goes_by_the_mean_without_rounding_errors(spark, change, kind):
    rows = [(1, i, "ab"[i % 2], "", i * 1000, i * 1000 + 900, e) for i, e in enumerate([0.7, 0.8, 0.8 + 2 * change - 0.1])]
    df = spark.createDataFrame(rows, "key int, at int, speaker string, text string, start_ms long, end_ms long, energy_level double")
    got = speakers.relations(df, "key", ["at"]).first()
    assert (got.interactions, got.mean_gap, got.mean_change, got.relation) == (2, 100.0, change, kind)
