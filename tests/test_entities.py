"""Near-duplicate groups against the plain walk, overrides, merging."""

import random

import pytest

from foliary.operators import entities as e
from foliary.operators.common import lookup_join
from foliary.plans.derived import Tables


def walk(names, threshold):
    """Groups by walking the names in order."""
    visited, groups = set(), {}
    sets = [set(n.split()) for n in names]
    for i, a in enumerate(sets):
        if i in visited or not a:
            continue
        group = [
            j
            for j, b in enumerate(sets)
            if j != i and j not in visited and b and len(a & b) / len(a | b) >= threshold
        ]
        if group:
            visited.update([i, *group])
            groups[i] = sorted([i, *group])
    return groups


def run(spark, names, threshold):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place long, name string")
    out = {}
    for r in e.near_duplicate_groups(df, threshold).collect():
        assert names[r.place] == r.name
        out.setdefault(r.seed, []).append(r.place)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed, threshold, longest", [(1, 0.6, 5), (2, 0.6, 14), (3, 0.5, 4), (4, 0.8, 13)])
def test_groups_equal_the_walk(spark, seed, threshold, longest):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)] + ["of", "friends", "the"]
    names = list(
        dict.fromkeys(
            " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, longest))) for _ in range(120)
        )
    )
    # near copies of long names
    for n in list(names)[:30]:
        parts = n.split()
        parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
        if " ".join(parts) not in names:
            names.append(" ".join(parts))
    assert run(spark, names, threshold) == walk(names, threshold)


def test_hot_words_group_exactly(spark):
    names = [f"friends of john person{i}" for i in range(60)] + [f"friends of x{i}" for i in range(60)]
    assert run(spark, names, 0.6) == walk(names, 0.6)


def test_last_override_wins(spark):
    df = spark.createDataFrame(
        [(1, " Ann Lee ", "A"), (2, "ann lee", "B"), (3, "Joe", ""), (4, "", "C")],
        "ord int, client_clean_v1 string, client_canonical string",
    )
    assert [tuple(r) for r in e.override_table(df, "ord").collect()] == [("ann lee", "B")]


def test_merge_ladder(spark):
    predictions = spark.createDataFrame(
        [(1, "f", "raw", "Ann Lee"), (2, "f", "", ""), (3, "f", "x", "The Ohio Gop"), (4, "f", "", ""), (5, "f", "", "")],
        "id int, filename string, client string, client_clean_v1 string",
    )
    found = spark.createDataFrame(
        [(1, "joe hill", "HIGH", "t1"), (2, "joe hill", "MEDIUM", "t2"), (3, "joe hill", "MEDIUM", "t2"), (4, "joe hill", "", "t2")],
        "id int, client_from_ai string, ai_confidence string, source_tier string",
    )
    rows = {r.id: (r.client_canonical, r.canonical_source) for r in e.merge_clients(predictions, found).collect()}
    assert rows == {
        1: ("Joe Hill", "ai_t1"),
        2: ("Joe Hill", "ai_t2_medium"),
        3: ("Ohio Republican Party", "clean_v1_over_ai_medium"),
        4: ("Joe Hill", "ai_t2_last_resort"),
        5: (None, "null"),
    }


def test_looked_up_table_is_not_copied(spark):
    """Copies of its rows would be broadcast by the estimate of one copy."""
    table = spark.range(3000).selectExpr("id AS key", "concat('name ', id) AS name")
    facts = spark.range(5000).selectExpr("id", "id % 4000 AS key")
    joined = lookup_join(facts, table, "key", "left")
    assert joined.where("name IS NULL").count() == 1000
    assert "Generate" not in joined._jdf.queryExecution().executedPlan().toString()
    anti = lookup_join(facts.withColumn("key", e.F.when(e.F.col("key") % 2 == 0, e.F.col("key"))), table, "key", "left_anti")
    assert anti.count() == 2500 + 500


def test_a_stored_table_counts_as_its_rows_do(spark, tmp_path):
    """Two megabytes on disk are some thirty as rows: not for a broadcast."""
    path = str(tmp_path / "names.parquet")
    rows = spark.range(0, 100_000, 1, 1).select("id", e.F.base64(e.F.unhex(e.F.substring(e.F.sha2(e.F.col("id").cast("string"), 256), 1, 24))).alias("name"))
    rows.write.parquet(path)
    names = e.override_table(spark.read.parquet(path).selectExpr("name AS client_clean_v1", "name AS client_canonical"))
    assert 1 << 20 < sum(f.stat().st_size for f in (tmp_path / "names.parquet").glob("*.parquet")) < 10 << 20
    facts = spark.range(3_000_000).selectExpr("CAST(id AS STRING) AS key")
    plan = lookup_join(facts, names, "key")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("view, columns", [("payers", ("id", "raw")), ("doc_mappings", ("document_id", "verbatim_term"))])
def test_documents_may_be_the_smaller_table(spark, tmp_path, view, columns):
    """Fewer documents than parts: they are broadcast by a key that needs the number of parts."""
    folder = str(tmp_path)
    spark.range(3).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang", "'web' AS source", "4L AS n_chars").write.parquet(f"{folder}/documents.parquet")
    parts = spark.range(1, 401).selectExpr("id AS p_partkey", "concat('part ', id, ' of many') AS p_name", "'Brand#2' AS p_brand", "'tin' AS p_type")
    parts.write.parquet(f"{folder}/part.parquet")
    rows = getattr(Tables(spark, folder), view).select(*columns)
    counted = rows.groupBy(columns[1]).count().collect()
    expected = {"payers": 2, "doc_mappings": 8}[view]
    assert sum(r["count"] for r in counted) == expected
