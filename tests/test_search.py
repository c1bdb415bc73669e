"""Search: brute force and properties."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.functions import lexemes
from foliary.functions.lexemes import may_contain, query_lexemes, stem_word
from foliary.operators import search as s

WORDS = ["tax", "road", "school", "water", "jobs", "north"]


def make(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [
        (
            i,
            f"f{i}.pdf",
            " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))),
            "COMPLETED" if i % 5 else "FAILED",
            f"2024-01-{i % 28 + 1:02d} 00:00:00",
            [rng.uniform(-1, 1) for _ in range(4)] if i % 3 else None,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows,
        "id long, filename string, extracted_text string, status string, created string, search_vector array<float>",
    )
    return df.withColumn("created_at", F.to_timestamp("created")).drop("created"), rows


def brute_rank(text, words, weight=0.1):
    tokens = text.split()
    hits = [(p, t) for p, t in enumerate(tokens) if t in words]
    covers = set()
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            inside = {t for _, t in hits[i : j + 1]}
            if inside == set(words):
                smaller = (
                    {t for _, t in hits[i + 1 : j + 1]} == set(words) or {t for _, t in hits[i:j]} == set(words)
                )
                if not smaller:
                    covers.add((hits[i][0], hits[j][0], j - i))
                break
    x = sum(weight / (1 + (q - p) - inside) for p, q, inside in covers)
    return x / (x + 1)


@pytest.mark.parametrize("words", [["tax"], ["tax", "road"], ["tax", "road", "school"]])
def test_cover_rank_equals_brute_force(spark, words):
    df, rows = make(spark)
    got = {
        r.id: r.text_relevance
        for r in s.cover_rank(s.hits_in_text(df, words, stem=False), words).collect()
    }
    want = {}
    for r in rows:
        score = brute_rank(r[2], words)
        if score > 0:
            want[r[0]] = score
    assert got == pytest.approx(want)
    assert all(0 < v < 1 for v in got.values())


def test_closer_and_more_is_higher(spark):
    df = spark.createDataFrame(
        [(1, "", "tax road"), (2, "", "tax x road"), (3, "", "tax road tax road")],
        "id long, filename string, extracted_text string",
    )
    words = ["tax", "road"]
    rank = {r.id: r.text_relevance for r in s.cover_rank(s.hits_in_text(df, words, False), words).collect()}
    assert rank[3] > rank[1] > rank[2]


def test_stored_postings_give_the_same_search(spark, tmp_path):
    df, _ = make(spark)
    path = str(tmp_path / "postings")
    s.write_postings(s.postings(df), path, files=3)
    index = spark.read.parquet(path)
    request = s.SearchRequest(query="taxes and roads", query_vector=[1, 0, 0.5, 0])
    scanned = s.hybrid_search(df, request).page.collect()
    indexed = s.hybrid_search(df, request, index).page.collect()
    assert [(r.id, r.relevance) for r in scanned] == [(r.id, r.relevance) for r in indexed]
    plan = s.hits_in_postings(index, ["tax"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme" in plan or "EqualTo(lexeme,tax)" in plan


def test_pages_make_up_the_whole_result(spark):
    df, _ = make(spark)
    request = s.SearchRequest(query="tax road", query_vector=[1, 0, 0.5, 0], per_page=7)
    first = s.hybrid_search(df, request)
    total = first.total.first().total
    seen = []
    for page in range(1, total // 7 + 2):
        request.page = page
        seen += [r.id for r in s.hybrid_search(df, request).page.collect()]
    assert len(seen) == len(set(seen)) == total
    assert set(seen) == {r.id for r in first.matches.select("id").collect()}


def test_row_order_does_not_matter(spark):
    df, _ = make(spark)
    request = s.SearchRequest(query="tax road", query_vector=[1, 0, 0.5, 0])
    a = [r.id for r in s.hybrid_search(df, request).page.collect()]
    b = [r.id for r in s.hybrid_search(df.orderBy(F.rand(3)).repartition(5), request).page.collect()]
    assert a == b


def test_page_past_the_end_keeps_the_true_total(spark):
    df, _ = make(spark)
    result = s.hybrid_search(df, s.SearchRequest(page=99))
    assert result.page.count() == 0
    row = result.pagination().first()
    assert (row.total, row.pages, row.has_next, row.has_prev) == (48, 3, False, True)


def test_short_query_skips_vectors(spark):
    df, _ = make(spark)
    result = s.hybrid_search(df, s.SearchRequest(query="tax", query_vector=[1, 0, 0, 0]))
    ids = {r.id for r in result.matches.collect()}
    assert ids == {r.id for r in df.filter("status = 'COMPLETED' AND extracted_text RLIKE '\\\\btax\\\\b'").collect()}


def test_normalising(spark):
    df = spark.createDataFrame([(v,) for v in (0.48, 0.45, 0.42, 0.38, 0.35)], "relevance double")
    got = [r.relevance_text for r in s.normalise_page(df).orderBy(F.col("relevance").desc()).collect()]
    assert got == ["1.00", "0.77", "0.54", "0.23", "0.00"]
    flat = spark.createDataFrame([(0.5,), (0.5,)], "relevance double")
    assert [r.normalised for r in s.normalise_page(flat).collect()] == [0.5, 0.5]


def test_batch_equals_single(spark):
    df, _ = make(spark, 200)
    requests = {
        "a": s.SearchRequest(query="tax road", query_vector=[1, 0, 0.5, 0]),
        "b": s.SearchRequest(query="jobs", query_vector=[0, 1, 0, 0]),
    }
    rows = s.batch_search(df, requests, top=10).collect()
    for name, request in requests.items():
        request.per_page = 10
        single = s.hybrid_search(df, request).page.collect()
        batch = sorted((r.rank, r.id, r.relevance) for r in rows if r.query_id == name)
        assert [x[1] for x in batch] == [r.id for r in single]
        assert [x[2] for x in batch] == pytest.approx([r.relevance for r in single])


def test_batch_top_k_is_exact_over_many_partitions(spark):
    df, rows = make(spark, 500, seed=5)
    q = [0.3, -0.2, 0.9, 0.1]
    got = [r.id for r in s.vector_top_k_batch(df.repartition(9), {"q": q}, 25).orderBy("rank").collect()]
    sims = {
        r[0]: float(np.dot(np.float32(r[5]), q) / np.linalg.norm(np.float32(r[5])))
        for r in rows
        if r[5] is not None
    }
    want = sorted(sims, key=lambda i: (-round(sims[i], 9), i))[:25]
    assert got == want


# examples published with the algorithm
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "formality": "formal", "triplicate": "triplic", "formative": "form",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def test_stems():
    assert {w: stem_word(w) for w in STEMS} == STEMS


def test_distinct_words_of_a_batch_are_stemmed_once(spark, monkeypatch):
    lists = [["the", "taxes", "roads"], None, [], ["roads", "and", "roads", "sky"], ["the"]]
    asked, plain = [], lexemes.stem_word
    monkeypatch.setattr(lexemes, "stem_word", lambda w: asked.append(w) or plain(w))
    batch = pa.array([["cut", "off"], *lists], pa.list_(pa.string())).slice(1)
    got = lexemes.placed_stems(batch).to_pylist()
    assert sorted(asked) == ["and", "roads", "sky", "taxes", "the"]
    placed = [None if x is None else [{"lexeme": plain(w), "pos": i} for i, w in enumerate(x, 1) if w not in ("the", "and")] for x in lists]
    assert got == placed
    only = lexemes.placed_stems(batch, frozenset(["road"])).to_pylist()
    assert only == [None if x is None else [p for p in x if p["lexeme"] == "road"] for x in placed]
    assert lexemes.placed_stems(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_cheap_text_test_never_loses_a_match(spark):
    words = sorted({*STEMS, "probability", "nationality", "agencies", "organization", "skies", "dying"})
    for w in words:
        stem = stem_word(w)
        assert stem[:-2] in w
    df = spark.createDataFrame([(w.upper(),) for w in words], "v string")
    for w in words[:5]:
        hits = {r.v for r in df.filter(may_contain(F.col("v"), [stem_word(w)])).collect()}
        assert w.upper() in hits


def test_query_lexemes():
    assert query_lexemes("The Taxes, and the ROADS!") == ["tax", "road"]
    assert query_lexemes("the and") == []
