"""Stored indexes against the scans they replace."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions.text import contains_term
from foliary.operators import block_postings as bp
from foliary.operators import deep_pages as dp
from foliary.operators import deltas as dl
from foliary.operators import facet_bitmaps as fb
from foliary.operators import search as s
from foliary.operators import trigrams as tg
from foliary.operators import vector_index as vi
from foliary.session import new_folder


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- vectors ---------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows around forty centres, one of which holds a third; null, zero and repeated vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(3000):
        c = 0 if i % 3 == 0 else int(rng.integers(40))
        rows.append((i, [float(x) for x in centres[c] + 0.45 * rng.normal(size=16)]))
    rows += [(5000, None), (5001, [0.0] * 16), (5002, rows[7][1]), (5003, rows[7][1])]
    return spark.createDataFrame(rows, "id long, search_vector array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark, vectors):
    return vi.write_index(vectors, new_folder(spark, "vectors"))


def query_rows(vectors):
    asked = vectors.where("id % 50 = 0 AND id < 4000")
    return asked.select(F.col("id").alias("query_id"), F.col("search_vector").alias("vector"))


def test_all_lists_give_the_exact_answer(spark, vectors, index):
    for seed, k in ((1, 1), (2, 25), (3, 4000)):
        query = [float(x) for x in np.random.default_rng(seed).normal(size=16)]
        want = [r["id"] for r in s.vector_top_k(vectors.where("id <> 5001"), query, k).collect()]
        assert [r["id"] for r in vi.nearest(spark, index, query, k, len(index.centroids)).collect()] == want
    assert index.codes(spark).count() == 3002


def test_many_queries_equal_single_ones(spark, vectors, index):
    asked = query_rows(vectors)
    found = vi.nearest_of_many(index, asked, 7, 5).collect()
    for row in asked.limit(6).collect():
        own = sorted((r["rank"], r["id"]) for r in found if r["query_id"] == row["query_id"])
        single = vi.nearest(spark, index, row["vector"], 7, 5).collect()
        assert [i for _, i in own] == [r["id"] for r in single]


def test_recall_of_few_lists(spark, vectors, index):
    asked = query_rows(vectors)
    probes = vi.tuned_probes(index, vectors.where("search_vector IS NOT NULL AND id <> 5001").withColumnsRenamed({"id": "query_id", "search_vector": "vector"}), 10, 0.95)
    assert probes < len(index.centroids) / 2
    exact = vi.nearest_of_many(index, asked, 10, len(index.centroids))
    measured = vi.recall(vi.nearest_of_many(index, asked, 10, probes), exact).agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert measured >= 0.9


def test_only_probed_lists_are_read(spark, index):
    plan = plan_of(vi.nearest(spark, index, [1.0] * 16, 5, 3))
    filters = re.findall(r"PartitionFilters: \[(list#\d+ IN \(([\d,]+)\))", plan)
    wanted = set(vi.probed_lists(index, vi.unit_rows(np.ones((1, 16))), 3)[0].tolist())
    # the scan of the codes, the same scan under the threshold, and that of the vectors
    assert len(filters) >= 3 and all(set(map(int, lists.split(","))) == wanted for _, lists in filters)


def test_appended_rows_are_found(spark, vectors):
    index = vi.write_index(vectors.where("id % 2 = 0"), new_folder(spark, "vectors"), lists=12)
    before = set(index.codes(spark).inputFiles())
    vi.append_to_index(index, vectors.where("id % 2 <> 0"))
    opened = vi.open_index(spark, index.path)
    assert before < set(opened.codes(spark).inputFiles())
    query = [float(x) for x in np.random.default_rng(9).normal(size=16)]
    want = [r["id"] for r in s.vector_top_k(vectors.where("id <> 5001"), query, 30).collect()]
    assert [r["id"] for r in vi.nearest(spark, opened, query, 30, 12).collect()] == want


def test_an_index_of_one_row(spark):
    one = spark.createDataFrame([(1, [0.0, 2.0])], "id long, search_vector array<float>")
    index = vi.write_index(one, new_folder(spark, "vectors"))
    assert vi.nearest(spark, index, [1.0, 1.0], 5).first()["id"] == 1
    with pytest.raises(ValueError):
        vi.write_index(one.limit(0), new_folder(spark, "vectors"))


# --- substrings ------------------------------------------------------------


def test_substring_search_equals_the_scan(spark):
    r = random.Random(4)
    letters = "aAbB%_\\ é中x"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 14))), ["".join(r.choice("abc") for _ in range(5)), None]) for i in range(400)]
    rows += [(900, None, None), (901, "", []), (902, "ab" * 60_000 + "needle", ["needle"])]
    df = spark.createDataFrame(rows, "id long, name string, terms array<string>")
    fields = {"name": F.col("name"), "terms": F.col("terms")}
    path = new_folder(spark, "trigrams")
    tg.write_trigrams(df.where("id < 200"), fields, path)
    tg.write_trigrams(df.where("id >= 200"), fields, path, mode="append")
    terms = ["aBa", "ab", "", "a%b", "%_", "\\", "é中x", "needle", "nothing here", "cab"] + ["".join(r.choice("abB%_") for _ in range(4)) for _ in range(8)]
    for term in terms:
        for wildcards in (False, True):
            if wildcards and "\\" in term:
                continue
            got = sorted(x["id"] for x in tg.containing(df, path, fields, term, wildcards).collect())
            hit = contains_term(F.col("name"), term, wildcards)
            listed = F.exists("terms", lambda x: contains_term(x, term, wildcards))
            want = sorted(x["id"] for x in df.where(F.coalesce(hit, F.lit(False)) | F.coalesce(listed, F.lit(False))).collect())
            assert got == want, (term, wildcards)


def test_only_the_folders_of_the_term_are_read(spark):
    df = spark.createDataFrame([(i, f"name {i} of many words {i * i}") for i in range(300)], "id long, name string")
    path, fields = new_folder(spark, "trigrams"), {"name": F.col("name")}
    tg.write_trigrams(df, fields, path)
    found = tg.candidates(spark, path, ["name"], "e 17")
    plan = plan_of(found)
    assert "PartitionFilters: [folder" in plan and "In(gram, [" in plan
    assert tg.candidates(spark, path, ["name"], "17") is None
    ids = {r["id"] for r in found.collect()}
    assert ids >= {i for i in range(300) if str(i).startswith("17")} and len(ids) < 40


def test_an_index_row_holds_many_documents(spark):
    """Rows per trigram and batch, not per trigram and document; ids may repeat, and no trigram crosses two texts."""
    rows = [(i % 900, f"some words {i % 10}", ["ab", "cd", None, "x\U0001f600yz"]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, name string, terms array<string>").coalesce(1)
    path, fields = new_folder(spark, "trigrams"), {"name": F.col("name"), "terms": F.col("terms")}
    tg.write_trigrams(df, fields, path)
    stored = spark.read.parquet(path)
    assert stored.count() == len({f"some words {i}"[j : j + 3] for i in range(10) for j in range(10)}) + 2
    assert sorted(r["id"] for r in tg.containing(df, path, fields, "words 7").collect()) == sorted(i for i, n, _ in rows if "words 7" in n)
    assert tg.containing(df, path, fields, "\U0001f600YZ").count() == 1000
    assert tg.candidates(spark, path, ["terms"], "abcd").count() == 0


# --- ranked pages ----------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    """Documents with a few words; in some they are frequent."""
    r = random.Random(8)
    rows = []
    for i in range(600):
        often = 12 if i in (5, 17, 300, 301, 599) else 1
        words = [r.choice("abcdefghij") * 2 for _ in range(r.randint(0, 12))] + ["aa", "bb", "cc"] * r.choice([0, 0, often])
        r.shuffle(words)
        rows.append((i, "f.pdf", " ".join(words)))
    return spark.createDataFrame(rows, "id long, filename string, extracted_text string").cache()


def test_top_documents_equal_the_full_evaluation(spark, texts):
    words = s.postings(texts, stem=False)
    path = new_folder(spark, "blocks")
    bp.write_blocks(bp.blocks(words.where("id < 320"), 20), path)
    bp.write_blocks(bp.blocks(words.where("id >= 320"), 20), path, mode="append")
    index = spark.read.parquet(path)
    for lexemes in (["aa"], ["aa", "bb"], ["aa", "bb", "cc"], ["dd", "ee"], ["aa", "nothing"]):
        every = s.cover_rank(s.hits_in_text(texts, lexemes, stem=False), lexemes).collect()
        order = sorted(((round(-r["text_relevance"], 10), r["id"]) for r in every))
        bounds = {r["block"]: r["bound"] for r in bp.bounded_blocks(index, lexemes).collect()}
        assert all(bounds[r["id"] // 20] >= r["text_relevance"] - 1e-12 for r in every)
        for k in (1, 5, 40):
            got = bp.top_documents(index, lexemes, k, first_blocks=2).collect()
            assert [(round(-r["text_relevance"], 10), r["id"]) for r in got] == order[:k]
    some = spark.createDataFrame([(i,) for i in range(0, 600, 7)], "id long")
    got = [r["id"] for r in bp.top_documents(index, ["aa", "bb"], 5, some, first_blocks=2).collect()]
    every = s.cover_rank(s.hits_in_text(texts, ["aa", "bb"], stem=False), ["aa", "bb"]).join(some, "id").collect()
    assert got == [i for _, i in sorted((round(-r["text_relevance"], 10), r["id"]) for r in every)][:5]


def test_postings_are_dealt_once_for_blocks(spark, texts):
    """One exchange down to the stored files, and each block once, also where ids repeat."""
    rows = s.postings(texts, stem=False)
    made = bp.blocks(rows.unionByName(rows.where("id % 3 = 0")), 20)
    plan = made.sortWithinPartitions("lexeme", "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1
    path = new_folder(spark, "blocks")
    bp.write_blocks(made, path)
    want = {}
    for r in rows.collect():
        want.setdefault((r["lexeme"], r["id"] // 20), {}).setdefault(r["id"], []).extend([r["pos"]] * (2 if r["id"] % 3 == 0 else 1))
    got = spark.read.parquet(path).collect()
    assert len(got) == len(want)
    for r in got:
        documents = {d["id"]: list(d["positions"]) for d in r["documents"]}
        assert documents == {i: sorted(p) for i, p in want[r["lexeme"], r["block"]].items()}
        assert r["max_hits"] == max(map(len, documents.values()))


def test_blocks_that_cannot_reach_the_page_are_left_out(spark, texts):
    index = bp.blocks(s.postings(texts, stem=False), 20).cache()

    def read(lexemes):
        first = bp.promising(index, lexemes, 4)
        ranked = s.cover_rank(bp.hits_in_blocks(index, lexemes, first), lexemes)
        rest = bp.remaining(index, lexemes, first, bp._kth(ranked, "text_relevance", 3))
        return len(first) + rest.count(), bp.bounded_blocks(index, lexemes).count()

    some, every = read(["aa"])
    assert every == 30 and some < every / 2
    some, every = read(["aa", "bb", "cc"])
    assert every == 30 and some < every


# --- deep pages ------------------------------------------------------------


@pytest.mark.parametrize("descending", [True, False])
def test_pages_equal_slices_of_the_order(spark, descending):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(40)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, size long").repartition(6)
    known = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1] if descending else x[1], x[0]))
    order = [i for i, _ in known] + sorted(i for i, v in rows if v is None)
    for page in (1, 17, 50, 100, 101):
        got = dp.deep_page(df, "size", page, 10, descending, ranges=7).collect()
        assert [x["id"] for x in got] == order[(page - 1) * 10 : page * 10]
        assert [x["place"] for x in got] == list(range((page - 1) * 10 + 1, min(page * 10, 1000) + 1))
    seen, after = [], None
    while True:
        page = dp.page_after(df, "size", after, 130, descending).collect()
        if not page:
            break
        seen += [x["id"] for x in page]
        after = page[-1]["size"], page[-1]["id"]
    assert seen == order
    assert dp.deep_page(df.limit(0), "size", 1, 10).count() == 0


def test_a_deep_page_sorts_its_range_only(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 5000).alias("size"))
    stored, counts = dp.range_counts(df, "size", True, ranges=20)
    assert sum(n for _, n in counts) == 5000
    numbers, skipped = dp.ranges_of_page(counts, 4000, 4010)
    assert len(numbers) <= 2 and skipped <= 4000
    assert max(n for _, n in counts) < 1000


# --- upkeep by changes -----------------------------------------------------


def words_view(df):
    return s.postings(df, stem=False)


def count_view(df):
    return df.select("state")


def tables(spark):
    documents = dl.CatalogTable(new_folder(spark, "catalog"), 8)
    words = dl.SignedTable(new_folder(spark, "words"), ("lexeme", "id", "pos"), "lexeme", 8)
    counts = dl.SignedTable(new_folder(spark, "counts"), ("state",), "state", 4)
    return documents, words, counts


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_random_changes_equal_a_rebuild(spark):
    r = random.Random(6)
    schema = "id long, filename string, extracted_text string, state string"

    def row(i):
        text = r.choice([None, " ".join(r.choice("abcd") * 2 for _ in range(r.randint(0, 9)))])
        return i, f"f{i}.pdf", text, r.choice(["TX", "OH", None])

    documents, words, counts = tables(spark)
    views = [(words, words_view), (counts, count_view)]
    now = {i: row(i) for i in range(120)}
    dl.update(spark, documents, views, 0, spark.createDataFrame(list(now.values()), schema))
    for batch in range(1, 4):
        changed = {i: row(i) for i in r.sample(range(150), 12)}
        gone = [i for i in r.sample(range(170), 9) if i not in changed]
        upserts = spark.createDataFrame(list(changed.values()), schema)
        deleted = spark.createDataFrame([(i,) for i in gone], "id long")
        dl.update(spark, documents, views, batch, upserts, deleted)
        now = {i: x for i, x in {**now, **changed}.items() if i not in gone}
    rebuilt = spark.createDataFrame(list(now.values()), schema)
    assert rows_of(documents.current(spark)) == rows_of(rebuilt)
    assert rows_of(words.current(spark).where("n = 1").drop("n")) == rows_of(words_view(rebuilt).select("lexeme", "id", "pos"))
    assert words.current(spark).where("n <> 1").isEmpty()
    assert rows_of(counts.current(spark)) == rows_of(rebuilt.groupBy("state").agg(F.count("*").alias("n")))
    # the same batch again, and the tables written anew
    dl.update(spark, documents, views, 3, upserts, deleted)
    compact = counts.compacted(spark, new_folder(spark, "counts"))
    assert rows_of(compact.current(spark)) == rows_of(counts.current(spark)) == rows_of(rebuilt.groupBy("state").agg(F.count("*").alias("n")))
    assert rows_of(words.current(spark, ["aa", "zz"])) == rows_of(words.current(spark).where("lexeme IN ('aa', 'zz')"))


def test_work_follows_the_change(spark):
    schema = "id long, filename string, extracted_text string, state string"
    documents, words, counts = tables(spark)
    views = [(words, words_view), (counts, count_view)]
    first = [(i, f"f{i}", "same words in every text " * 5, "TX") for i in range(400)]
    dl.update(spark, documents, views, 0, spark.createDataFrame(first, schema))
    change = spark.createDataFrame([(3, "f3", "same words in every text " * 5 + "novel", "TX"), (9, "f9", "same words in every text " * 5, "OH")], schema)
    dl.update(spark, documents, views, 1, change)
    # one word was added and one state changed; nothing else was written
    assert [tuple(x) for x in words.stored(spark).where("batch = 1").select("lexeme", "id", "sign").collect()] == [("novel", 3, 1)]
    assert rows_of(counts.stored(spark).where("batch = 1").select("state", "sign")) == ["Row(state='OH', sign=1)", "Row(state='TX', sign=-1)"]
    plan = plan_of(words.current(spark, ["novel"]))
    assert "PartitionFilters" in plan and "bucket" in plan
    plan = plan_of(documents.current(spark, change))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan)


def lists_table(spark, buckets=8):
    return dl.SignedLists(new_folder(spark, "lists"), ("lexeme", "pos"), "lexeme", buckets)


def lists_view(df):
    return s.posting_lists(stem=False)


@pytest.mark.parametrize("most", [0, dl.MOST_IDS])
def test_signed_lists_equal_signed_rows(spark, monkeypatch, most):
    """Changes, deletions, ids that repeat or are null, and texts without words; many changed ids are not broadcast."""
    monkeypatch.setattr(dl, "MOST_IDS", most)
    r = random.Random(8)
    schema = "id long, filename string, extracted_text string"

    def row(i):
        return i, "", r.choice([None, "", " ".join(r.choice("abcd") * 2 for _ in range(r.randint(0, 9)))])

    documents, words, _ = tables(spark)
    lists = lists_table(spark)
    views = [(words, words_view), (lists, lists_view)]
    first = [row(i) for i in range(60)] + [(7, "", "xx yy xx")] * 2 + [(None, "", "no id")]
    dl.update(spark, documents, views, 0, spark.createDataFrame(first, schema))
    plain = ("lexeme", "id", "pos", "n")
    assert rows_of(lists.current(spark).select(*plain)) == rows_of(words.current(spark).select(*plain))
    for batch in (1, 2):
        changed = [row(i) for i in r.sample(range(80), 12)] + [(None, "", "no id here")]
        deleted = spark.createDataFrame([(i,) for i in r.sample(range(90), 6)], "id long")
        for _ in range(2):  # a repeated batch changes nothing
            dl.update(spark, documents, views, batch, spark.createDataFrame(changed, schema), deleted)
    signed = ("batch", "lexeme", "id", "pos", "sign")
    assert rows_of(lists.stored(spark).select(*signed)) == rows_of(words.stored(spark).select(*signed))
    current = rows_of(words.current(spark).select(*plain))
    assert rows_of(lists.current(spark).select(*plain)) == current
    assert rows_of(lists.compacted(spark, new_folder(spark, "lists")).current(spark).select(*plain)) == current
    assert rows_of(lists.current(spark, ["aa", "zz"])) == rows_of(lists.current(spark).where("lexeme IN ('aa', 'zz')"))
    read = plan_of(lists.stored(spark, ["aa"]))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", read)


def test_signed_lists_shuffle_no_single_rows(spark):
    """A change shuffles documents, and a read only the lists of documents that a later batch touched."""
    documents, lists = dl.CatalogTable(new_folder(spark, "catalog"), 8), lists_table(spark)
    first = spark.createDataFrame([(i, "", f"same words in text {i}") for i in range(300)], "id long, filename string, extracted_text string")
    dl.update(spark, documents, [(lists, lists_view)], 0, first)
    assert "Exchange" not in plan_of(lists.current(spark))
    dl.update(spark, documents, [(lists, lists_view)], 1, first.where("id = 5").withColumn("extracted_text", F.lit("same words")))
    current = lists.current(spark)
    plan = plan_of(current)
    assert plan.index("Exchange hashpartitioning(id") > plan.index("Generate explode") and "lexeme#" in plan
    assert current.where("id = 5").count() == 1 and current.where("id <> 5").groupBy("id").count().where("count <> 3").isEmpty()
    # nothing but the two words that went was written
    assert rows_of(lists.stored(spark).where("batch = 1").select("lexeme", "sign")) == ["Row(lexeme='5', sign=-1)", "Row(lexeme='text', sign=-1)"]


# --- facets by bitmaps -----------------------------------------------------


def test_bitmap_facets_equal_joined_ones(spark):
    r = random.Random(12)
    numbers = [r.randrange(200_000) for _ in range(500)] + [0, 1, 32_767, 32_768, 32_769, 65_536]
    links = [(d, r.randrange(9)) for d in numbers for _ in range(r.randint(0, 4))] + [(5, 1), (5, 1), (None, 2)]
    links += [(d, 50) for d in range(1000)]
    df = spark.createDataFrame(links, "document_id long, taxonomy_term_id long")
    path = new_folder(spark, "bitmaps")
    fb.write_bitmaps(df, path)
    stored = spark.read.parquet(path)
    for matching in ([], numbers[:3], numbers[::2], [7, 7, 999_999, None], sorted({d for d, _ in links if d is not None})):
        ids = spark.createDataFrame([(i,) for i in matching], "id long")
        got = {x["taxonomy_term_id"]: x["count"] for x in fb.facets(stored, ids).collect()}
        want = Counter(t for d, t in set(links) if d is not None and d in matching)
        assert got == dict(want)
