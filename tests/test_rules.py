"""Golden tables for the per-row rules."""

import datetime
import html
import re

import pytest
from pyspark.sql import functions as F

from foliary.functions import analysis as an
from foliary.functions import dates, names, payer, states
from foliary.functions import text as tx
from foliary.operators import entities, extraction
from foliary.plans import registry
from foliary.plans.derived import Tables

registry.load_all()


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v")).alias("x")).collect()]


def check(spark, rule, pairs):
    got = apply(spark, rule, [p[0] for p in pairs])
    assert got == [p[1] for p in pairs]


def test_ocr_cleanup(spark):
    check(
        spark,
        tx.clean_ocr_text,
        [
            (
                "**EVERY YEAR,\nMISSOURI\nPOLITICIANS\nREACH INTO OUR PURSE.**",
                "EVERY YEAR,\nMISSOURI\nPOLITICIANS\nREACH INTO OUR PURSE.",
            ),
            ("THAT WERE *ALREADY PAID FOR.*", "THAT WERE ALREADY PAID FOR."),
            ("Slug 03b.indd 1 " + "&nbsp;" * 90 + " 7/13/26 9:06 PM", "Slug 03b.indd 1 7/13/26 9:06 PM"),
            ("# AMENDMENT 5", "AMENDMENT 5"),
            ("Smith &amp; Jones for &quot;Missouri&quot;", 'Smith & Jones for "Missouri"'),
            ("file_name_with_underscores.docx stays", "file_name_with_underscores.docx stays"),
            ("_emphasis word_ at start.", "emphasis word at start."),
            ("5 * 3 = 15 is not italic", "5 * 3 = 15 is not italic"),
            ("", ""),
            (None, None),
            ("Line one.\nLine two.", "Line one.\nLine two."),
            ("**Vote Yes**\n\nfile.indd 1 " + "&nbsp;" * 20 + " 9:06 PM", "Vote Yes\n\nfile.indd 1 9:06 PM"),
        ],
    )


def test_title_case(spark):
    values = ["o'brien 97th st-louis", "JOHN  mcDONALD", "été ÉTÉ", "", "a1b2c"]
    check(spark, tx.title_case, [(v, v.title()) for v in values])


def test_compound_names(spark):
    check(
        spark,
        tx.repair_compound_names,
        [("Ann Mcdonald", "Ann McDonald"), ("Macarthur O'brien", "MacArthur O'Brien"), ("Plain", "Plain")],
    )


def test_file_names(spark):
    check(spark, tx.safe_file_name, [("a/b/c..d:e.pdf", "c_d_e.pdf"), ("x?*.txt", "x__.txt"), ("dir/", None)])
    check(spark, tx.file_type, [("A.PDF", "pdf"), ("b.jpeg", "image"), ("c", "unknown"), ("d.docx", "document"), (".pdf", "unknown")])
    check(spark, tx.preview_path, [("x/y.z.pdf", "/previews/y.z_preview.png"), ("", None), (None, None)])


def test_query_guard(spark):
    check(
        spark,
        tx.query_reject_reason,
        [("taxes", None), ("drop it", "invalid characters"), ("x" * 501, "too long"), ("selection", "invalid characters")],
    )


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Ohio Republican Party, Jane Timken, Chairman", "Ohio Republican Party"),
        ("Freedom Fund. Registered Agent: Kate Kennedy", "Freedom Fund"),
        ("Good Guys, JON ANDERSON, REGISTERED AGENT. NOT AUTHORIZED BY ANY CANDIDATE", "Good Guys"),
        ("Julia Palzer For Midtown | 1325 S. 36th", "Julia Palzer For Midtown"),
        ("Ann Lee and", "Ann Lee"),
    ],
)
def test_payer_name(spark, raw, want):
    check(spark, payer.payer_name, [(raw, want)])


def test_committee_to_person(spark):
    check(
        spark,
        payer.committee_to_person,
        [
            ("Committee to Re-Elect Ann Lee", "Ann Lee"),
            ("Friends of Joe Hill", "Joe Hill"),
            ("Joe Hill for Iberia Parish Sheriff", "Joe Hill"),
            ("Sam Cole for Texas", "Sam Cole"),
            ("Sam Cole (R)", "Sam Cole"),
            ("Citizens for Truth", None),
            ("Bice", None),
        ],
    )


def test_names_in_body(spark):
    texts = [
        ("Vote Heather Moreno for Mayor", "Heather Moreno", "HIGH"),
        ("VOTE CRAIG TIPPING FOR JUDGE", "Craig Tipping", "HIGH"),
        ("JANE PALMER x JANE PALMER", "Jane Palmer", "HIGH"),
        ("JANE PALMER once", "Jane Palmer", "MEDIUM"),
        ("we like Julia Palzer for Mayor", "Julia Palzer", "MEDIUM"),
        ("see JenForCongress.com", "Jen", "LOW"),
        ("nothing at all", None, None),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, extracted_text string")
    rows = extraction.find_names(df).orderBy("id").collect()
    got = [((r.body_name.name, r.body_name.confidence) if r.body_name else (None, None)) for r in rows]
    assert got == [t[1:] for t in texts]


def extract(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, extracted_text string")
    return extraction.extract_fields(df).orderBy("id").collect()


def test_date_scores(spark):
    rows = extract(
        spark,
        [
            "x.indd 1 3/4/24 3:04 PM",  # 3 + 2 + 1
            "stamp 13/4/2024 15:04",  # day first
            "sent on 3/4/24 3:04",  # connector
            "source 3/4/24 3:04",  # citation
            "3/4/24 3:04 then x.indd 5/6/23 4:05",  # the later one is better
            "3/4/24 3:04 and 5/6/23 4:05",  # tie: the first
            "y.indd 45/45/24 3:04",  # no such day
            "no date",
        ],
    )
    got = [(r.predicted_date, r.date_confidence) for r in rows]
    d = datetime.date
    assert got == [
        (d(2024, 3, 4), "HIGH"),
        (d(2024, 4, 13), "MEDIUM"),
        (None, "LOW"),
        (None, "LOW"),
        (d(2023, 5, 6), "HIGH"),
        (d(2024, 3, 4), "MEDIUM"),
        (None, "LOW"),
        (None, None),
    ]


def test_dates_close_together_keep_their_own_context(spark):
    df = spark.createDataFrame(
        [(1, "a 1/2/24 3:04 b 1/2/24 3:04 \U0001f600 5/6/24 7:08")], "id int, extracted_text string"
    )
    rows = extraction.date_candidates(df).orderBy("position").collect()
    text = "a 1/2/24 3:04 b 1/2/24 3:04 \U0001f600 5/6/24 7:08"
    assert [r.position for r in rows] == [2, 16, text.index("5/6")]
    assert [r.score for r in rows] == [3, 3, 2]


def test_states(spark):
    rows = extract(
        spark,
        [
            "STATE ASSEMBLY 12 in Texas",
            "Paid for by X\n1 Main St, Austin, TX 78701",
            "Paid for by X\nBox 1, Ohio",
            "West Virginia Senate",
            "nothing for Texas here",
            "Ohio and Ohio and Texas",
            "plain",
            "Ohio once",
        ],
    )
    # without a payer line the whole text is the address block
    assert [(r.predicted_state, r.state_confidence) for r in rows] == [
        ("CA", "HIGH"),
        ("TX", "HIGH"),
        ("OH", "MEDIUM"),
        ("WV", "MEDIUM"),
        ("TX", "MEDIUM"),
        ("OH", "MEDIUM"),
        (None, None),
        ("OH", "MEDIUM"),
    ]
    filler = "." * 700
    rows = extract(
        spark,
        [
            f"Paid for by X {filler} West Virginia Senate",
            f"Paid for by X {filler} Ohio, Texas and ohio",
            f"Paid for by X {filler} Ohio",
        ],
    )
    assert [(r.predicted_state, r.state_confidence) for r in rows] == [
        ("VA", "MEDIUM"),
        ("OH", "LOW"),
        (None, None),
    ]


def test_payer_block_window(spark):
    near = "Paid for by X" + "a" * 200 + "\n\n" + "b" * 900
    close = "Paid for by X\n\n" + "b" * 900
    check(
        spark,
        states.payer_block,
        [("zz " + near, near[:213]), (close, close[:600]), ("none", "none")],
    )


def test_review_score(spark):
    rows = extract(spark, ["x.indd 3/4/24 3:04 PM\nPaid for by Friends of Ann Lee\nAustin, TX 78701", "Ann"])
    assert [r.needs_review for r in rows] == [False, True]


def test_clean_client(spark):
    check(
        spark,
        names.clean_client,
        [
            ("  the  GOOD  party\n of ohio.", "Good Party Of Ohio"),
            ("Smith❤️ & Sons,", "Smith & Sons"),
            ("Committee To", None),
            ("Single", None),
            ("Not authorized by anyone", None),
            ("insight what now", None),
            ("no\non prop 5", None),
        ],
    )


def test_canonical_rules(spark):
    check(
        spark,
        names.canonical_rules,
        [
            ("Republican Party Of Texas", "Texas Republican Party"),
            ("Texas Gop", "Texas Republican Party"),
            ("The Nebraska Republican", "Nebraska Republican Party"),
            ("Nebraskan Republican Party", "Nebraska Republican Party"),
            ("Republican Party Of Ia", "Iowa Republican Party"),
            ("Alex Mealer For Judge", "Alex Mealer"),
            ("Bice For Congress", "Bice"),
            ("Cheryl Bean For Texas 97Th", "Cheryl Bean"),
            ("Missouri Senate Campaign Committee - Ron Richard", "Missouri Senate Campaign Committee"),
            ("Plain Name", None),
        ],
    )


def test_party_rule_at_merge_loses_final_n(spark):
    check(
        spark,
        names.party_rule_at_merge,
        [("Texas Republican Party", "Texas Republican Party"), ("Michigan Republican Party", None)],
    )


def test_found_names(spark):
    check(
        spark,
        names.clean_found_name,
        [
            ("Luis Terrazas For New Mexico", "Luis Terrazas"),
            ("Assemblywoman  ann LEE'", "Ann Lee"),
            ("Joe Hill of Clackamas County", "Joe Hill"),
            ("Ann Lee and Joe", "Ann Lee"),
        ],
    )


def test_names_from_summary(spark):
    texts = [
        ('{"summary": "A flyer supporting John Duarte for Congress."}', ("John Duarte", "HIGH", "tier2_summary")),
        ('{"summary": "A mailer from McSally attacking Mark Kelly"}', (None, None, "no_match")),
        ('{"summary": "Mailer sponsored by Good People Now."}', ("Good People Now", "MEDIUM", "tier3_attack")),
        ("{broken", (None, None, "parse_error")),
        ("NULL", (None, None, None)),
        (
            '{"keyword_mappings": [{"verbatim_term": "Ann Lee", "mapped_primary_category": "Candidate & Entity Identifiers",'
            '"mapped_subcategory": "Candidate Elements", "mapped_canonical_term": "Name (Exact)"}]}',
            ("Ann Lee", "HIGH", "tier1_keyword"),
        ),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, ai_analysis string")
    rows = entities.clients_from_analysis(df).orderBy("id").collect()
    assert [(r.client_from_ai, r.ai_confidence, r.source_tier) for r in rows] == [t[1] for t in texts]


def test_similarity(spark):
    df = spark.createDataFrame(
        [("Daniel Cameron", "Daniel W Cameron"), ("California Republican Party", "CA Republican Party"), ("", "x")],
        "a string, b string",
    )
    got = [r[0] for r in df.select(names.token_jaccard(F.lower("a"), F.lower("b"))).collect()]
    assert got == pytest.approx([2 / 3, 0.5, 0.0])


def test_recover_json(spark):
    got = apply(spark, an.recover_json, ['x ```json\n{"a": 1}\n``` y', 'pre {"b": {"c": 2}} post', "none", "{bad}"])
    assert got == ['{"a": 1}', '{"b": {"c": 2}}', None, None]


def test_upgrade_and_malformed(spark):
    texts = ['{"document_analysis": {"summary": "old"}}', '{"schema_version": 1, "summary": "new"}', "[1]", '{"summary": {"x": 1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").orderBy("i")
    a = an.upgrade_analysis(an.parse_analysis(F.col("v")))
    rows = df.select(a["summary"].alias("s"), a["prompt_version"].alias("p")).collect()
    assert [r.s for r in rows][:3] == ["old", "new", None]
    assert all(r.p is None for r in rows)


def test_modular_normalising(spark):
    text = '{"metadata": {"document_analysis": {"document_type": "Card"}}, "classification": {"category": "x"}}'
    df = spark.createDataFrame([(text,)], "v string")
    n = an.normalise_analysis(an.parse_analysis(F.col("v")), modular=True)["document_analysis"]
    row = df.select(n.alias("d")).first().d
    assert (row.summary, row.document_type, row.document_tone) == ("No summary available", "Card", "neutral")


def test_checked_date(spark):
    df = spark.sql("SELECT DATE '2018-12-31' AS d UNION ALL SELECT DATE '2019-01-01' UNION ALL SELECT NULL")
    rows = df.select(dates.checked_date(F.col("d")).alias("c")).collect()
    assert sorted((str(r.c.date_created), r.c.needs_date_review) for r in rows) == [
        ("2019-01-01", False), ("None", False), ("None", True),
    ]


def plain_clean_ocr_text(text):
    if not text:
        return text
    text = html.unescape(text)
    for pattern in (r"\*\*(.+?)\*\*", r"__(.+?)__", r"\*(.+?)\*", r"(?<!\w)_(.+?)_(?!\w)"):
        text = re.sub(pattern, r"\1", text, flags=re.DOTALL)
    text = re.sub(r"(?m)^#{1,6}\s+", "", text)
    return re.sub("[ \t\u00a0]{2,}", " ", text).strip()


def test_ocr_cleanup_of_every_document(spark, tmp_path):
    texts = [
        None, "", "plain", "**a\nb** &amp; __c__", "# Head\n## Two *it* _em_ a_b_c", "x &nbsp;&nbsp; y &lt;b&gt;", "5 * 3 # 4 & 5",
        "_é_ é_x_é &copy;", "&amp;amp; **", "*a* *b\nc* ***d***", "###### six\n####### seven", " \t\u00a0 ",
    ]
    path = str(tmp_path / "documents.parquet")
    rows = [(i, text) for i, text in enumerate(texts)]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rest = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in ("doc_id", "text")]
    own = spark.createDataFrame(rows, "doc_id long, text string").select("*", *rest).select(table.columns)
    marked = table.where("doc_id > 100")
    own.unionByName(marked).write.parquet(path)
    got = {r["id"]: r["cleaned"] for r in registry.QUERIES["F01_clean_ocr_documents"](spark, str(tmp_path)).collect()}
    want = rows + [(r["doc_id"], r["text"]) for r in marked.collect()]
    assert got == {i: plain_clean_ocr_text(text) for i, text in want}


def test_token_similarity_of_every_payer(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    clean = {r["id"]: r["true_clean"] for r in tables.payers.collect()}
    got = {r["id"]: r["similarity"] for r in registry.QUERIES["F23_token_similarity_all"](spark, tables.folder).collect()}
    some = {r["id"]: r["similarity"] for r in registry.QUERIES["F23_token_similarity"](spark, tables.folder).collect()}
    assert None in clean.values() and got == {i: some[i] if name is not None else 0.0 for i, name in clean.items()}
