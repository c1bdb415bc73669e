"""Registered queries: field extraction and client names."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import names as nm
from foliary.functions import payer, states
from foliary.functions import text as tx
from foliary.operators import entities as e
from foliary.operators import extraction as x
from foliary.plans.derived import Tables
from foliary.plans.registry import query

# --- field extraction from generated mail with known truth -----------------


@query(
    "F02_date_candidates",
    """WITH c AS (SELECT id, extracted_text AS s, true_date, concat(CAST(month(true_date) AS VARCHAR),'/',CAST(day(true_date) AS VARCHAR),'/',CAST(year(true_date)%100 AS VARCHAR),' 3:04 PM') AS stamp FROM mailers)
    SELECT id, strpos(s, stamp) - 1 AS position, stamp FROM c""",
)
def date_candidates(t: Tables):
    return x.date_candidates(t.mailers.select("id", "extracted_text")).drop("score")


@query(
    "F03_date_scores",
    """WITH c AS (SELECT id, v, true_date, strpos(extracted_text, ' 1:00 AM') AS one FROM mixed_mailers)
    SELECT id, CAST(CASE v WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 6 THEN 3 END AS BIGINT) AS score, CAST(1 AS BIGINT) AS n FROM c WHERE v IN (0,1,2,6)
    UNION ALL SELECT id, 4, 2 FROM c WHERE v=4""",
)
def date_scores(t: Tables):
    scored = x.date_candidates(t.mixed_mailers.select("id", "extracted_text"))
    return scored.groupBy("id", "score").agg(F.count("*").alias("n"))


@query(
    "F04_document_date",
    """SELECT id, CAST(true_date AS VARCHAR) AS predicted_date, true_date_confidence AS date_confidence FROM mailers
    UNION ALL SELECT -1 - id, CAST(true_date AS VARCHAR), true_date_confidence FROM mixed_mailers""",
)
def document_date(t: Tables):
    plain = t.mailers.select("id", "extracted_text")
    mixed = t.mixed_mailers.select((-1 - F.col("id")).alias("id"), "extracted_text")
    dated = x.extract_dates(plain.unionByName(mixed))
    return dated.select("id", "predicted_date", "date_confidence")


@query(
    "F05_payer_line",
    """SELECT id, CASE WHEN true_frank THEN 'official funds authorized by the House of Representatives' ELSE concat('Friends of ', true_client) END AS paid_for_by_raw FROM mailers
    UNION ALL SELECT -1 - id, true_payer FROM mixed_mailers""",
)
def payer_line(t: Tables):
    plain = t.mailers.select("id", "extracted_text")
    mixed = t.mixed_mailers.select((-1 - F.col("id")).alias("id"), "extracted_text")
    return x.extract_payers(plain.unionByName(mixed)).select("id", "paid_for_by_raw")


@query("F06_franked", "SELECT id, true_frank AS is_frank FROM mailers")
def franked(t: Tables):
    return x.extract_payers(t.mailers.select("id", "extracted_text")).select("id", "is_frank")


@query(
    "F07_committee_to_person",
    """SELECT id, CASE v WHEN 0 THEN person WHEN 1 THEN person WHEN 6 THEN person WHEN 7 THEN person END AS person FROM
    (SELECT id, v, CASE id%3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Joe Hill' ELSE 'Sam Cole' END AS person FROM mixed_mailers)""",
)
def committee_to_person(t: Tables):
    paid = x.extract_payers(t.mixed_mailers.select("id", "extracted_text"))
    return paid.select("id", payer.committee_to_person(F.col("paid_for_by_raw")).alias("person"))


@query(
    "F08_name_in_body",
    """SELECT id, true_client AS name, 'HIGH' AS confidence FROM mailers
    UNION ALL SELECT -1 - id, CASE WHEN v IN (2,3,4,5) THEN true_client END, CASE WHEN v IN (2,3,4,5) THEN true_client_confidence END FROM mixed_mailers""",
)
def name_in_body(t: Tables):
    plain = t.mailers.select("id", "extracted_text")
    # the other mailers name a person in the payer's line only
    mixed = t.mixed_mailers.select((-1 - F.col("id")).alias("id"), "extracted_text")
    found = x.find_names(plain.unionByName(mixed))
    return found.select("id", "body_name.name", "body_name.confidence")


@query(
    "F09_client_decision",
    """SELECT id, true_client AS predicted_candidate, true_client_confidence AS candidate_confidence FROM mailers
    UNION ALL SELECT -1 - id, true_client, true_client_confidence FROM mixed_mailers""",
)
def client_decision(t: Tables):
    plain = t.mailers.select("id", "extracted_text")
    mixed = t.mixed_mailers.select((-1 - F.col("id")).alias("id"), "extracted_text")
    found = x.extract_clients(plain.unionByName(mixed))
    return found.select("id", "predicted_candidate", "candidate_confidence")


@query(
    "F10_document_state",
    """SELECT id, true_state AS predicted_state, true_state_confidence AS state_confidence FROM mailers
    UNION ALL SELECT -1 - id, true_state, true_state_confidence FROM mixed_mailers""",
)
def document_state(t: Tables):
    plain = t.mailers.select("id", "extracted_text")
    mixed = t.mixed_mailers.select((-1 - F.col("id")).alias("id"), "extracted_text")
    found = x.extract_states(plain.unionByName(mixed))
    return found.select("id", "predicted_state", "state_confidence")


@query(
    "F10_state_mentions",
    """SELECT doc_id AS id, concat('We love ', CASE doc_id%3 WHEN 0 THEN 'Ohio, ohio and Texas' WHEN 1 THEN 'West Virginia' ELSE 'New York' END) AS line,
    CASE doc_id%3 WHEN 0 THEN 'OH' END AS state FROM documents""",
)
def state_mentions(t: Tables):
    n = F.col("doc_id") % 3
    line = F.concat(
        F.lit("We love "),
        F.when(n == 0, "Ohio, ohio and Texas").when(n == 1, "West Virginia").otherwise("New York"),
    )
    told = t.documents.select(F.col("doc_id").alias("id"), line.alias("line"))
    named = told.withColumn("names", states.spelled_states(F.col("line")))
    return named.select("id", "line", states.most_frequent_state(F.col("names")).alias("state"))


@query(
    "F11_payer_block",
    """SELECT id, CASE WHEN strpos(lower(extracted_text),'paid for by') > 0 THEN substring(extracted_text, strpos(lower(extracted_text),'paid for by'), 600) ELSE extracted_text END AS block FROM mixed_mailers""",
)
def payer_block(t: Tables):
    return t.mixed_mailers.select("id", states.payer_block(F.col("extracted_text")).alias("block"))


@query("F12_needs_review", "SELECT id, true_needs_review AS needs_review FROM mailers")
def needs_review(t: Tables):
    return x.extract_fields(t.mailers.select("id", "extracted_text")).select("id", "needs_review")


@query(
    "F13_checked_date",
    """SELECT o_orderkey AS id, CASE WHEN year(o_orderdate)+21 BETWEEN 2019 AND 2026 THEN CAST(CAST(o_orderdate + INTERVAL '21' YEAR AS DATE) AS VARCHAR) END AS date_created,
    NOT (year(o_orderdate)+21 BETWEEN 2019 AND 2026) AS needs_date_review FROM orders""",
)
def checked_date(t: Tables):
    from foliary.functions.dates import checked_date as check

    dated = t.orders.select(
        F.col("o_orderkey").alias("id"),
        check(F.add_months(F.to_date("o_orderdate"), 12 * 21)).alias("d"),
    )
    return dated.select("id", "d.date_created", "d.needs_date_review")


@query(
    "S03_prediction_rows",
    """SELECT id, CAST(true_date AS VARCHAR) AS date_created, true_date_confidence AS date_confidence, true_client AS client, true_client_confidence AS client_confidence,
    CASE WHEN true_frank THEN 'official funds authorized by the House of Representatives' ELSE concat('Friends of ', true_client) END AS paid_for_by_raw, true_frank AS is_frank,
    true_state AS state, true_state_confidence AS state_confidence, true_needs_review AS needs_review, concat('m', id, '.pdf') AS filename FROM mailers""",
)
def prediction_rows(t: Tables):
    from foliary.sources.tables import prediction_columns

    mail = t.mailers.select(
        "id", F.concat(F.lit("m"), "id", F.lit(".pdf")).alias("filename"), "extracted_text"
    )
    return prediction_columns(x.extract_fields(mail))


@query(
    "A35_review_report",
    "SELECT count(*) AS total, count(*) FILTER (WHERE true_needs_review) AS flagged FROM mailers",
)
def review_report(t: Tables):
    return e.review_report(x.extract_fields(t.mailers.select("id", "extracted_text")))


@query("F12_fields_of_documents")
def fields_of_documents(t: Tables):
    """All fields of the given document texts, counted per outcome."""
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("extracted_text"))
    return x.extract_fields(docs).groupBy("state_confidence", "candidate_confidence", "needs_review").agg(
        F.count("*").alias("n")
    )


# --- client names ----------------------------------------------------------


def _payers(t: Tables):
    return t.payers.select("id", F.col("raw").alias("client"))


@query("F14_clean_client", "SELECT id, true_clean AS client_clean_v1, true_clean IS NULL AS flagged_garbage FROM payers")
def clean_client(t: Tables):
    return e.clean_clients(_payers(t)).drop("client")


@query(
    "S05_client_template",
    "SELECT true_clean AS client_clean_v1, count(*) AS count, '' AS client_canonical FROM payers WHERE true_clean IS NOT NULL GROUP BY 1",
)
def client_template(t: Tables):
    return e.client_template(e.clean_clients(_payers(t)))


@query(
    "F15_party_rule",
    "SELECT id, CASE WHEN v IN (2,3) THEN true_canonical END AS party FROM (SELECT *, id%9 AS v FROM payers)",
)
def party_rule(t: Tables):
    return t.payers.select("id", nm.party_rule(F.col("true_clean")).alias("party"))


@query(
    "F16_office_rule",
    "SELECT id, CASE WHEN v=1 THEN true_canonical END AS person, CASE WHEN v=5 THEN true_canonical END AS committee FROM (SELECT *, id%9 AS v FROM payers)",
)
def office_rule(t: Tables):
    n = F.col("true_clean")
    return t.payers.select(
        "id",
        F.when(nm.party_rule(n).isNull() & nm.committee_rule(n).isNull(), nm.office_rule(n)).alias("person"),
        nm.committee_rule(n).alias("committee"),
    )


@query(
    "F17_canonical_resolution",
    "SELECT id, true_canonical AS client_canonical, true_source AS resolution_source FROM payers",
)
def canonical_resolution(t: Tables):
    cleaned = e.clean_clients(_payers(t))
    return e.resolve_clients(cleaned, e.override_table(t.canonical_overrides)).select(
        "id", "client_canonical", "resolution_source"
    )


@query(
    "J06_override_lookup",
    """SELECT c.id, coalesce(o.client_canonical, c.client) AS client_canonical, CASE WHEN o.client_canonical IS NOT NULL THEN 'manual' ELSE 'passthrough' END AS resolution_source
    FROM catalog c LEFT JOIN canonical_overrides o ON lower(o.client_clean_v1)=lower(c.client)""",
)
def override_lookup(t: Tables):
    overrides = e.override_table(t.canonical_overrides)
    return e.resolve_clients(t.catalog("id", "client"), overrides, "client").select(
        "id", "client_canonical", "resolution_source"
    )


@query(
    "S06_override_table",
    "SELECT lower(client_clean_v1) AS key, max(client_canonical) AS override FROM canonical_overrides GROUP BY 1",
)
def override_table(t: Tables):
    return e.override_table(t.canonical_overrides)


@query(
    "F20_title_case",
    """SELECT id, CASE v WHEN 8 THEN concat(cap2, ' O''Brien 97Th') ELSE cap2 END AS titled FROM
    (SELECT id, id%9 AS v, concat(upper(a[1]), a[2:], ' ', upper(b[1]), b[2:]) AS cap2 FROM (SELECT d.doc_id AS id, split_part(p_name,' ',1) AS a, split_part(p_name,' ',2) AS b FROM documents d JOIN part ON p_partkey=doc_id%(SELECT count(*) FROM part)))""",
)
def title_case(t: Tables):
    named = t.sql(
        "SELECT d.doc_id AS id, p.p_name FROM (SELECT doc_id, doc_id%(SELECT count(*) FROM {part}) AS join_key FROM {documents}) d "
        "JOIN {part} p ON p.p_partkey=d.join_key"
    )
    raw = F.when(F.col("id") % 9 == 8, F.concat("p_name", F.lit(" o'BRIEN 97th"))).otherwise(
        F.upper("p_name")
    )
    return named.select("id", tx.title_case(raw).alias("titled"))


_TRUE_PERSON = (
    "concat(CASE doc_id%5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Joe' WHEN 2 THEN 'Maria' WHEN 3 THEN 'Sam' ELSE 'Lena' END,' ',"
    "CASE doc_id%7 WHEN 0 THEN 'Lee' WHEN 1 THEN 'Hill' WHEN 2 THEN 'Cole' WHEN 3 THEN 'Moreno' WHEN 4 THEN 'Tipping' WHEN 5 THEN 'Reyes' ELSE 'Park' END)"
)
# analysis shapes of the catalog: no JSON, error, nested, flat (see derived.py)
_AI_SQL = f"""SELECT doc_id AS id, CASE WHEN flat AND v IN (2,4,8,10,11,5) THEN person END AS client_from_ai,
    CASE WHEN flat THEN CASE WHEN v IN (2,10,11) THEN 'HIGH' WHEN v IN (4,8,5) THEN 'MEDIUM' END END AS ai_confidence,
    CASE WHEN has THEN CASE WHEN flat AND v IN (2,4,8,10,11) THEN 'tier2_summary' WHEN flat AND v=5 THEN 'tier3_attack' ELSE 'no_match' END END AS source_tier
    FROM (SELECT doc_id, doc_id%12 AS v, doc_id%23<>0 AS has, doc_id%23<>0 AND doc_id%29<>0 AND doc_id%3<>0 AS flat, {_TRUE_PERSON} AS person FROM documents)"""


@query("F19_client_from_analysis", _AI_SQL)
def client_from_analysis(t: Tables):
    return e.clients_from_analysis(t.catalog("id", "ai_analysis")).select(
        "id", "client_from_ai", "ai_confidence", "source_tier"
    )


@query(
    "A35_tier_counts",
    f"SELECT coalesce(source_tier,'no_match') AS source_tier, count(*) AS count FROM ({_AI_SQL}) GROUP BY 1",
)
def tier_counts(t: Tables):
    return e.count_by(e.clients_from_analysis(t.catalog("id", "ai_analysis")), "source_tier", "no_match")


@query(
    "F18_clean_found_name",
    f"SELECT doc_id AS id, {_TRUE_PERSON} AS name FROM documents",
)
def clean_found_name(t: Tables):
    n = F.col("id")
    person = F.regexp_extract("search", "^(.*)$", 1)
    base = t.sql(
        f"SELECT doc_id AS id, {_TRUE_PERSON} AS search FROM {{documents}}"
    )
    raw = (
        F.when(n % 4 == 0, F.concat(F.lit("Senator  "), F.upper(person), F.lit("'")))
        .when(n % 4 == 1, F.concat(person, F.lit(" For New Mexico")))
        .when(n % 4 == 2, F.concat(F.lower(person), F.lit(" of Clackamas County")))
        .otherwise(F.concat(F.lit("lt. governor "), person, F.lit(",")))
    )
    return base.select("id", nm.clean_found_name(raw).alias("name"))


@query(
    "J07_joined_predictions",
    """SELECT c.id, c.client, CASE c.id%3 WHEN 0 THEN concat('Ann ',c.client) WHEN 1 THEN 'Joe Hill' END AS client_from_ai,
    CASE c.id%3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS ai_confidence FROM catalog c""",
)
def joined_predictions(t: Tables):
    predictions = t.catalog("id", "client")
    return e.join_predictions(predictions, _ai_extract(t)).drop("source_tier")


def _ai_extract(t: Tables):
    k = F.col("id") % 3
    return (
        t.catalog("id", "client")
        .filter(k < 2)
        .select(
            "id",
            F.when(k == 0, F.concat(F.lit("Ann "), "client")).otherwise("Joe Hill").alias("client_from_ai"),
            F.when(k == 0, "HIGH").otherwise("MEDIUM").alias("ai_confidence"),
            F.when(k == 0, "tier1_keyword").otherwise("tier2_summary").alias("source_tier"),
        )
    )


@query(
    "F22_merged_clients",
    """SELECT id, CASE WHEN k=0 THEN concat('Mayor ', true_clean) WHEN k=1 THEN 'joe mcdonald' END AS client_from_ai,
    CASE WHEN v IN (2,3) THEN true_canonical WHEN true_clean IS NOT NULL THEN true_clean WHEN k=1 THEN 'Joe McDonald' END AS client_canonical,
    CASE WHEN k=0 THEN 'ai_tier1_keyword' WHEN k=1 AND true_clean IS NOT NULL THEN 'clean_v1_over_ai_medium' WHEN true_clean IS NOT NULL THEN 'clean_v1_fallback' WHEN k=1 THEN 'ai_tier2_summary_medium' ELSE 'null' END AS canonical_source
    FROM (SELECT id, id%3 AS k, id%9 AS v, true_clean, true_canonical FROM payers)""",
)
def merged_clients(t: Tables):
    k = F.col("id") % 3
    rows = t.payers
    predictions = rows.select(
        "id",
        F.lit("f.pdf").alias("filename"),
        F.lit("").alias("client"),
        F.col("true_clean").alias("client_clean_v1"),
    )
    found = rows.filter(k < 2).select(
        "id",
        F.when(k == 0, F.concat(F.lit("Mayor "), "true_clean")).otherwise("joe mcdonald").alias("client_from_ai"),
        F.when(k == 0, "HIGH").otherwise("MEDIUM").alias("ai_confidence"),
        F.when(k == 0, "tier1_keyword").otherwise("tier2_summary").alias("source_tier"),
    )
    return e.merge_clients(predictions, found).select(
        "id", "client_from_ai", "client_canonical", "canonical_source"
    )


@query(
    "F22_agreement_merge",
    """SELECT id, CASE WHEN true_clean IS NULL THEN 'Kim Novak' WHEN id%9 IN (2,3) THEN true_canonical ELSE true_clean END AS client_canonical,
    CASE WHEN true_clean IS NULL THEN 'ai_tier2_summary_medium' WHEN id%9=1 AND 2.0*length(true_canonical)/(length(true_canonical)+length(true_clean)) <= 0.85 THEN 'clean_v1_over_ai_medium'
    ELSE 'agreement_boost' END AS canonical_source FROM payers""",
)
def agreement_merge(t: Tables):
    n = F.col("true_clean")
    # the office after a name is no part of the name found by the model: too far from the clean one
    rows = t.payers.select(
        "id",
        n.alias("resolved"),
        # one letter more than the clean name
        F.coalesce(F.when(F.col("id") % 9 == 6, F.concat(n, F.lit("s"))).otherwise(n), F.lit("Kim Novak")).alias("client_from_ai"),
        F.lit("MEDIUM").alias("ai_confidence"),
        F.lit("tier2_summary").alias("source_tier"),
    )
    return e.merge_with_agreement(rows).select("id", "client_canonical", "canonical_source")


@query(
    "F21_clean_ai_name",
    "SELECT id, CASE WHEN id%9 IN (2,3) THEN true_canonical ELSE true_clean END AS name FROM payers",
)
def clean_ai_name(t: Tables):
    raw = F.concat(F.lit("the  "), F.lower("true_clean"), F.lit("-"))
    return t.payers.select("id", nm.clean_ai_name(raw).alias("name"))


@query(
    "F22_string_ratio",
    """SELECT p_partkey AS id, round(CAST(2*length(p_name) AS DOUBLE)/(2*length(p_name)+2), 6) AS ratio FROM part""",
)
def string_ratio(t: Tables):
    # inserting two foreign letters leaves every letter of the shorter name matched
    longer = F.concat("p_name", F.lit("!!"))
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.round(nm.string_ratio(F.upper("p_name"), longer), 6).alias("ratio"),
    )


# mapping rows with candidates and opponents, derived from conversations
_MENTIONS = (
    "SELECT conv_id AS document_id, turn AS pos, concat('Senator ', CASE turn%3 WHEN 0 THEN 'ann lee' WHEN 1 THEN 'joe hill' ELSE 'sam cole' END) AS verbatim_term, "
    "'Candidate & Entity Identifiers' AS mapped_primary_category, CASE WHEN turn%4=3 THEN 'Opposition Elements' ELSE 'Candidate Elements' END AS mapped_subcategory, "
    "'Name (Exact)' AS mapped_canonical_term FROM {conversations}"
)
_A32_SQL = """WITH m AS (SELECT conv_id AS d, turn AS pos, CASE turn%3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Joe Hill' ELSE 'Sam Cole' END AS n, turn%4=3 AS opp FROM conversations),
    c AS (SELECT d, n, count(*) AS k, min(pos) AS p FROM m WHERE NOT opp AND NOT EXISTS (SELECT 1 FROM m o WHERE o.d=m.d AND o.opp AND o.n=m.n) GROUP BY d, n)
    SELECT d AS document_id, n AS name FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k DESC, p) AS rn FROM c) WHERE rn=1"""


@query("A32_candidate_names", _A32_SQL)
def candidate_names(t: Tables):
    return e.candidate_names(t.sql(_MENTIONS))


@query("U03_candidates_minus_opponents", _A32_SQL)
def candidates_minus_opponents(t: Tables):
    m = t.sql(_MENTIONS)
    arrays = m.groupBy("document_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", *[c for c in m.columns if c not in ("document_id", "pos")]))),
            lambda r: r.dropFields("pos"),
        ).alias("mappings")
    )
    named = arrays.select("document_id", nm.name_from_mappings(F.col("mappings")).alias("name"))
    return named.filter("name IS NOT NULL")


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(client)),'^the\\s+',''),'[^\\w\\s]','','g'),'\\s+',' ','g'))"


@query(
    "A34_client_frequency",
    f"SELECT client AS client_raw, count(*) AS count, {_NORM} AS normalized FROM catalog WHERE client <> '' GROUP BY ALL",
)
def client_frequency(t: Tables):
    return e.client_frequency(t.catalog("client"))


@query(
    "A33_exact_duplicates",
    f"""WITH f AS (SELECT client AS client_raw, count(*) AS count, {_NORM} AS normalized FROM catalog WHERE client <> '' GROUP BY ALL)
    SELECT f.*, g.spellings, CAST(g.documents AS BIGINT) AS documents FROM f JOIN (SELECT normalized, count(*) AS spellings, sum(count) AS documents FROM f GROUP BY 1 HAVING count(*) > 1) g USING (normalized)""",
)
def exact_duplicates(t: Tables):
    return e.exact_duplicates(t.catalog("id", "client"))


_PAYER_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw, concat(' ', chr(10)))),'^the\\s+',''),'[^\\w\\s]','','g'),'\\s+',' ','g'))"


_SIMILARITIES = f"""WITH a AS (SELECT id, list_distinct(string_split({_PAYER_NORM}, ' ')) AS x, list_distinct(string_split(lower(true_clean), ' ')) AS y FROM payers)
    SELECT id, coalesce(round(CAST(len(list_intersect(x,y)) AS DOUBLE)/len(list_distinct(x || y)), 6), 0) AS similarity FROM a"""


# all payers: one without a clean name is similar to nothing
@query("F23_token_similarity", _SIMILARITIES)
@query("F23_token_similarity_all", _SIMILARITIES)
def token_similarity(t: Tables):
    a, b = nm.comparison_form(F.col("raw")), F.lower("true_clean")
    return t.payers.select("id", F.round(nm.token_jaccard(a, b), 6).alias("similarity"))


@query(
    "J08_near_duplicate_groups",
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT name, min(id) AS place FROM (SELECT id, {_PAYER_NORM} AS name FROM payers) GROUP BY 1),
    r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY place) AS i, place, name, list_distinct(string_split(name,' ')) AS w FROM n),
    adj AS MATERIALIZED (SELECT a.i, list(b.i) FILTER (WHERE b.i IS NOT NULL) AS nb FROM r a LEFT JOIN r b ON a.i<>b.i AND CAST(len(list_intersect(a.w,b.w)) AS DOUBLE)/len(list_distinct(a.w||b.w)) >= 0.6 GROUP BY a.i),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS visited, CAST([] AS BIGINT[]) AS grp
      UNION ALL SELECT w.i+1, CASE WHEN list_contains(w.visited, w.i+1) OR len(list_filter(coalesce(a.nb,[]), lambda x: NOT list_contains(w.visited, x)))=0 THEN w.visited
        ELSE w.visited || [w.i+1] || list_filter(a.nb, lambda x: NOT list_contains(w.visited, x)) END,
        CASE WHEN list_contains(w.visited, w.i+1) THEN [] ELSE list_filter(coalesce(a.nb,[]), lambda x: NOT list_contains(w.visited, x)) END
      FROM walk w JOIN adj a ON a.i=w.i+1),
    g AS (SELECT i AS seed, unnest(grp || [i]) AS member FROM walk WHERE len(grp) > 0)
    SELECT m.place, m.name, s.place AS seed FROM g JOIN r m ON m.i=g.member JOIN r s ON s.i=g.seed""",
)
def near_duplicate_groups(t: Tables):
    return e.near_duplicate_groups(e.first_appearance(t.payers, "raw", "id"))


@query(
    "A35_cleaning_report",
    """SELECT count(*) FILTER (WHERE lower(true_clean) <> lower(r)) AS changed, count(*) FILTER (WHERE lower(true_clean) = lower(r)) AS unchanged,
    count(*) FILTER (WHERE true_clean IS NULL) AS garbage, count(DISTINCT true_clean) AS distinct_names FROM (SELECT *, trim(raw, concat(' ', chr(10))) AS r FROM payers)""",
)
def cleaning_report(t: Tables):
    return e.cleaning_report(e.clean_clients(_payers(t)))


@query(
    "A35_resolution_sources",
    "SELECT coalesce(true_source,'null') AS resolution_source, count(*) AS count FROM payers GROUP BY 1",
)
def resolution_sources(t: Tables):
    resolved = e.resolve_clients(e.clean_clients(_payers(t)), e.override_table(t.canonical_overrides))
    return e.count_by(resolved, "resolution_source")


@query(
    "A35_top_canonical",
    "SELECT true_canonical AS name, count(*) AS count FROM payers WHERE true_canonical IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def top_canonical(t: Tables):
    return e.top_canonical(
        e.resolve_clients(e.clean_clients(_payers(t)), e.override_table(t.canonical_overrides))
    )


def _cleaned_sql(text: str) -> str:
    """The steps of the clean-up one after the other.  RE2 has no look-around: the neighbours of a marked word are
    matched and put back, twice, because one neighbour may serve two words."""
    for entity, value in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {value})"
    around = r"'(?s)(^|[^\p{L}\p{N}_])_(.+?)_($|[^\p{L}\p{N}_])', '\1\2\3', 'g'"
    steps = [r"'(?s)\*\*(.+?)\*\*', '\1', 'g'", r"'(?s)__(.+?)__', '\1', 'g'", r"'(?s)\*(.+?)\*', '\1', 'g'", around, around]
    steps += [r"'(?m)^#{1,6}\s+', '', 'g'", "'[ \\t\u00a0]{2,}', ' ', 'g'"]
    for step in steps:
        text = f"regexp_replace({text}, {step})"
    return f"trim({text}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160)))"


@query(
    "F01_clean_ocr_text",
    f"""SELECT doc_id AS id, {_cleaned_sql("text")} AS cleaned FROM documents
    UNION ALL SELECT -1 - p_partkey, concat('Head ', p_name, ' & co ', p_brand, chr(10), 'file_name_x 5 * 3') FROM part""",
)
def clean_ocr_text(t: Tables):
    """All documents as they are, and texts made of part names with every kind of mark."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    marked = F.concat(
        F.lit("# Head  **"), "p_name", F.lit("** &amp; _co_ &nbsp;&nbsp; "), F.lit("*"), "p_brand",
        F.lit("*\nfile_name_x 5 * 3  "),
    )
    parts = t.part.select((-1 - F.col("p_partkey")).alias("id"), marked.alias("text"))
    return docs.unionByName(parts).select("id", tx.clean_ocr_text(F.col("text")).alias("cleaned"))


@query("F01_clean_ocr_documents", f"SELECT doc_id AS id, {_cleaned_sql('text')} AS cleaned FROM documents")
def clean_ocr_documents(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), tx.clean_ocr_text(F.col("text")).alias("cleaned"))
