"""Catalog tables derived from the given test tables.

Each view is one SQL text that Spark and the check engine both accept; table
names appear as ``{name}`` placeholders.  The catalog is assembled from the
columns a query asks for, so unused source tables are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.session import prepare

AS_OF = "2024-01-31 00:00:00"
_AS_OF = f"TIMESTAMP '{AS_OF}'"

_STATUS = (
    "CASE WHEN d.doc_id%50=49 THEN 'PENDING' WHEN d.doc_id%10=9 THEN 'PROCESSING' "
    "WHEN d.doc_id%10=8 THEN 'QUEUED' WHEN d.doc_id%10=7 THEN 'FAILED' ELSE 'COMPLETED' END"
)
_CREATED = (
    "TIMESTAMP '2024-01-01 00:00:00' + ((d.doc_id*37)%43200) * INTERVAL '1' MINUTE"
)
_NAME = (
    "concat(d.source,'_',CAST(d.doc_id AS STRING),CASE d.doc_id%4 WHEN 0 THEN '.pdf' "
    "WHEN 1 THEN '.txt' WHEN 2 THEN '.docx' ELSE '.png' END)"
)
_PERSON = (
    "concat(CASE d.doc_id%5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Joe' WHEN 2 THEN 'Maria' "
    "WHEN 3 THEN 'Sam' ELSE 'Lena' END,' ',CASE d.doc_id%7 WHEN 0 THEN 'Lee' WHEN 1 THEN 'Hill' "
    "WHEN 2 THEN 'Cole' WHEN 3 THEN 'Moreno' WHEN 4 THEN 'Tipping' WHEN 5 THEN 'Reyes' ELSE 'Park' END)"
)
# summary text and, beside it in SUMMARY_TRUTH, the name it holds
_SUMMARY = (
    "CASE d.doc_id%12 WHEN 0 THEN '' WHEN 1 THEN 'No summary available' "
    f"WHEN 2 THEN concat('A flyer supporting ',{_PERSON},' for Congress.') "
    f"WHEN 3 THEN concat('Urging neighbours to back the re-election of ',{_PERSON},'.') "
    f"WHEN 4 THEN concat('Notes on candidate ',{_PERSON},'.') "
    f"WHEN 5 THEN concat('A mailer from ',{_PERSON},' attacking taxes.') "
    f"WHEN 6 THEN concat('The card is sponsored by ',{_PERSON},'.') "
    "WHEN 7 THEN 'Plain text about roads and schools.' "
    f"WHEN 8 THEN concat('Please remember: vote for ',{_PERSON},'.') "
    f"ELSE concat('Campaign mailer for ',{_PERSON},'.') END"
)
_MAPPING_COUNT = "CASE d.doc_id%6 WHEN 5 THEN NULL WHEN 4 THEN 0 ELSE 3 END"


def _analysis_json() -> str:
    text = (
        "CASE WHEN d.doc_id%23=0 THEN NULL "
        "WHEN d.doc_id%29=0 THEN '«\"error\":\"quota exceeded\"»' "
        "WHEN d.doc_id%3=0 THEN concat('«\"document_analysis\":«\"summary\":\"',SUMMARY,"
        "'\",\"document_type\":\"Mailer\",\"document_tone\":\"\"»,"
        "\"entities\":«\"client_name\":\"',PERSON,'\"»,"
        "\"taxonomy_keywords\":«\"keyword_mappings\":[«\"verbatim_term\":\" Roads \","
        "\"mapped_canonical_term\":\"Infrastructure\"»]»»') "
        "ELSE concat('«\"schema_version\":1,\"summary\":\"',SUMMARY,"
        "'\",\"keyword_mappings\":[«\"verbatim_term\":\"Taxes\","
        "\"mapped_primary_category\":\"Policy\",\"mapped_canonical_term\":\"Taxes\"»],"
        "\"classification\":«\"category\":\"Issue\"»,"
        "\"communication_focus\":«\"primary_issue\":\"Schools\"»,"
        "\"categories\":[\"Policy\",\" GOTV\"]»') END"
    )
    text = text.replace("SUMMARY", _SUMMARY).replace("PERSON", _PERSON)
    # braces doubled: the text passes through str.format once
    return text.replace("«", "{{").replace("»", "}}")


# column -> (expression, source tables beside documents)
CATALOG = {
    "id": ("d.doc_id", ""),
    "filename": (_NAME, ""),
    "file_path": (f"concat('2024/',{_NAME})", ""),
    "file_size": ("d.n_chars", ""),
    "status": (_STATUS, ""),
    "extracted_text": ("CASE WHEN d.doc_id%40=0 THEN NULL ELSE d.text END", ""),
    "search_content": (f"concat({_NAME},' ',d.text)", ""),
    "created_at": (_CREATED, ""),
    "updated_at": (
        f"CASE WHEN d.doc_id%19=0 THEN NULL ELSE {_CREATED} + (d.doc_id%2880) * INTERVAL '1' MINUTE END",
        "",
    ),
    "processing_started_at": (
        "CASE WHEN d.doc_id%10 IN (8) OR d.doc_id%50=49 OR d.doc_id%13=0 THEN NULL "
        f"ELSE {_CREATED} + (d.doc_id%7) * INTERVAL '1' MINUTE END",
        "",
    ),
    "processed_at": (
        "CASE WHEN d.doc_id%10 >= 8 OR d.doc_id%17=0 THEN NULL "
        f"ELSE {_CREATED} + (d.doc_id%7+d.doc_id%5+1) * INTERVAL '1' MINUTE END",
        "",
    ),
    "processing_heartbeat_at": (
        "CASE WHEN d.doc_id%10<>9 OR d.doc_id%4=1 THEN NULL "
        f"WHEN d.doc_id%3=0 THEN {_AS_OF} - INTERVAL '100' SECOND "
        f"ELSE {_CREATED} + INTERVAL '10' MINUTE END",
        "",
    ),
    "processing_progress": ("CAST(d.doc_id%120 AS INT)", ""),
    "processing_error": (
        "CASE WHEN d.doc_id%10=7 THEN concat('error ',CAST(d.doc_id%3 AS STRING)) END",
        "",
    ),
    "thumbnail_url": ("CAST(NULL AS STRING)", ""),
    "ai_analysis": (_analysis_json(), ""),
    "mapping_count": (_MAPPING_COUNT, ""),
    "client_canonical": ("CASE WHEN d.doc_id%11=0 THEN NULL ELSE c.c_name END", "c"),
    "client": (
        "CASE d.doc_id%3 WHEN 0 THEN upper(c.c_name) WHEN 1 THEN c.c_name ELSE concat('The ',c.c_name) END",
        "c",
    ),
    "client_confidence": (
        "CASE d.doc_id%5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'HIGH' END",
        "",
    ),
    "state": (
        "CASE d.doc_id%6 WHEN 0 THEN 'TX' WHEN 1 THEN 'OH' WHEN 2 THEN 'CA' WHEN 3 THEN 'MO ' WHEN 4 THEN '' END",
        "",
    ),
    "state_confidence": (
        "CASE d.doc_id%7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END",
        "",
    ),
    "date_created": ("CAST(o.o_orderdate + INTERVAL '24' YEAR AS DATE)", "o"),
    "date_confidence": (
        "CASE d.doc_id%4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END",
        "",
    ),
    "is_frank": ("d.doc_id%5=0", ""),
    "needs_review": ("CASE WHEN d.doc_id%9=0 THEN true WHEN d.doc_id%9<7 THEN false END", ""),
    "needs_date_review": ("CASE WHEN d.doc_id%8=0 THEN true WHEN d.doc_id%8<6 THEN false END", ""),
    "embedding_version": (
        "CASE d.doc_id%4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END",
        "",
    ),
    "search_vector": ("e.embedding", "e"),
}
_CUSTOMER_KEY = (
    "CASE WHEN d.doc_id%3=0 THEN d.doc_id%20 "
    "ELSE CAST(floor(d.doc_id/3) AS BIGINT) END % (SELECT count(*) FROM {customer})"
)
_JOINS = {
    "e": "LEFT JOIN {embeddings} e ON e.vec_id=d.doc_id",
    # every customer has documents; a third of all documents belongs to twenty busy ones
    "c": f"LEFT JOIN {{customer}} c ON c.c_custkey={_CUSTOMER_KEY}",
    "o": "LEFT JOIN {orders} o ON o.o_orderkey=d.doc_id",
}


def catalog_sql(columns: list[str] | None = None) -> str:
    columns = columns or list(CATALOG)
    needed = [k for k in _JOINS if any(CATALOG[c][1] == k for c in columns)]
    select = ", ".join(f"{CATALOG[c][0]} AS {c}" for c in columns)
    return " ".join([f"SELECT {select} FROM {{documents}} d", *[_JOINS[k] for k in needed]])


def with_key(text: str, key: str, columns: str = "*") -> str:
    """The same SQL for Spark with the key of a join computed beside the documents: a key that holds a subquery
    cannot be that of a broadcast table, for Spark does not wait for it there."""
    if key not in text:
        return text
    plain = key.replace("d.", "")
    documents = f"(SELECT {columns}, {plain} AS join_key FROM {{documents}}) d"
    return text.replace("{documents} d", documents).replace(f"={key}", "=d.join_key")


_TERM = "concat(p.p_brand,' ',p.p_name)"
VIEWS = {
    "doc_mappings": (
        "SELECT d.doc_id AS document_id, k.k AS pos, p.p_name AS verbatim_term, "
        "p.p_type AS mapped_primary_category, p.p_brand AS mapped_subcategory, "
        f"{_TERM} AS mapped_canonical_term "
        "FROM {documents} d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k "
        "JOIN {part} p ON p.p_partkey=(d.doc_id*7+k.k*13)%(SELECT count(*) FROM {part})"
    ),
    "taxonomy": (
        "SELECT DISTINCT md5(concat(p.p_type,'|',CASE WHEN p.p_brand='Brand#1' THEN '' ELSE p.p_brand END,'|',"
        f"{_TERM})) AS id, p.p_type AS primary_category, "
        f"CASE WHEN p.p_brand='Brand#1' THEN NULL ELSE p.p_brand END AS subcategory, {_TERM} AS term "
        "FROM {part} p WHERE p.p_name NOT LIKE 'red %'"
    ),
    "synonyms": (
        "SELECT p.p_partkey AS id, concat('the ',p.p_name) AS synonym FROM {part} p"
    ),
    "search_queries": (
        "SELECT event_id AS id, CASE WHEN event_id%9=0 THEN '(filter only)' ELSE concat(event_type,' ',CAST(user_id%7 AS STRING)) END AS query, "
        "ts AS timestamp, CASE WHEN user_id%4=0 THEN 'Customer#000000003' WHEN user_id%4=1 THEN 'Customer#000000005' END AS filter_client, "
        "CASE WHEN user_id%5=0 THEN 'TX' WHEN user_id%5=3 THEN 'OH' END AS filter_state, CASE WHEN event_id%9=0 THEN 2019+user_id%5 END AS filter_date_year, "
        "CASE WHEN event_type='error' THEN 0 ELSE CAST(floor(value) AS INT) END AS result_count FROM {events}"
    ),
    "mailers": (
        "WITH b AS (SELECT o_orderkey AS id, CAST(o_orderdate + INTERVAL '24' YEAR AS DATE) AS true_date,"
        "CASE o_orderkey%5 WHEN 0 THEN 'TX' WHEN 1 THEN 'GA' WHEN 2 THEN 'FL' WHEN 3 THEN 'NV' ELSE 'ME' END AS true_state,"
        "CASE o_orderkey%3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Joe Hill' ELSE 'Sam Cole' END AS true_client, o_orderkey%10=0 AS true_frank FROM {orders}) "
        "SELECT id, concat('Job ',CAST(id AS STRING),'.indd 1 ',CAST(month(true_date) AS STRING),'/',CAST(day(true_date) AS STRING),'/',CAST(year(true_date)%100 AS STRING),' 3:04 PM',chr(10),'Vote ',true_client,' for Mayor',chr(10),"
        "'Paid for by ',CASE WHEN true_frank THEN 'official funds authorized by the House of Representatives' ELSE concat('Friends of ',true_client) END,chr(10),'1 Main St, Springfield, ',true_state,' 78701') AS extracted_text,"
        "true_date,'HIGH' AS true_date_confidence,true_client,CASE WHEN true_frank THEN 'LOW' ELSE 'HIGH' END AS true_client_confidence,true_state,'HIGH' AS true_state_confidence,true_frank,true_frank AS true_needs_review FROM b"
    ),
    # harder mailers: every tier of the rules, with the expected outcome
    "mixed_mailers": (
        "WITH b AS (SELECT o_orderkey AS id, o_orderkey%8 AS v, CAST(o_orderdate + INTERVAL '24' YEAR AS DATE) AS dt,"
        "CASE o_orderkey%3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Joe Hill' ELSE 'Sam Cole' END AS person,"
        "CASE o_orderkey%4 WHEN 0 THEN 'Texas' WHEN 1 THEN 'West Virginia' WHEN 2 THEN 'Ohio' ELSE 'New York' END AS sname,"
        "CASE o_orderkey%4 WHEN 0 THEN 'TX' WHEN 1 THEN 'WV' WHEN 2 THEN 'OH' ELSE 'NY' END AS scode FROM {orders}),"
        "s AS (SELECT id, v, dt, person, sname, scode, concat(CAST(month(dt) AS STRING),'/',CAST(day(dt) AS STRING),'/',CAST(year(dt) AS STRING)) AS stamp FROM b) "
        "SELECT id, CASE v "
        "WHEN 0 THEN concat('Printed ',stamp,' 10:15',chr(10),'Paid for by Friends of ',person,', Kim Doe, Treasurer',chr(10),'Box 9',chr(10),sname) "
        "WHEN 1 THEN concat('We met on ',stamp,' 9:00',chr(10),'Paid for by ',person,' for Congress',chr(10),'Serving families') "
        "WHEN 2 THEN concat('Source: 1) ',stamp,' 10:15',chr(10),'Vote ',person,' for Mayor',chr(10),'Paid for by the Citizens Action Fund of Greater Springfield.') "
        "WHEN 3 THEN concat('No date here',chr(10),'A fresh start for ',sname,chr(10),'Re-Elect ',person,' for Sheriff') "
        "WHEN 4 THEN concat('JANE PALMER leads. JANE PALMER cares about ',sname,' and again ',sname,'. ',stamp,' 1:00 AM ',stamp,' 2:00 AM') "
        "WHEN 5 THEN concat('See www.JenForCity.com today',chr(10),'GCISD rally') "
        "WHEN 6 THEN concat('Paid for by Committee to Re-Elect ',person,' | 12 Oak St',chr(10),'Dayton, ',scode,' 45402 ',stamp,' 3:04:05 pm') "
        "ELSE concat(chr(10),'Paid for by ',person,' and',chr(10),chr(10),'Come along') END AS extracted_text, "
        "CASE WHEN v IN (0,4,6) THEN dt END AS true_date, "
        "CASE WHEN v IN (0) THEN 'MEDIUM' WHEN v IN (4,6) THEN 'HIGH' WHEN v IN (1,2) THEN 'LOW' END AS true_date_confidence, "
        "CASE v WHEN 4 THEN 'Jane Palmer' WHEN 5 THEN 'Jen' ELSE person END AS true_client, "
        "CASE v WHEN 5 THEN 'LOW' ELSE 'HIGH' END AS true_client_confidence, "
        "CASE v WHEN 5 THEN 'TX' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 7 THEN NULL ELSE scode END AS true_state, "
        "CASE v WHEN 0 THEN 'MEDIUM' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'MEDIUM' WHEN 5 THEN 'HIGH' WHEN 6 THEN 'HIGH' END AS true_state_confidence, "
        "CASE v WHEN 0 THEN concat('Friends of ',person) WHEN 1 THEN concat(person,' for Congress') WHEN 2 THEN 'the Citizens Action Fund of Greater Springfield' WHEN 6 THEN concat('Committee to Re-Elect ',person) WHEN 7 THEN person END AS true_payer, v FROM s"
    ),
    "payers": (
        "WITH b AS (SELECT d.doc_id AS id, d.doc_id%9 AS v, concat(split_part(p.p_name,' ',1),' ',split_part(p.p_name,' ',2)) AS low, "
        "concat(upper(substring(split_part(p.p_name,' ',1),1,1)),substring(split_part(p.p_name,' ',1),2),' ',upper(substring(split_part(p.p_name,' ',2),1,1)),substring(split_part(p.p_name,' ',2),2)) AS cap, "
        "CASE d.doc_id%4 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Nebraska' WHEN 2 THEN 'Ohio' ELSE 'West Virginia' END AS st "
        "FROM {documents} d JOIN {part} p ON p.p_partkey=d.doc_id%(SELECT count(*) FROM {part})) "
        "SELECT id, CASE v WHEN 0 THEN concat('  the ',low,'   committee') WHEN 1 THEN upper(concat(low,' for judge')) "
        "WHEN 2 THEN concat('Republican Party of ',st) WHEN 3 THEN concat(st,' GOP') WHEN 4 THEN 'Not authorized by any candidate' "
        "WHEN 5 THEN concat(low,' committee - ron richard') WHEN 6 THEN concat(low,'!?,') WHEN 7 THEN split_part(low,' ',1) ELSE concat(low,chr(10),'o''brien 97th') END AS raw, "
        "CASE v WHEN 0 THEN concat(cap,' Committee') WHEN 1 THEN concat(cap,' For Judge') WHEN 2 THEN concat('Republican Party Of ',st) "
        "WHEN 3 THEN concat(st,' Gop') WHEN 5 THEN concat(cap,' Committee - Ron Richard') WHEN 6 THEN cap WHEN 8 THEN concat(cap,' O''Brien 97Th') END AS true_clean, "
        "CASE v WHEN 0 THEN concat(cap,' Committee') WHEN 1 THEN cap WHEN 2 THEN concat(st,' Republican Party') WHEN 3 THEN concat(st,' Republican Party') "
        "WHEN 5 THEN concat(cap,' Committee') WHEN 6 THEN cap WHEN 8 THEN concat(cap,' O''Brien 97Th') END AS true_canonical, "
        "CASE WHEN v IN (0,6,8) THEN 'passthrough' WHEN v IN (1,2,3,5) THEN 'rule' END AS true_source FROM b"
    ),
    "canonical_overrides": (
        "SELECT c_name AS client_clean_v1, upper(c_mktsegment) AS client_canonical FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"
    ),
    "doc_pages": (
        "SELECT conv_id AS document_id, turn + 1 AS page_num, text, role AS keyword, "
        "CASE WHEN turn%2=0 THEN concat('Page ',CAST(turn+1 AS STRING)) ELSE '' END AS summary, "
        "length(text) AS input_tokens, turn*10 AS output_tokens, CASE WHEN turn%3=1 THEN 'anthropic' WHEN turn%3=2 THEN 'openai' END AS provider, "
        "conv_id%3 AS checkpoint FROM {conversations}"
    ),
    "status_events": (
        "SELECT event_id AS id, user_id AS document_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'heartbeat' "
        "WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind, value FROM {events}"
    ),
}
SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# the same views for Spark: without a product, keys of joins computed beforehand
_SPARK_VIEWS = {
    "payers": with_key(VIEWS["payers"], "d.doc_id%(SELECT count(*) FROM {part})", "doc_id"),
    "doc_mappings": (
        "SELECT d.doc_id AS document_id, d.k AS pos, p.p_name AS verbatim_term, "
        "p.p_type AS mapped_primary_category, p.p_brand AS mapped_subcategory, "
        f"{_TERM} AS mapped_canonical_term "
        "FROM (SELECT doc_id, k, (doc_id*7+k*13)%(SELECT count(*) FROM {part}) AS join_key "
        "FROM (SELECT doc_id, explode(array(0, 1, 2)) AS k FROM {documents})) d "
        "JOIN {part} p ON p.p_partkey=d.join_key"
    ),
}


class Tables:
    """The given tables and the views derived from them, for one session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def source(self, name: str) -> DataFrame:
        """A given table; its schema is looked up once per session."""
        opened = self.spark.__dict__.setdefault("_foliary_opened", {})
        key = (self.folder, name)
        if key not in opened:
            opened[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return opened[key]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)):
            frames.setdefault(name, self.source(name))
        return self.spark.sql(text, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(_SPARK_VIEWS.get(name, VIEWS[name]))
        if name in SOURCES:
            return self.source(name)
        raise AttributeError(name)

    def catalog(self, *columns: str) -> DataFrame:
        """The catalog with the named columns; ``keywords`` is the nested
        struct of keywords, categories and mappings."""
        nested = "keywords" in columns
        plain = [c for c in columns if c != "keywords"]
        extra = [c for c in ("id", "mapping_count") if nested and c not in plain]
        df = self.sql(with_key(catalog_sql(plain + extra), _CUSTOMER_KEY))
        if nested:
            df = self._with_keywords(df)
        return df.select(*columns)

    def _with_keywords(self, df: DataFrame) -> DataFrame:
        # three mappings a document, in their order
        mapping = F.struct(
            "verbatim_term", "mapped_primary_category", "mapped_subcategory", "mapped_canonical_term"
        ).alias("mapping")
        found = self.doc_mappings.groupBy(F.col("document_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("pos", mapping))).alias("found")
        )
        none = F.array().cast(_MAPPINGS_TYPE)
        mappings = F.coalesce(F.transform("found", lambda x: x["mapping"]), none)
        count = F.col("mapping_count")
        keywords = F.when(
            count.isNotNull(),
            F.struct(
                F.array(F.lit("mail"), F.lit("print")).alias("keywords"),
                F.array(F.lit("Issue")).alias("categories"),
                F.when(count > 0, mappings)
                .otherwise(none)
                .alias("keyword_mappings"),
                count.alias("mapping_count"),
            ),
        )
        return df.join(found, "id", "left").withColumn("keywords", keywords)

    def links(self) -> DataFrame:
        from foliary.operators.mappings import link_terms

        return link_terms(self.doc_mappings, self.taxonomy)


from foliary.functions.analysis import MAPPINGS_TYPE as _MAPPINGS_TYPE  # noqa: E402

_LINKS_SQL = (
    "SELECT DISTINCT m.document_id, t.id AS taxonomy_term_id FROM doc_mappings m "
    "JOIN taxonomy t ON t.term = m.mapped_canonical_term"
)


def check_sql(text: str) -> str:
    """Check SQL with the definitions of all views it mentions in front."""
    definitions = {n: v for n, v in VIEWS.items()}
    definitions["catalog"] = catalog_sql()
    definitions["doc_terms"] = _LINKS_SQL
    # order matters: later views may use earlier ones
    wanted: list[str] = []
    pending = text
    for name in ["catalog", "doc_terms", *[n for n in VIEWS]]:
        if re.search(rf"\b{name}\b", pending):
            wanted.append(name)
            if name == "doc_terms":
                pending += " doc_mappings taxonomy "
    wanted.sort(key=lambda n: n == "doc_terms")
    names = {s: s for s in SOURCES}
    ctes = [f"{n} AS ({definitions[n].format(**names)})" for n in wanted]
    if not ctes:
        return text
    body = text.lstrip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return lead + ", ".join(ctes) + ", " + body[len(lead) :]
    return "WITH " + ", ".join(ctes) + " " + text
