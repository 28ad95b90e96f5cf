"""Registered queries over written stores, ranks, pages, indexes, dictionaries and responses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import normalised
from ..functions.text import canonical_payee, tokens
from ..operators import analyze, counters, dictionary, diagnostics, paging, quantile, records, rules, search, sequence, store
from ..operators.shared import scratch, stored
from ..operators.versions import Store
from .documents import TODAY, documents, spread, table
from .oracles import DOCUMENTS

def _today():
    return F.lit(TODAY).cast("date")


# --- dictionary ---


def payee_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words of part names (second letter lost, or a letter doubled) and the dictionary's words within two edits."""
    words = table(spark, sf_dir, "part").select(F.explode(tokens(canonical_payee(F.col("p_name"), False))).alias("entry")).distinct()
    lost = F.concat(F.substring("entry", 1, 1), F.substring(F.col("entry"), F.lit(3), F.length("entry")))
    said = words.select(F.explode(F.array(lost, F.concat(F.substring("entry", 1, 1), F.col("entry")))).alias("word"))
    return dictionary.near(said, words)


def payee_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payee against two towns, one edit allowed, and all customers by their numbers, none allowed."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.element_at(tokens(canonical_payee(F.col("c_name"), False)), -1).alias("distinctive"), F.lit(0).alias("tolerance"))
    towns = spark.createDataFrame([("Town of Whitby", "whitby", 1), ("City of Oshawa", "oshawa", 1)], "name string, distinctive string, tolerance int")
    d = documents(spark, sf_dir).select("k", "payee_raw")
    got = dictionary.matched(d, "payee_raw", customers.unionByName(towns), 1, unicode=False)
    return got.select("k", "matched_name", F.col("matched_distance").cast("int").alias("matched_distance"))


# --- ranks and pages ---


def record_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's place, and the customers before and after it, among those of its segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    got = sequence.beside(c, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], "c_custkey", "place")
    return got.select("c_custkey", F.col("place").cast("bigint").alias("place"), "previous", "next")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of 40 of all orders by price, opened from sorted files."""
    path = scratch(spark, "view")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    paging.write(orders, path, [F.col("o_totalprice").desc(), F.col("o_orderkey")], F.col("o_totalprice"), rows=1000)
    return paging.page(spark, path, 3, 40).select("place", "o_orderkey", "o_totalprice")


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median prices of orders by priority, and of all."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    each = quantile.medians(orders, price, ["o_orderpriority"])
    whole = quantile.medians(orders, price, []).withColumn("o_orderpriority", F.lit("all"))
    return each.unionByName(whole)


# --- stores ---


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("record_id"), "c_name", F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").cast("bigint").alias("amount"))


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two appends and two merges: every third customer's amount is doubled, every seventh of those is then moved to another segment."""
    at, c = Store.create(spark, scratch(spark, "store"), "record_id", _customers(spark, sf_dir).schema, buckets=4), _customers(spark, sf_dir)
    number = F.substring("record_id", 2, 20).cast("bigint")
    at.append(c.filter(number % 2 == 0))
    at.append(c.filter(number % 2 == 1))
    at.merge(lambda old: old.filter(number % 3 == 0).withColumn("amount", F.col("amount") * 2))
    at.keep("before")
    at.merge(lambda old: old.filter(number % 21 == 0).withColumn("segment", F.lit("MOVED")).withColumn("was", F.col("amount")))
    return at.read()


def _judged(spark: SparkSession, sf_dir: str, cfg: rules.Config) -> DataFrame:
    d = normalised(documents(spark, sf_dir).withColumn("record_id", F.col("k").cast("string")), unicode=False)
    return rules.validated(d, _today(), cfg).select("record_id", "verdict", F.col("day").alias("cheque_date"), "rules", "k")


def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after ten batches, each of which also judges a tenth of the batch before by another rule set, by differences alone."""
    strict, lax = rules.Config(reject_postdated=True, evidence=False), rules.Config(evidence=False)
    old, new = stored(_judged(spark, sf_dir, strict), "records"), stored(_judged(spark, sf_dir, lax), "records")
    at = Store.create(spark, scratch(spark, "counted"), "record_id", old.schema, buckets=4)
    counts, seen = spark.createDataFrame([], counters.SCHEMA), 0
    for i in range(10):
        at.append(old.filter(F.col("k") % 10 == i))
        version = at.merge(new.filter((F.col("k") % 10 == i - 1) & (F.floor(F.col("k") / 10) % 10 == 0))) if i else at.versions()[-1]
        counts, seen = stored(counters.refreshed(at, counts, seen, version), "counters"), version
    return counts


def revalidate_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of rule set 1 after its records are judged by rule set 2 and merged, with overrides that have a text for each rule."""
    old = rules.validated(normalised(documents(spark, sf_dir).withColumn("record_id", F.col("k").cast("string")), unicode=False), _today(), rules.Config(reject_postdated=True, evidence=False))
    known = records.projected(old, "1").withColumn("ruleset_version", F.when(F.col("record_id").cast("bigint") % 3 == 0, "2").otherwise(F.col("ruleset_version")))
    at = Store.create(spark, scratch(spark, "judged"), "record_id", known.schema, buckets=4)
    at.append(known)
    over = _overrides(spark, sf_dir).filter("status = 'PASS'").drop("status")
    at.merge(lambda rows: records.revalidated(rows, over, "2", _today(), rules.Config(), unicode=False).drop("old_ruleset", "old_verdict", "overlaid"))
    told = lambda r: F.when(F.startswith(F.col("rules")[r]["message"], F.lit("confirmed by a person: ")), F.col("rules")[r]["message"]).alias(f"{r}_told")
    return at.read().select("record_id", "ruleset_version", "verdict", told("payee"), told("signature"))


# --- overrides ---


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of every fourth order: a text for each rule, one of them given twice."""
    rows = [("payee", "PASS", "payee seen at the desk"), ("signature", "PASS", "signature compared with the card"), ("signature", "PASS", "signature seen again")]
    given = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("rule", "status", "evidence"), r, strict=True)]) for r in rows])
    return table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 1").select(F.col("o_orderkey").cast("string").alias("record_id"), F.inline(given))


def override_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and text of the overridden rules, and the verdict; a rule that is overridden twice has the first text."""
    d = _judged(spark, sf_dir, rules.Config(evidence=False))
    got = store.overridden(d, _overrides(spark, sf_dir))
    state = lambda r: [F.col("rules")[r]["status"].alias(f"{r}_status"), F.col("rules")[r]["evidence"].alias(f"{r}_evidence")]
    return got.filter("k % 4 = 1").select("record_id", "verdict", *state("payee"), *state("signature"))


# --- search ---

QUERIES_SEARCHED = ("  MACH", "r1", "0000012", "é", "#0000003", "zebra")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found by each of six queries, through the index; every tenth name has an accented letter."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 10 == 0, F.replace("c_name", F.lit("e"), F.lit("é"))).otherwise(F.col("c_name"))
    path = scratch(spark, "index")
    search.build(c.select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("record_id"), name.alias("payee"), F.col("c_mktsegment").alias("source_file"), F.lower("c_name").alias("payee_normalized")), path)
    out = [search.found(spark, path, q).select(F.lit(q.strip()).alias("query"), F.col("key").alias("record_id")) for q in QUERIES_SEARCHED]
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


# --- responses ---

#: A response for each order, in SQL that both engines read: its signature field is there or not, empty, with regions, entries or unknown keys.
RESPONSE = """CASE WHEN o_orderkey % 11 = 0 THEN 'no json' ELSE
  '{"documents":[{"fields":{"PayTo":{"content":"' || o_orderpriority || '"}' ||
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"PayerSignatures":null' ELSE
    ',"PayerSignatures":{"type":"signature","confidence":0.5' ||
    CASE WHEN o_orderkey % 3 = 0 THEN ',"boundingRegions":[{"page":1},{"page":2}]' WHEN o_orderkey % 3 = 1 THEN ',"bounding_regions":[]' ELSE '' END ||
    CASE WHEN o_orderkey % 7 = 0 THEN ',"valueArray":[1,"two",null]' WHEN o_orderkey % 7 = 1 THEN ',"valueArray":"x"' ELSE '' END ||
    CASE WHEN o_orderkey % 4 = 0 THEN ',"zeta":1,"alpha":[1]' ELSE '' END || '}' END ||
  CASE WHEN o_orderkey % 13 = 0 THEN ',"Amount":{"content":"1"}' ELSE '' END || '}}]}' END"""


def response_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each response has for the signature."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).select("o_orderkey", F.expr(RESPONSE).alias("response"))
    got = diagnostics.diagnosed(orders, "response", "PayerSignatures", "o_orderkey")
    return got.select("o_orderkey", "present", F.array_join("returned", ",").alias("returned"), F.when(F.col("present"), F.size("known")).alias("n_known"), F.when(F.col("present"), F.array_join("others", ",")).alias("others"), "regions", "entries")


# --- from files to records ---


def _reader():
    """An extractor for tests: it reads the payee that a file is, finds nothing in every fifth and fails on every thirteenth."""

    def call(path: str, content: bytes) -> dict:
        key = int(path.rsplit("/", 1)[1])
        if key % 13 == 0:
            raise TimeoutError(path)
        return {"documents": [{"fields": {"PayTo": {"content": bytes(content).decode(), "confidence": 0.25}}}]} if key % 5 else {"documents": []}

    return call


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two batches of files: a third of the customers, then all of them; two neighbours are copies of one file."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    cores = spark.sparkContext.defaultParallelism  # a table of one row group is one task otherwise, however large it is
    files = customers.repartition(max(cores, customers._jdf.queryExecution().toRdd().getNumPartitions()), "c_custkey").select("c_custkey", F.concat(F.lit("/in/"), k.cast("string")).alias("path"), F.encode("c_name", "utf-8").alias("content"), F.sha2((k - k % 2).cast("string"), 256).alias("source_hash"))
    out, at, time = [], None, F.lit("1998-12-31 10:00:00").cast("timestamp")
    for batch in (files.filter(k % 3 == 0), files):
        fields, _ = analyze.analyzed(batch.drop("c_custkey"), _reader, 2, unicode=False)
        if at is None:
            empty = records.projected(rules.validated(fields.withColumn("record_id", F.lit("")).withColumn("processed_time", time), _today()), "2", "m")
            at = Store.create(spark, scratch(spark, "ingested"), "record_id", empty.schema, buckets=4)
        _, events = analyze.recorded(at, fields, _today(), "19981231", "2", "m", time, rules.Config(evidence=False))
        out.append(events)
    return out[0].withColumn("batch", F.lit(1)).unionByName(out[1].withColumn("batch", F.lit(2))).drop("timestamp")


QUERIES = {
    f.__name__: f
    for f in (ingest_events, payee_dictionary, payee_matched, record_neighbours, page, medians, store_merge, store_counters, revalidate_merged, override_evidence, search_index, response_diagnostics)
}

_TEXT = "lower('R' || c_custkey || ' ' || coalesce(CASE WHEN c_custkey % 10 = 0 THEN replace(c_name, 'e', 'é') ELSE c_name END, '') || ' ' || coalesce(c_mktsegment, '') || ' ' || coalesce(lower(c_name), ''))"

_OVERRIDDEN = """, o AS (
  SELECT k::VARCHAR AS record_id, k, CASE WHEN 'FAIL' IN (r_amount, r_date, r_memo) THEN 'INVALID' WHEN 'UNABLE' IN (r_amount, r_date, r_memo) THEN 'REVIEW' ELSE 'VALID' END AS over_verdict, verdict FROM v
)
"""

ORACLES = {
    "ingest_events": """
        WITH f AS (SELECT c_custkey AS k, '/in/' || c_custkey AS path, c_custkey - c_custkey % 2 AS h FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 5 <> 0),
        a AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) = 1 AS new FROM f WHERE k % 3 = 0),
        i AS (SELECT h, row_number() OVER (ORDER BY path) AS n FROM a WHERE new),
        b AS (SELECT *, h NOT IN (SELECT h FROM i) AND row_number() OVER (PARTITION BY h ORDER BY path) = 1 AS new FROM f),
        j AS (SELECT h, (SELECT count(*) FROM i) + row_number() OVER (ORDER BY path) AS n FROM b WHERE new),
        e AS (SELECT 1 AS batch, a.*, n FROM a JOIN i USING (h) UNION ALL SELECT 2, b.*, n FROM b JOIN (SELECT * FROM i UNION ALL SELECT * FROM j) USING (h))
        SELECT batch::INT AS batch, CASE WHEN new THEN 'cheque_processed' ELSE 'duplicate_ingestion_skipped' END AS event, 'CHQ-19981231-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS record_id, k::VARCHAR AS source_file,
          CASE WHEN new THEN 'INVALID' END AS verdict, CASE WHEN new THEN '2' END AS ruleset_version, CASE WHEN new THEN 'm' END AS model FROM e
    """,
    "payee_dictionary": """
        WITH e AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '')) AS entry FROM part),
        w AS (SELECT DISTINCT word FROM (SELECT substr(entry, 1, 1) || substr(entry, 3) AS word FROM e UNION ALL SELECT substr(entry, 1, 1) || entry FROM e) WHERE word <> '')
        SELECT word, entry, levenshtein(word, entry)::INT AS distance FROM w, e WHERE levenshtein(word, entry) <= 2
    """,
    "payee_matched": DOCUMENTS
    + """
        SELECT k, CASE WHEN p = 4 THEN c_name WHEN p = 5 THEN 'City of Oshawa' WHEN p <> 6 THEN 'Town of Whitby' END AS matched_name, CASE WHEN p IN (2, 7) THEN 1 WHEN p <> 6 THEN 0 END AS matched_distance FROM d
    """,
    "record_neighbours": """
        SELECT c_custkey, row_number() OVER w AS place, lag(c_custkey) OVER w AS previous, lead(c_custkey) OVER w AS next FROM customer
        WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)
    """,
    "page": "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, o_totalprice FROM orders ORDER BY 1 LIMIT 40 OFFSET 120",
    "medians": """
        SELECT o_orderpriority, count(*) AS n, median(o_totalprice::DOUBLE) AS median FROM orders GROUP BY 1
        UNION ALL SELECT 'all', count(*), median(o_totalprice::DOUBLE) FROM orders
    """,
    "store_merge": """
        SELECT 'C' || c_custkey AS record_id, c_name, CASE WHEN c_custkey % 21 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment,
          floor(c_acctbal)::BIGINT * CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS amount, CASE WHEN c_custkey % 21 = 0 THEN floor(c_acctbal)::BIGINT * 2 END AS was FROM customer
    """,
    "store_counters": DOCUMENTS
    + f""", s AS (
          SELECT k, day, CASE WHEN k % 10 < 9 AND (k // 10) % 10 = 0 THEN r_date WHEN r_date = 'PASS' AND day > DATE '{TODAY}' THEN 'FAIL' ELSE r_date END AS r_date, r_payee, r_amount, r_signature, r_memo FROM v
        ), i AS (
          SELECT unnest(['total', 'year', 'verdict', 'rule', 'rule', 'rule', 'rule', 'rule']) AS name,
            unnest(['', year(day)::VARCHAR, CASE WHEN 'FAIL' IN (r_payee, r_amount, r_signature, r_date, r_memo) THEN 'INVALID' WHEN 'UNABLE' IN (r_payee, r_amount, r_signature, r_date, r_memo) THEN 'REVIEW' ELSE 'VALID' END,
              'payee:' || r_payee, 'amount_match:' || r_amount, 'signature:' || r_signature, 'date:' || r_date, 'memo:' || r_memo]) AS item FROM s
        ) SELECT name, item, count(*) AS n FROM i GROUP BY ALL
    """,
    "revalidate_merged": DOCUMENTS
    + _OVERRIDDEN
    + f"""
        SELECT record_id, '2' AS ruleset_version,
          CASE WHEN k % 3 = 0 THEN (SELECT CASE WHEN x.r_date = 'PASS' AND x.day > DATE '{TODAY}' THEN 'INVALID' ELSE o.verdict END FROM v x WHERE x.k = o.k) WHEN k % 4 = 1 THEN over_verdict ELSE verdict END AS verdict,
          CASE WHEN k % 3 <> 0 AND k % 4 = 1 THEN 'confirmed by a person: payee seen at the desk' END AS payee_told,
          CASE WHEN k % 3 <> 0 AND k % 4 = 1 THEN 'confirmed by a person: signature compared with the card' END AS signature_told FROM o
    """,
    "override_evidence": DOCUMENTS
    + _OVERRIDDEN
    + """
        SELECT record_id, over_verdict AS verdict, 'PASS' AS payee_status, 'payee seen at the desk' AS payee_evidence, 'PASS' AS signature_status, 'signature compared with the card' AS signature_evidence
        FROM o WHERE k % 4 = 1
    """,
    "search_index": "SELECT q AS query, 'R' || c_custkey AS record_id FROM customer, (SELECT unnest([" + ", ".join(f"'{q.strip()}'" for q in QUERIES_SEARCHED) + f"]) AS q) WHERE contains({_TEXT}, lower(q))",
    "response_diagnostics": f"""
        WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN ({RESPONSE})::JSON END AS j FROM orders),
        f AS (SELECT o_orderkey, j->'$.documents[0].fields' AS fs, j->'$.documents[0].fields.PayerSignatures' AS s FROM r),
        p AS (SELECT *, s IS NOT NULL AND json_type(s) <> 'NULL' AS present, coalesce(json_keys(s), []) AS keys FROM f),
        n AS (SELECT *, ['type', 'valueSignature', 'value_signature', 'valueSelectionMark', 'value', 'valueBoolean', 'valueArray', 'content', 'confidence', 'boundingRegions', 'bounding_regions'] AS known FROM p)
        SELECT o_orderkey, present, CASE WHEN NOT present THEN coalesce(array_to_string(list_sort(json_keys(fs)), ','), '') END AS returned,
          CASE WHEN present THEN len(list_filter(keys, lambda x: list_contains(known, x)))::INT END AS n_known,
          CASE WHEN present THEN coalesce(array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains(known, x))), ','), '') END AS others,
          CASE WHEN json_type(s->'boundingRegions') = 'ARRAY' THEN json_array_length(s->'boundingRegions') WHEN json_type(s->'bounding_regions') = 'ARRAY' THEN json_array_length(s->'bounding_regions') END::INT AS regions,
          CASE WHEN json_type(s->'valueArray') = 'ARRAY' THEN json_array_length(s->'valueArray') END::INT AS entries FROM n
    """,
}
