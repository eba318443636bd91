"""The catalogue's queries on profiles of pages, vaults, checks, fusing, codes and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.functions import answers, ids
from leafmark.functions import rects as R
from leafmark.functions import values as V
from leafmark.operators import evaluate, fuse, profile, semantics, vault, verify
from leafmark.plans.catalog import RECTS, millionths, query, rect_rows
from leafmark.storage import table

# pages -----------------------------------------------------------------------------------

_COUNT = lambda tag: f"((length(html) - length(replace(html, '{tag}', ''))) // {len(tag)})"
_MARKS = " + ".join(f"(CASE WHEN regexp_matches(body, '(?i)\\b{p}\\b') THEN 1 ELSE 0 END)" for p in profile.MARKERS.values())
PAGES = f"""f AS (SELECT page_id, page_id % 25 AS doc, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body, {_COUNT('<td')} + {_COUNT('<li')} AS operators, {_COUNT('<div')} % 5 AS rules, {_COUNT('<li')} % 5 AS boxes,
  page_id % 13 = 0 AS widgets, page_id % 3 = 0 AS raster, (page_id % 7) / 7.0 AS share, page_id % 4 <> 0 AS visible FROM pages),
g AS (SELECT *, length(trim(body)) >= 8 AND visible AS native, operators >= 4 AS vector, rules >= 3 OR boxes >= 3 OR {_MARKS} >= 2 AS cues FROM f),
m AS (SELECT *, CASE WHEN widgets THEN 'interactive_form' WHEN NOT native AND NOT vector AND NOT raster THEN 'empty' WHEN raster AND share > 0.6 AND NOT native AND operators <= 12 THEN 'scanned_form'
  WHEN raster AND share > 0.6 AND NOT cues THEN 'scanned_document' WHEN raster AND native AND share > 0.25 THEN 'hybrid' WHEN native AND cues THEN 'flat_native_form'
  WHEN raster AND NOT native THEN CASE WHEN cues THEN 'scanned_form' ELSE 'scanned_document' END ELSE 'native_document' END AS mode FROM g)"""


def page_facts(spark, sf_dir):
    """What each page holds: its text and list tags are its own, widgets, images and visibility follow its id."""
    h, k = F.col("html"), F.col("page_id")
    count = lambda tag: F.floor((F.length(h) - F.length(F.replace(h, F.lit(tag)))) / len(tag)).cast("int")
    facts = table(spark, sf_dir, "pages").select(
        "page_id", (k % 25).alias("doc"), F.regexp_replace(h, "<[^>]*>", " ").alias("body"), (count("<td") + count("<li")).alias("operators"), (count("<div") % 5).alias("rules"), (count("<li") % 5).alias("boxes"),
        (k % 13 == 0).alias("widgets"), (k % 3 == 0).alias("raster"), ((k % 7) / 7.0).alias("share"), (k % 4 != 0).alias("visible"),
    )
    c = F.col
    facts = facts.withColumns({"native": profile.has_native_text(F.length(F.trim("body")), c("visible")), "vector": profile.has_vector(c("operators")), "cues": profile.has_form_cues(c("rules"), c("boxes"), c("body"))})
    return facts.withColumn("mode", profile.page_mode(*(c(x) for x in ("widgets", "native", "vector", "raster", "operators", "share", "cues"))))


@query(f"WITH {PAGES} SELECT page_id, mode, NOT native AND (raster OR mode IN ('scanned_form', 'scanned_document')) AS wants_raster FROM m")
def page_modes(spark, sf_dir):
    return page_facts(spark, sf_dir).select("page_id", "mode", profile.wants_raster(F.col("native"), F.col("raster"), F.col("mode")).alias("wants_raster"))


@query(f"""WITH {PAGES}, d AS (SELECT doc, count(*) AS pages, count_if(mode = 'scanned_form') AS sf, count_if(mode = 'flat_native_form') AS ff, count_if(mode = 'hybrid') AS hy, count_if(mode = 'scanned_document') AS sd, bool_or(widgets) AS w FROM m GROUP BY doc)
SELECT doc, pages, sf + sd AS scanned, CASE WHEN doc % 11 = 0 AND doc % 2 = 0 THEN 'encrypted' WHEN doc % 9 = 0 THEN 'signed' WHEN doc % 8 = 0 THEN 'xfa' WHEN w AND doc % 2 = 1 THEN 'existing_acroform'
  WHEN sf + ff + hy = 0 THEN 'non_form' WHEN hy > 0 AND hy >= greatest(sf, ff) THEN 'hybrid' WHEN ff > 0 AND sf + sd + hy > 0 THEN 'hybrid' WHEN sf >= ff THEN 'scanned_form' ELSE 'flat_native_form' END AS class FROM d""")
def document_routes(spark, sf_dir):
    d = profile.documents(page_facts(spark, sf_dir), "doc")
    k, no = F.col("doc"), F.lit(False)
    where = profile.route(k % 11 == 0, k % 2 == 1, k % 9 == 0, k % 8 == 0, F.col("widgets") & (k % 2 == 1), no, no, F.lit(0))
    return d.select("doc", "pages", (F.col("scanned_form") + F.col("scanned_document")).alias("scanned"), where.alias("class"))


@query("""SELECT o_orderkey AS id, ((-o_orderkey) >> 3) & 1 = 1 AS modify, ((-o_orderkey) >> 8) & 1 = 1 AS fill, CASE WHEN o_orderkey % 17 = 1 THEN 'certified against changes' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'not authenticated'
  WHEN o_orderkey % 3 = 0 AND ((-o_orderkey) >> 3) & 1 = 0 AND ((-o_orderkey) >> 5) & 1 = 0 THEN 'permissions do not allow it' ELSE '' END AS reason FROM orders""")
def permission_bits(spark, sf_dir):
    k = F.col("o_orderkey")
    allowed = profile.can_add_fields(k % 3 == 0, k % 5 != 0, -k, (k % 17).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), profile.has_permission(-k, profile.MODIFY).alias("modify"), profile.has_permission(-k, profile.FILL).alias("fill"), allowed["reason"].alias("reason"))


# codes, ids, answers -----------------------------------------------------------------------

_CASES = lambda names: "CASE lower(n) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE n END"
_STATES, _COUNTRIES = list(V.STATES), list(V.COUNTRIES)


@query(f"""WITH s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE ['{"', '".join(_COUNTRIES)}'][n_nationkey * 3 % {len(_COUNTRIES)} + 1] END AS n, ['{"', '".join(_STATES)}'][n_nationkey * 2 + 1] AS st FROM nation)
SELECT id, CASE WHEN regexp_full_match(n, '[A-Za-z][A-Za-z]') THEN upper(n) ELSE {_CASES(V.COUNTRIES)} END AS country, (SELECT {_CASES(V.STATES)} FROM (SELECT s.st AS n)) AS state FROM s""")
def region_codes(spark, sf_dir):
    k = F.col("n_nationkey")
    state = F.get(F.array(*map(F.lit, _STATES)), (k * 2).cast("int"))
    country = F.when(k % 5 == 0, F.col("n_name")).otherwise(F.get(F.array(*map(F.lit, _COUNTRIES)), (k * 3 % len(_COUNTRIES)).cast("int")))
    return table(spark, sf_dir, "nation").select(k.alias("id"), V.country_iso2(country).alias("country"), V.state_abbrev(F.initcap(state)).alias("state"))


@query("""WITH s AS (SELECT c_custkey AS id, [2 + 2 * (c_custkey % 2), 2, 2 + 2 * (c_custkey // 2 % 2)] AS n FROM customer)
SELECT id, CASE WHEN n = [2, 2, 4] THEN 'MM/DD/YYYY' WHEN n = [4, 2, 2] THEN 'YYYY/MM/DD' WHEN n = [2, 2, 2] THEN 'MM/DD/YY' ELSE repeat('N', n[1]::INT) || '/' || repeat('N', n[2]::INT) || '/' || repeat('N', n[3]::INT) END AS hint FROM s""")
def date_hints(spark, sf_dir):
    k = F.col("c_custkey")
    sizes = F.array((2 + 2 * (k % 2)).cast("int"), F.lit(2), (2 + 2 * (F.floor(k / 2) % 2)).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), V.date_hint(sizes, "/").alias("hint"))


@query(f"""WITH {RECTS} SELECT page, id, 'fc_' || substr(sha256(page || '|' || (x0 * 1000)::BIGINT || '|' || (y0 * 1000)::BIGINT || '|' || (x1 * 1000)::BIGINT || '|' || (y1 * 1000)::BIGINT || '|' || kind), 1, 16) AS stable FROM rects""")
def stable_ids(spark, sf_dir):
    return rect_rows(spark, sf_dir).select("page", "id", ids.candidate_id(F.col("page"), F.col("r"), F.col("kind")).alias("stable"))


@query("SELECT event_id, 'k' AS path, props ->> '$.k' AS value, 'int' AS kind FROM events")
def json_walk(spark, sf_dir):
    return answers.flatten(table(spark, sf_dir, "events"), "event_id", "props")


@query("""SELECT event_id, event_id % 5 IN (0, 1) AS ok, CASE WHEN event_id % 5 = 4 THEN 'unknown' ELSE event_type END AS signature FROM events""")
def answers_valid(spark, sf_dir):
    """Answers to a closed question, some with a wrong type, a confidence over 1, or no JSON at all."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    text = F.when(k == 4, F.lit("{")).otherwise(F.concat(F.lit('{"canonical_key": "'), F.col("event_type"), F.lit('", "confidence": '), F.when(k == 2, "1.5").when(k == 3, '"high"').otherwise("0.5"), F.lit("}")))
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the options of a closed question
    found = answers.validate(e.select("event_id", text.alias("answer")), answers.schema("canonical_key", kinds))
    return found.select("event_id", "ok", answers.signature(F.lit("canonical_key"), F.col("answer")).alias("signature"))


@query("""WITH o AS (SELECT user_id AS page, event_type AS id, 'key' || (props ->> '$.k') AS canonical_key, max(floor(value * 100)::BIGINT) AS score FROM events GROUP BY ALL)
SELECT page, id, canonical_key, score, row_number() OVER (PARTITION BY page, id ORDER BY score DESC, canonical_key) AS place FROM o QUALIFY place <= 12""")
def options_top12(spark, sf_dir):
    key = F.concat(F.lit("key"), F.get_json_object("props", "$.k"))
    o = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page"), F.col("event_type").alias("id"), key.alias("canonical_key")).agg(F.max(F.floor(F.col("value") * 100).cast("long")).alias("score"))
    return fuse.resolve_options(o).withColumn("place", F.col("place").cast("long"))


# vaults --------------------------------------------------------------------------------------

VAULT = """v AS (SELECT c_custkey AS profile_id, unnest([
  {'key': 'person.name.first', 'value': split_part(c_mktsegment, ' ', 1), 'confidence': 0.9}, {'key': 'person.name.last', 'value': 'Last' || c_custkey, 'confidence': 0.8 + (c_custkey % 3) / 100.0},
  {'key': 'person.name.middle', 'value': CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Q' ELSE 'Maria' END, 'confidence': 1.0}, {'key': 'billing.address.street_1', 'value': c_custkey || ' Main St', 'confidence': 0.7},
  {'key': 'billing.address.city', 'value': CASE WHEN c_custkey % 4 > 0 THEN 'Town' || c_nationkey END, 'confidence': 0.95}, {'key': 'billing.address.region', 'value': 'R' || c_nationkey, 'confidence': 0.85},
  {'key': 'billing.address.postal_code', 'value': CASE WHEN c_custkey % 2 = 0 THEN '0' || c_nationkey END, 'confidence': 1.0}], max_depth := 2) FROM customer),
e AS (SELECT profile_id, key, value, confidence FROM v WHERE value IS NOT NULL)"""
DERIVED = """w AS (SELECT profile_id, max(value) FILTER (key = 'person.name.first') AS f, max(value) FILTER (key = 'person.name.last') AS l, max(value) FILTER (key = 'person.name.middle') AS m, max(confidence) FILTER (key = 'person.name.last') AS lc,
  max(value) FILTER (key = 'billing.address.street_1') AS s, max(value) FILTER (key = 'billing.address.city') AS c, max(value) FILTER (key = 'billing.address.region') AS r, max(value) FILTER (key = 'billing.address.postal_code') AS p FROM e GROUP BY profile_id),
d AS (SELECT profile_id, 'person.name.full' AS key, f || ' ' || CASE WHEN m IS NULL THEN '' WHEN length(m) > 1 THEN m[1] || '. ' ELSE m || ' ' END || l AS value, floor(round(lc * 0.98, 4) * 1e4 + 0.5)::BIGINT AS confidence FROM w
  UNION ALL SELECT profile_id, 'person.name.initials', upper(f[1] || l[1]), floor(round(lc * 0.98, 4) * 1e4 + 0.5)::BIGINT FROM w
  UNION ALL SELECT profile_id, 'billing.address.full', s || ', ' || c || ', ' || r || CASE WHEN p IS NULL THEN '' ELSE ' ' || p END, floor(0.7 * 0.98 * 1e4 + 0.5)::BIGINT FROM w WHERE c IS NOT NULL)"""


def vault_rows(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    one = lambda key, value, confidence: F.struct(F.lit(key).alias("key"), value.alias("value"), confidence.cast("double").alias("confidence"))
    parts = F.array(
        one("person.name.first", F.element_at(F.split("c_mktsegment", " "), 1), F.lit(0.9)), one("person.name.last", F.concat(F.lit("Last"), k.cast("string")), 0.8 + (k % 3) / 100),
        one("person.name.middle", F.when(k % 3 == 1, "Q").when(k % 3 == 2, "Maria"), F.lit(1.0)), one("billing.address.street_1", F.concat(k.cast("string"), F.lit(" Main St")), F.lit(0.7)),
        one("billing.address.city", F.when(k % 4 > 0, F.concat(F.lit("Town"), n)), F.lit(0.95)), one("billing.address.region", F.concat(F.lit("R"), n), F.lit(0.85)),
        one("billing.address.postal_code", F.when(k % 2 == 0, F.concat(F.lit("0"), n)), F.lit(1.0)),
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("profile_id"), F.explode(parts).alias("e")).select("profile_id", "e.*").where("value IS NOT NULL")
    secret = F.when(F.col("key").startswith("person.name.m"), "secret").otherwise("normal")
    return rows.withColumns({"source": F.when(F.col("profile_id") % 5 == 0, "prior_form").otherwise("manual"), "sensitivity": secret, "labels_seen": F.array(F.concat(F.lit(" Label "), F.element_at(F.split("key", "[.]"), -1)))})


@query(f"WITH {VAULT}, {DERIVED} SELECT * FROM d")
def vault_derived(spark, sf_dir):
    return vault.derived(vault_rows(spark, sf_dir)).select("profile_id", "key", "value", F.floor(F.col("confidence") * 1e4 + 0.5).cast("long").alias("confidence"))


@query(f"""WITH {VAULT}, {DERIVED}, f AS (SELECT o_orderkey AS field, o_custkey AS profile_id, CASE o_orderkey % 3 WHEN 0 THEN 'person.name.full' WHEN 1 THEN 'person.address.city' ELSE 'person.name.first' END AS key, o_orderkey % 2 = 0 AS billing FROM orders)
SELECT f.field, coalesce(s.value, x.value, d.value) AS value, CASE WHEN s.value IS NOT NULL THEN 'scoped' WHEN x.value IS NOT NULL THEN 'exact' WHEN d.value IS NOT NULL THEN 'derived' END AS step
FROM f LEFT JOIN e s ON f.billing AND s.profile_id = f.profile_id AND s.key = regexp_replace(f.key, '^[^.]+\\.', 'billing.') LEFT JOIN e x ON x.profile_id = f.profile_id AND x.key = f.key LEFT JOIN d ON d.profile_id = f.profile_id AND d.key = f.key""")
def vault_resolve(spark, sf_dir):
    k = F.col("o_orderkey")
    fields = table(spark, sf_dir, "orders").select(k.alias("field"), F.col("o_custkey").alias("profile_id"), F.when(k % 3 == 0, "person.name.full").when(k % 3 == 1, "person.address.city").otherwise("person.name.first").alias("key"), F.when(k % 2 == 0, F.array(F.lit("Part 2"), F.lit(" Billing "))).otherwise(F.array(F.lit("Part 1"))).alias("context"))
    return vault.resolve(fields, vault_rows(spark, sf_dir)).select("field", "value", "step")


@query(f"""WITH {VAULT}, n AS (SELECT o_custkey AS profile_id, 'person.name.first' AS key, max(o_orderpriority) AS value FROM orders GROUP BY o_custkey)
SELECT profile_id, key, value FROM e WHERE (profile_id, key) NOT IN (SELECT (profile_id, key) FROM n) UNION ALL SELECT profile_id, key, value FROM n""")
def vault_put(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("profile_id")).agg(F.max("o_orderpriority").alias("value")).withColumn("key", F.lit("person.name.first"))
    return vault.put(vault_rows(spark, sf_dir), new).select("profile_id", "key", "value")


@query(f"""WITH {VAULT}, k AS (SELECT *, CASE WHEN profile_id % 5 = 0 THEN 'prior_form' ELSE 'manual' END AS source, CASE WHEN starts_with(key, 'person.name.m') THEN 'secret' ELSE 'normal' END AS sensitivity FROM e)
SELECT 'source' AS "by", source AS name, count(*) AS entries FROM k GROUP BY source UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM k GROUP BY sensitivity UNION ALL SELECT 'all', NULL, count(*) FROM k""")
def vault_counts(spark, sf_dir):
    return vault.stats(vault_rows(spark, sf_dir))


@query("""WITH f AS (SELECT 'k' || (o_custkey % 50) AS key, o_orderpriority AS value, floor(o_totalprice)::BIGINT % 100 / 100.0 AS c FROM orders WHERE o_orderstatus = 'F')
SELECT key, value, floor(c * 100 + 0.5)::BIGINT AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, value) = 1""")
def vault_from_fills(spark, sf_dir):
    fills = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")).alias("canonical_key"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("invalid").alias("status"), (F.floor("o_totalprice") % 100 / 100).alias("confidence"))
    return vault.from_fills(fills).select("key", "value", F.floor(F.col("confidence") * 100 + 0.5).cast("long").alias("confidence"))


# checks ----------------------------------------------------------------------------------------

FORM = """w AS (SELECT o_orderkey AS k, 'f' || o_orderkey AS name, CASE WHEN o_orderkey % 10 = 0 THEN 'radio' ELSE 'text' END AS t, o_orderpriority AS v, o_custkey % 5 AS m FROM orders),
r AS (SELECT name, CASE WHEN k % 6 = 0 THEN 'date' ELSE t END AS t, CASE WHEN k % 4 = 0 THEN v || '!' ELSE v END AS v, CASE WHEN k % 9 = 0 THEN 3 ELSE m END AS m FROM w WHERE k % 11 <> 0),
j AS (SELECT w.*, r.name IS NOT NULL AS there, r.t AS rt, r.v AS rv, r.m AS rm FROM w LEFT JOIN r USING (name))"""


@query(f"""WITH {FORM} SELECT 'error' AS severity, 'FIELD_MISSING' AS code, name AS field FROM j WHERE NOT there UNION ALL SELECT 'error', 'FIELD_TYPE_MISMATCH', name FROM j WHERE there AND t <> 'radio' AND t <> rt
UNION ALL SELECT 'warning', 'FIELD_VALUE_MISMATCH', name FROM j WHERE there AND t <> 'radio' AND v <> rv UNION ALL SELECT 'warning', 'FIELD_MAXLEN_MISMATCH', name FROM j WHERE there AND m > 0 AND rm > 0 AND m <> rm""")
def verify_roundtrip(spark, sf_dir):
    k = F.col("k")
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 10 == 0, "radio").otherwise("text").alias("field_type"), F.col("o_orderpriority").alias("value"), (F.col("o_custkey") % 5).alias("max_length"))
    r = w.where(k % 11 != 0).select("name", F.when(k % 6 == 0, "date").otherwise(F.col("field_type")).alias("field_type"), F.when(k % 4 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"), F.when(k % 9 == 0, 3).otherwise(F.col("max_length")).alias("max_length"))
    return verify.roundtrip(w, r).select("severity", "code", "field")


@query("""WITH c AS (SELECT c_custkey, c_name AS v, c_custkey % 30 AS most, CASE WHEN c_custkey % 3 = 0 THEN 18 ELSE 17 END AS cells, c_custkey % 7 <> 0 AS filled FROM customer)
SELECT 'c' || c_custkey AS field, CASE WHEN length(v) > 1.15 * most THEN 'longer than the field' WHEN length(v) > cells THEN 'more characters than cells' WHEN NOT regexp_full_match(v, 'Customer.*[0-8]') THEN 'does not match the pattern' END AS broken
FROM c WHERE filled AND (length(v) > 1.15 * most OR length(v) > cells OR NOT regexp_full_match(v, 'Customer.*[0-8]'))""")
def verify_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("value"), (F.col("c_custkey") % 30).alias("max_chars"), F.when(F.col("c_custkey") % 3 == 0, 18).otherwise(17).alias("comb_cells"), F.lit("Customer.*[0-8]").alias("pattern"), F.array().cast("array<string>").alias("choices"), F.when(F.col("c_custkey") % 7 != 0, "filled").otherwise("invalid").alias("status"))
    out = verify.values_validate(c.drop("value", "status"), c.select("name", "status", "value"))
    return out.select("field", F.element_at(F.split("message", ": ", 2), 2).alias("broken"))


@query("""WITH f AS (SELECT doc_id AS doc, encode(coalesce(text, '')) AS a, CASE WHEN doc_id % 3 = 0 THEN encode(coalesce(text, '') || 'tail') ELSE encode(substr(coalesce(text, ''), 1, (doc_id % 50)::INT) || chr(1) || 'rest') END AS b FROM documents)
SELECT doc, CASE WHEN doc % 3 = 0 OR b[:octet_length(a)] = a THEN 'PREFIX_PRESERVED' ELSE 'PREFIX_NOT_PRESERVED' END AS code,
  CASE WHEN doc % 3 = 0 OR b[:octet_length(a)] = a THEN 'original bytes are a literal prefix' ELSE 'output diverges from the original at byte offset ' || (octet_length(b) - 5) END AS message FROM f""")
def verify_prefix(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    part = F.concat(F.substr(text, F.lit(1), (F.col("doc_id") % 50).cast("int")), F.lit("\x01rest"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.encode(text, "UTF-8").alias("original"), F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("tail"))).otherwise(part), "UTF-8").alias("produced"))
    return verify.prefix_preserved(files).select("doc", "code", "message")


@query(f"""WITH {RECTS} SELECT 'FIELD_OUT_OF_BOUNDS' AS code, page, id AS field FROM rects WHERE x0 < 0 OR y0 < 0 OR x1 > 600 + page % 13 OR y1 > 792""")
def verify_bounds(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    pages = rows.select("page").distinct().withColumn("crop", R.rect(F.lit(0.0), F.lit(0.0), (600 + F.col("page") % 13).cast("double"), F.lit(792.0)))
    return verify.in_bounds(rows, pages).select("code", "page", "field")


# fusing and measures ------------------------------------------------------------------------------

_TYPES = ("text", "date", "checkbox", "unknown", "radio", "currency", "number")
CANDIDATES = f"""c AS (SELECT r.*, page % 2 AS cluster, l.l_suppkey % 7 AS t, (l.l_partkey % 90 + 5) / 100.0::DOUBLE AS g, l.l_suppkey % 100 / 100.0 AS ll, ['vector_line', 'blank_region', 'label_link', 'model'][l.l_partkey % 4 + 1] AS ev
  FROM rects r JOIN (SELECT l_orderkey AS page, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id, l_partkey, l_suppkey FROM lineitem) l USING (page, id))"""


def candidates(spark, sf_dir):
    """Candidates from lineitem: type, confidences and evidence follow its keys."""
    part, supp = (F.element_at(F.split("id", "-"), i).cast("long") for i in (2, 3))
    kind = F.get(F.array(*map(F.lit, ("vector_line", "blank_region", "label_link", "model"))), (part % 4).cast("int"))
    empty = F.array().cast("array<string>")
    return rect_rows(spark, sf_dir).select(
        "page", "id", "r", F.get(F.array(*map(F.lit, _TYPES)), (supp % 7).cast("int")).alias("field_type"), ((part % 90 + 5) / 100).alias("geometry"), (supp % 100 / 100).alias("label_link"), F.lit(0.5).alias("semantic_type"), F.lit(0.0).alias("autofill_value"),
        F.lit(None).cast("string").alias("label"), F.when(supp % 3 == 0, F.concat(F.lit("key"), (supp % 9).cast("string"))).alias("canonical_key"), F.lit(None).cast("string").alias("group_id"), F.array(kind).alias("sources"), empty.alias("contexts"),
        F.array(F.struct(kind.alias("kind"), ((part % 90 + 5) / 100).alias("score"), F.lit("").alias("detail"))).alias("evidence"),
    )


_SPECIFIC = "[" + ", ".join(str(fuse.SPECIFIC[t]) for t in _TYPES) + "]"
_NAMES = "['" + "', '".join(_TYPES) + "']"


@query(f"""WITH {RECTS}, {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY g DESC, y1 DESC, x0, x1, id) AS place, row_number() OVER (PARTITION BY page ORDER BY {_SPECIFIC}[t + 1] DESC, g DESC, y1 DESC, x0, x1, id) AS by_type FROM c),
s AS (SELECT page, ev, max(g) AS g FROM c GROUP BY page, ev), w AS (SELECT page, count(*) AS witnesses, max(g) AS top, product(1 - g) AS rest FROM s GROUP BY page)
SELECT page, max(id) FILTER (place = 1) AS id, max({_NAMES}[t + 1]) FILTER (by_type = 1) AS field_type, count(*) AS members, floor(max(ll) * 100 + 0.5)::BIGINT AS label_link, array_to_string(list_sort(list(DISTINCT ev)), ',') AS sources,
  any_value((SELECT floor(CASE WHEN witnesses < 2 THEN top ELSE greatest(top, least(0.999, 1 - rest)) END * 1e6 + 0.5)::BIGINT FROM w WHERE w.page = o.page)) AS geometry FROM o GROUP BY page""")
def merge_clusters(spark, sf_dir):
    """All candidates of a page as one cluster."""
    merged = fuse.merge_clusters(candidates(spark, sf_dir).withColumn("cluster", F.col("page") % 2))
    return merged.select("page", "id", "field_type", "members", F.floor(F.col("label_link") * 100 + 0.5).cast("long").alias("label_link"), F.array_join("sources", ",").alias("sources"), millionths(F.col("geometry")).alias("geometry"))


_WEIGHT = "CASE ev WHEN 'vector_line' THEN 0.30 WHEN 'blank_region' THEN 0.20 WHEN 'label_link' THEN 0.15 ELSE 0.05 END"


@query(f"""WITH {RECTS}, {CANDIDATES}, s AS (SELECT *, {_WEIGHT}::DOUBLE * g AS score FROM c) SELECT page, id, floor(score * 1e6 + 0.5)::BIGINT AS score, row_number() OVER (PARTITION BY page ORDER BY score DESC, y1 DESC, x0, x1, id) AS place FROM s""")
def rank_candidates(spark, sf_dir):
    return fuse.rank(candidates(spark, sf_dir)).select("page", "id", millionths(F.col("score")).alias("score"), F.col("place").cast("long").alias("place"))


@query(None)
def fuse_candidates(spark, sf_dir):
    """Clusters merged, overlaps suppressed, the weak left out: no SQL, as each decision hangs on those before it."""
    out = fuse.fuse(candidates(spark, sf_dir))
    return out.select("page", "id", "field_type", *(millionths(F.col("r")[e]).alias(e) for e in ("x0", "y0", "x1", "y1")), F.col("order").cast("long").alias("order"))


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderpriority AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN ' ' || lower(o_orderpriority) ELSE 'other' END AS b, o_custkey % 3 AS ka, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS kb FROM orders)
SELECT floor(avg(CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5)::BIGINT AS label_association, floor(avg(CASE WHEN ka = kb THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5)::BIGINT AS canonical_accuracy,
  (SELECT floor(avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5)::BIGINT FROM (SELECT ka, k % 500 AS g, count(DISTINCT b) AS n FROM m GROUP BY ALL)) AS repeat_consistency FROM m""")
def evaluate_matches(spark, sf_dir):
    k = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("pred_label"), F.when(k % 4 == 1, F.concat(F.lit(" "), F.lower("o_orderpriority"))).when(k % 4 > 1, "other").alias("truth_label"), (F.col("o_custkey") % 3).alias("pred_key"), F.when(k % 5 != 0, k % 3).alias("truth_key"))
    groups = m.select(F.struct("pred_key", F.col("k") % 500).alias("g"), "truth_label")
    row = evaluate.evaluate(evaluate.association(m), evaluate.repeat_consistency(groups, "g", "truth_label"))
    return row.select(*(millionths(F.col(c)).alias(c) for c in row.columns))


@query("""WITH f AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT count(*) AS n, count_if(f.value = e.value) AS correct, floor(avg(CASE WHEN f.value = e.value THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5)::BIGINT AS exact_match_rate FROM f JOIN e USING (key)""")
def autofill_exact_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    want = c.where("key % 2 = 0").withColumn("value", F.when(F.col("key") % 5 == 0, "x").otherwise(F.col("value")))
    return evaluate.exact_match(c.where("key % 3 <> 0"), want).withColumn("exact_match_rate", millionths(F.col("exact_match_rate")))


@query(None)
def word_error_rates(spark, sf_dir):
    """Each benchmark item read with its own first word left out and its last one twice."""
    words = F.split(F.trim("text"), " +")
    read = F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.element_at(words, -1))
    b = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), read.alias("read"), F.col("text").alias("truth"))
    out = evaluate.error_rates(b)
    return out.select("id", "char_edits", millionths(F.col("cer")).alias("cer"), "word_edits", millionths(F.col("wer")).alias("wer"))


# meaning -------------------------------------------------------------------------------------------

#: Label, sections and texts nearby, and what the cascade should make of them: written by hand.
READINGS = (
    ("First Name:", (), (), "person.name.first", 970000), ("City", ("Billing",), (), "billing.address.city", 950000), ("Number", (), ("Card number", "Expiration"), "card.number", 930000), ("", (), ("##-#######",), "company.tax_id.ein", 900000),
    ("Street", ("Part 1", "bill to"), (), "billing.address.street", 950000), ("code", ("Zip",), (), "person.address.zip", 880000), ("Reference", (), ("555-123-4567",), "person.phone.mobile", 820000), ("Emial address", (), (), "person.email", 784550),
    ("Zzz qqq", (), (), None, 0), ("Your surname", ("Part 2",), ("Town",), "person.name.last", 970000), ("Phone number", ("Employment",), (), "employment.phone", 950000),
)
#: Label, what is drawn, height, texts nearby, whether a currency sign stands left, marks beside, and the type it should be.
KINDS = (
    ("Email address", "text", 12, (), False, 0, "email", 780000), ("Any", "checkbox", 12, (), False, 0, "checkbox", 950000), ("Notes", "text", 40, (), False, 0, "multiline_text", 700000), ("Zzz", "unknown", 12, (), False, 0, "text", 400000),
    ("Amount due", "text", 12, (), True, 0, "currency", 800000), ("Start date", "text", 12, (), False, 0, "date", 450000), ("Birth date", "text", 12, ("MM/DD/YYYY",), False, 0, "date", 970080), ("Please check one", "text", 12, (), False, 0, "choice", 650000),
    ("Pick", "text", 12, (), False, 3, "choice", 650000), ("Full name", "text", 12, (), False, 0, "text", 780000),
)


def _pick(rows: tuple, at: int, key, kind: str):
    """The at-th part of the row that a key chooses."""
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v).cast(kind)
    return F.get(F.array(*(lit(r[at]) for r in rows)), (key % len(rows)).cast("int"))


def _sql(rows: tuple) -> str:
    return ", ".join(f"({i}, {'NULL' if r[-2] is None else repr(r[-2])}, {r[-1]})" for i, r in enumerate(rows))


@query(f"SELECT c_custkey AS id, v.key AS canonical_key, v.score::BIGINT AS score FROM customer JOIN (VALUES {_sql(READINGS)}) AS v(i, key, score) ON c_custkey % {len(READINGS)} = v.i")
def canonicalize_fields(spark, sf_dir):
    """A field for each customer, its label and surroundings by its key."""
    k = F.col("c_custkey")
    fields = table(spark, sf_dir, "customer").select(F.lit(0).alias("page"), k.alias("id"), _pick(READINGS, 0, k, "string").alias("label"), _pick(READINGS, 1, k, "").alias("parents"), _pick(READINGS, 2, k, "").alias("nearby"))
    return semantics.canonicalize(fields).select("id", "canonical_key", millionths(F.col("key_score")).alias("score"))


@query(f"SELECT c_custkey AS id, v.kind AS field_type, v.score::BIGINT AS score FROM customer JOIN (VALUES {_sql(KINDS)}) AS v(i, kind, score) ON c_custkey % {len(KINDS)} = v.i")
def infer_types(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda at, kind: _pick(KINDS, at, k, kind)
    found = semantics.infer_type(pick(0, "string"), F.array().cast("array<string>"), pick(1, "string"), pick(2, "double"), F.lit(12.0), pick(3, ""), pick(4, "boolean"), pick(5, "int"))
    t = table(spark, sf_dir, "customer").select(k.alias("id"), found.alias("t"))
    return t.select("id", F.col("t.field_type").alias("field_type"), millionths(F.col("t.confidence")).alias("score"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey % 50 AS page, 'key' || (o_custkey % 7) AS k, 'label ' || (o_orderkey % 3) AS l, floor(o_totalprice)::BIGINT % 100 AS s FROM orders),
b AS (SELECT page, k, max(s) AS s, arg_min(l, (-s, id)) AS l FROM f GROUP BY page, k) SELECT id, CASE WHEN b.s - f.s >= 8 AND b.l <> f.l THEN NULL ELSE f.k END AS canonical_key FROM f JOIN b USING (page, k)""")
def key_conflicts(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("page"), F.concat(F.lit("key"), (F.col("o_custkey") % 7).cast("string")).alias("canonical_key"), F.concat(F.lit("Label "), (F.col("o_orderkey") % 3).cast("string")).alias("label"), (F.floor("o_totalprice") % 100 / 100).alias("key_score"), F.lit("").alias("key_reason"))
    return semantics.without_conflicts(f).select("id", "canonical_key")
