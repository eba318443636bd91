"""The catalogue's queries on text, values, measures, limits, nested data and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import patterns as P
from leafmark.functions import rects as R
from leafmark.functions import text as T
from leafmark.functions import values as V
from leafmark.operators import decide, labels, measure, runs, spatial
from leafmark.plans.catalog import PAIRS, RECTS, millionths, query, rect_rows
from leafmark.storage import table


def doc_lines(spark, sf_dir) -> DataFrame:
    """doc_id, pos and line of every line of documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


def doc_words(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "[ \n]", -1)).alias("pos", "word")).where("word <> ''")


WORDS = r"""words AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word,
  generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS pos FROM documents) WHERE word <> '')"""

#: normalize_label in SQL.
_LABEL = r"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(translate(line, '‐‑‒–—―−’‘', '-------''''')),
  '''s( |$)', '\1', 'g'), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '^ *([0-9]{1,3}|[a-z])[.)] +', ''), '&', ' and '), '[^0-9a-z]+', ' ', 'g'))"""


@query(f"WITH {LINES} SELECT doc_id, pos, {_LABEL} AS label FROM lines")
def normalize_label_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalize_label(F.col("line")).alias("label"))


_T = "trim(line, ' ')"
_LETTERS, _DIGITS = f"length(regexp_replace({_T}, '[^A-Za-z]', '', 'g'))", f"length(regexp_replace({_T}, '[^0-9]', '', 'g'))"
_SCORE = f"""CASE WHEN {_T} = '' THEN 0 ELSE
  CASE WHEN {_LETTERS} >= 3 AND {_T} = upper({_T}) AND {_T} <> lower({_T}) THEN 28 ELSE 0 END
  + CASE WHEN regexp_matches({_T}, '{T.NUMBERING}') THEN 22 ELSE 0 END
  + CASE WHEN {_T} LIKE '%:' THEN -20 ELSE 10 END + CASE WHEN length({_T}) <= 40 THEN 5 ELSE 0 END
  + CASE WHEN length({_T}) > 80 THEN -35 ELSE 0 END + CASE WHEN {_LETTERS} > 0 AND {_DIGITS} > {_LETTERS} THEN -20 ELSE 0 END
  + CASE WHEN regexp_matches({_T}, '[_.]{{4,}}') THEN -30 ELSE 0 END END"""


@query(f"WITH {LINES} SELECT doc_id, pos, {_SCORE} AS score FROM lines")
def heading_score_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.heading_score(F.col("line")).cast("long").alias("score"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, pos, {_SCORE} AS score FROM lines), top AS (SELECT * FROM h WHERE score >= 15)
SELECT doc_id, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY score DESC) AS level, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pos FROM top""")
def heading_levels(spark, sf_dir):
    """Headings' levels by falling score, and where each one's section ends."""
    h = heading_score_lines(spark, sf_dir).where("score >= 15")
    return h.select("doc_id", "pos", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("score"))).cast("long").alias("level"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).alias("next_pos"))


_REDACT = r"""CASE WHEN regexp_matches(t, '^[^@ ]+@[^@ ]+\.[A-Za-z#]{2,}$') THEN regexp_replace(t, '[A-Za-z]', 'x', 'g') ELSE t END"""


@query(rf"""WITH {WORDS}, all_texts AS (SELECT doc_id, -1 AS pos, text FROM documents UNION ALL SELECT doc_id, pos, word FROM words WHERE word LIKE '%@%'), t AS (
SELECT doc_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g'), ' '), '[0-9]', '#', 'g') AS t FROM all_texts)
SELECT doc_id, pos, substr({_REDACT}, 1, 200) AS shown FROM t""")
def redact_text_docs(spark, sf_dir):
    """Whole documents (pos -1) and their words with an at sign."""
    words = doc_words(spark, sf_dir).where(F.col("word").contains("@")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("word").alias("text"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long").alias("pos"), "text").unionByName(words)
    return texts.select("doc_id", "pos", T.redact(F.col("text")).alias("shown"))


_SHAPES = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in T.SECRET_SHAPES.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_SHAPES}], lambda x: x IS NOT NULL), ',') AS shapes FROM documents")
def secret_shape_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.secret_shapes(F.coalesce("text", F.lit(""))), ",").alias("shapes"))


_LUHN = """list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 1
  THEN CASE WHEN 2 * substr(d, i, 1)::INT > 9 THEN 2 * substr(d, i, 1)::INT - 9 ELSE 2 * substr(d, i, 1)::INT END ELSE substr(d, i, 1)::INT END))"""


@query(rf"""WITH {WORDS}, n AS (SELECT doc_id, pos, regexp_replace(word, '[^0-9]', '', 'g') AS d FROM words)
SELECT doc_id, pos, d AS digits, length(d) >= 12 AND {_LUHN} % 10 = 0 AS ok FROM n WHERE length(d) >= 12""")
def luhn_scan_docs(spark, sf_dir):
    d = V.digits_only(F.col("word"))
    return doc_words(spark, sf_dir).where(F.length(d) >= 12).select("doc_id", F.col("pos").cast("long").alias("pos"), d.alias("digits"), V.luhn_ok(d).alias("ok"))


def _bare(c):
    return F.regexp_replace(c, "[.,;:!?]+$", "")


_RULES = P.RULES["value"]


@query("WITH " + WORDS + ", b AS (SELECT doc_id, pos, regexp_replace(word, '[.,;:!?]+$', '') AS w FROM words), r AS (SELECT doc_id, pos, CASE "
       + " ".join(f"WHEN regexp_full_match(w, '{r[1]}') THEN '{r[0]}'" for r in _RULES) + " END AS rule FROM b) SELECT doc_id, pos, rule FROM r WHERE rule IS NOT NULL")
def pattern_classify_tokens(spark, sf_dir):
    """The best value rule of each word; words that no rule takes are left out before they become rows."""
    bare = F.transform(F.split("text", "[ \n]", -1), lambda w, i: F.struct(i.cast("long").alias("pos"), _bare(w).alias("bare")))
    odd = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(bare, lambda r: r["bare"].rlike(P.any_of("value")))).alias("r")).select("doc_id", "r.pos", "r.bare")
    return odd.select("doc_id", "pos", P.match(F.col("bare"), "value")["name"].alias("rule"))


_N = lambda p: f"length(regexp_replace(word, '[^{p}]', '', 'g'))"
_MIX = f"""{_N('A-Za-z')} > 0 AND {_N('0-9')} > 0 AND (({_N('A-Za-z')} < {_N('0-9')} AND {_N('OoIlZzSsBg')} = {_N('A-Za-z')}) OR ({_N('0-9')} < {_N('A-Za-z')} AND {_N('01258')} = {_N('0-9')}))"""


@query(f"WITH {WORDS} SELECT doc_id, pos, word FROM words WHERE {_MIX} OR length(word) % 10 = 9")
def suspect_words(spark, sf_dir):
    """Words read with low confidence (here a function of their length) or in an implausible mix."""
    w = F.col("word")
    return doc_words(spark, sf_dir).where(T.implausible_mix(w) | (F.length(w) % 10 == 9)).select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


_DIG, _LET = "translate({0}, 'OoIlZzSsBg', '0011225589')", "translate({0}, '01258', 'OIZSB')"
_OTHER = "CASE WHEN translate(substr(word, i, 1), 'OoIlZzSsBg', '0011225589') <> substr(word, i, 1) THEN translate(substr(word, i, 1), 'OoIlZzSsBg', '0011225589') ELSE translate(substr(word, i, 1), '01258', 'OIZSB') END"


@query(f"""WITH {WORDS}, w AS (SELECT DISTINCT word FROM words WHERE regexp_matches(word, '[0-9]')), a AS (
  SELECT word, list_concat([{_DIG.format('word')}, {_LET.format('word')}], list_transform(generate_series(1, length(word)), lambda i: substr(word, 1, i - 1) || {_OTHER} || substr(word, i + 1))) AS l FROM w),
e AS (SELECT word, unnest(l) AS other, generate_subscripts(l, 1) AS k FROM a), d AS (SELECT word, other, min(k) AS k FROM e WHERE other <> word GROUP BY word, other),
first AS (SELECT word, other FROM d QUALIFY row_number() OVER (PARTITION BY word ORDER BY k) <= 16)
SELECT word, coalesce(string_agg(other, ' ' ORDER BY other), '') AS others FROM w LEFT JOIN first USING (word) GROUP BY word""")
def suspect_alternatives(spark, sf_dir):
    """Other readings of each word with a digit: sixteen at most, as the operator gives."""
    w = doc_words(spark, sf_dir).where(F.col("word").rlike("[0-9]")).select("word").distinct()
    return w.select("word", F.array_join(F.array_sort(T.alternatives(F.col("word"))), " ").alias("others"))


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, least(9, length(word) % 11) AS bucket FROM words) SELECT doc_id, bucket, count(*) AS n FROM c GROUP BY doc_id, bucket""")
def confidence_histogram(spark, sf_dir):
    b = F.least(F.lit(9), F.length("word") % 11).cast("long")
    return doc_words(spark, sf_dir).groupBy("doc_id", b.alias("bucket")).agg(F.count("*").alias("n"))


#: DuckDB's levenshtein goes by bytes, so the accented letters of the texts are put one to one on control characters.
_ONE_BYTE = "translate(coalesce(text, ''), 'ÄÇÈÉÊÑÖÜßäçèéêíñóöü', " + " || ".join(f"chr({i})" for i in (*range(1, 9), *range(11, 23))) + ")"


@query(f"""WITH p AS (SELECT item_id, {_ONE_BYTE} AS truth FROM benchmark), b AS (SELECT item_id, truth, lead(truth) OVER (ORDER BY item_id) AS other FROM p)
SELECT item_id, levenshtein(other, truth) AS edits, floor(levenshtein(other, truth) / length(truth)::DOUBLE * 1e6 + 0.5)::BIGINT AS rate FROM b WHERE other IS NOT NULL AND length(truth) > 0""")
def cer_near_copies(spark, sf_dir):
    """Character error rate of each whole benchmark item read as the next one."""
    b = runs.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("truth")), ["item_id"])
    both = b.join(b.select((F.col("at") - 1).alias("at"), F.col("truth").alias("read")), "at").where("length(truth) > 0")
    return both.select("item_id", F.levenshtein("read", "truth").cast("long").alias("edits"), millionths(T.character_error_rate(F.col("read"), F.col("truth"))).alias("rate"))


@query(None)
def fuzzy_alias_difflib(spark, sf_dir):
    """Labels made from the aliases by leaving out one letter, a place that the part's key chooses."""
    alias = F.get(F.array(*map(F.lit, labels.ALIASES)), (F.col("p_partkey") % len(labels.ALIASES)).cast("int"))
    at = (F.col("p_partkey") % F.length(alias)).cast("int") + 1
    label = F.concat(F.substr(alias, F.lit(1), at - 1), F.substr(alias, at + 1))
    return labels.fuzzy_lookup(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label")), labels.ALIASES)


@query("SELECT c_custkey AS id, CASE WHEN b < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(b)) AS amount FROM (SELECT c_custkey, floor(c_acctbal * 4) / 4 AS b FROM customer)")
def currency_format(spark, sf_dir):
    b = F.floor(F.col("c_acctbal") * 4) / 4
    shown = F.when(b < 0, F.concat(F.lit("($"), F.abs(b).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("$"), b.cast("string")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.currency(shown).alias("amount"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS mdy, strftime(o_orderdate, '%d/%m/%Y') AS dmy, true AS same FROM orders""")
def date_formats(spark, sf_dir):
    """Each order date written in one of six ways, read back and written in three."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    shown = F.when(k == 0, F.date_format(d, "yyyy-M-d")).when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.date_format(d, "d MMM yyyy")).when(k == 4, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "MM-dd-yyyy"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), shown.alias("s"), d.alias("d"))
    return o.select("id", V.date_ymd(F.col("s")).alias("iso"), V.date_mdy(F.col("s")).alias("mdy"), V.date_dmy(F.col("s")).alias("dmy"), (V.parse_date(F.col("s")) == F.col("d")).alias("same"))


@query("""WITH n AS (SELECT c_custkey AS id, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS t, lpad((c_custkey * 104729 % 1000000000)::VARCHAR, 9, '0') AS s, (c_custkey % 100000)::VARCHAR AS z FROM customer)
SELECT id, '(' || substr(t, 1, 3) || ') ' || substr(t, 4, 3) || '-' || substr(t, 7, 4) AS phone, '+1' || t AS e164, substr(s, 1, 3) || '-' || substr(s, 4, 2) || '-' || substr(s, 6, 4) AS ssn,
  substr(s, 1, 2) || '-' || substr(s, 3, 7) AS ein, lpad(z, 5, '0') AS zip, substr(s, 1, 5) || '-' || substr(s, 6, 4) AS zip9,
  t[1] NOT IN ('0', '1') AS phone_ok, substr(s, 1, 3) NOT IN ('000', '666') AND s[1] <> '9' AND substr(s, 4, 2) <> '00' AND substr(s, 6, 4) <> '0000' AS ssn_ok FROM n""")
def zip_phone_ssn_format(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(k.alias("id"), F.lpad((k * 7919 % 10000000000).cast("string"), 10, "0").alias("t"), F.lpad((k * 104729 % 1000000000).cast("string"), 9, "0").alias("s"), (k % 100000).cast("string").alias("z"))
    t, s, z = F.col("t"), F.col("s"), F.col("z")
    return n.select("id", V.phone_us(t).alias("phone"), V.phone_e164(t).alias("e164"), V.ssn(s).alias("ssn"), V.ein(s).alias("ein"), V.zip5(z).alias("zip"), V.zip9(s).alias("zip9"), V.check_phone_us(t)["ok"].alias("phone_ok"), V.check_ssn(s)["ok"].alias("ssn_ok"))


@query("""WITH n AS (SELECT c_custkey AS id, lpad((c_custkey * 104729 % 1000000000)::VARCHAR, 9, '0') AS s, lpad((c_custkey % 97)::VARCHAR, 2, '0') AS k, lpad((c_custkey * 7919)::VARCHAR, 18, '0') AS acct,
  lpad((c_custkey * 7919)::VARCHAR, 8, '0') || CASE WHEN c_custkey % 11 = 10 THEN 'X' ELSE (c_custkey % 11)::VARCHAR END || lpad((c_custkey * 31)::VARCHAR, 8, '0') AS v FROM customer)
SELECT id, list_sum(list_transform([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2], lambda w, i: w * coalesce(try_cast(v[i] AS INT), 7))) % 11 = CASE v[9] WHEN 'X' THEN 10 ELSE v[9]::INT END AS vin_ok, (3 * (s[1]::INT + s[4]::INT + s[7]::INT) + 7 * (s[2]::INT + s[5]::INT + s[8]::INT) + s[3]::INT + s[6]::INT + s[9]::INT) % 10 = 0 AS aba_ok,
  (acct || '1314' || k)::HUGEINT % 97 = 1 AS iban_ok FROM n""")
def iban_aba_vin_checks(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(k.alias("id"), F.lpad((k * 104729 % 1000000000).cast("string"), 9, "0").alias("s"), F.concat(F.lit("DE"), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 18, "0")).alias("i"),
        F.concat(F.lpad((k * 7919).cast("string"), 8, "0"), F.when(k % 11 == 10, "X").otherwise((k % 11).cast("string")), F.lpad((k * 31).cast("string"), 8, "0")).alias("v"))
    return n.select("id", V.check_vin(F.col("v"))["ok"].alias("vin_ok"), V.check_routing_aba(F.col("s"))["ok"].alias("aba_ok"), V.check_iban(F.col("i"))["ok"].alias("iban_ok"))


_CAPITAL = """CASE WHEN starts_with(p, 'mc') AND length(p) > 2 THEN 'Mc' || upper(p[3]) || substr(p, 4) WHEN starts_with(p, 'mac') AND length(p) > 3 THEN 'Mac' || upper(p[4]) || substr(p, 5) ELSE upper(p[1]) || substr(p, 2) END"""
_ODD_NAMES = ("{} van der berg", "Mc{}", "mac{} o'brien", "DE LA {}", "anne-{}", "mac mc {}")


@query(f"""WITH n AS (SELECT p_partkey AS id, lower(CASE p_partkey % 12 {' '.join(f"WHEN {i} THEN replace('" + s.replace("'", "''") + "', '{}', p_name)" for i, s in enumerate(_ODD_NAMES))} ELSE p_name END) AS name FROM part)
SELECT id, array_to_string(list_transform(string_split(name, ' '), lambda w, i: CASE WHEN i > 1 AND list_contains([{', '.join(repr(x) for x in V.PARTICLES)}], w) THEN w
  ELSE array_to_string(list_transform(regexp_extract_all(w, '([^''-]*[''-]?)'), lambda p: {_CAPITAL}), '') END), ' ') AS name FROM n""")
def name_case_parts(spark, sf_dir):
    """Every part's name, half of them put into a name with particles, Mc, Mac, a hyphen or an apostrophe."""
    k, name = F.col("p_partkey") % 12, F.col("p_name")
    for i, shape in enumerate(_ODD_NAMES):
        before, after = shape.split("{}")
        name = F.when(k == i, F.concat(F.lit(before), F.col("p_name"), F.lit(after))).otherwise(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.name_case(F.upper(name)).alias("name"))


# measures --------------------------------------------------------------------------------


@query("""WITH x AS (SELECT d.lang, d.n_chars >= 600 AS pred, l.quality = 1 AS truth FROM labels l JOIN documents d USING (doc_id)), c AS (
SELECT lang, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn FROM x GROUP BY lang)
SELECT lang, tp, fp, fn, floor(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END * 1e6 + 0.5)::BIGINT AS recall, floor(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END * 1e6 + 0.5)::BIGINT AS precision FROM c""")
def recall_precision_labels(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = lab.join(d, "doc_id").select("lang", (F.col("n_chars") >= 600).alias("pred"), (F.col("quality") == 1).alias("truth"))
    out = measure.recall_precision(x, "pred", "truth", ["lang"])
    return out.select("lang", "tp", "fp", "fn", millionths(F.col("recall")).alias("recall"), millionths(F.col("precision")).alias("precision"))


@query("""WITH x AS (SELECT CASE WHEN n_chars < 900 THEN 'en' WHEN n_chars < 1500 THEN 'fr' ELSE lang END AS pred, lang AS truth FROM documents), u AS (
SELECT pred AS label, pred = truth AS ok, 'p' AS side FROM x UNION ALL SELECT truth, pred = truth, 't' FROM x), c AS (
SELECT label, count(*) FILTER (ok AND side = 'p') AS tp, count(*) FILTER (NOT ok AND side = 'p') AS fp, count(*) FILTER (NOT ok AND side = 't') AS fn FROM u GROUP BY label)
SELECT label, tp, fp, fn, floor(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END * 1e6 + 0.5)::BIGINT AS f1 FROM c""")
def type_macro_f1_labels(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 900, "en").when(F.col("n_chars") < 1500, "fr").otherwise(F.col("lang")).alias("pred"), F.col("lang").alias("truth"))
    return measure.macro_f1(x, "pred", "truth").withColumn("f1", millionths(F.col("f1")))


@query(PAIRS + """, v AS (SELECT page % 50 AS bucket, floor(i / (sa + sb - i) * 1e6 + 0.5)::BIGINT AS iou FROM pairs WHERE i / (sa + sb - i) > 0.1),
s AS (SELECT bucket, list_sort(list(iou)) AS l FROM v GROUP BY bucket)
SELECT bucket, """ + ", ".join(f"l[(len(l) * {d}) // 10 + 1] AS d{d}" for d in range(1, 10)) + " FROM s")  # fmt: skip
def iou_deciles(spark, sf_dir):
    p = spatial.overlap_pairs(rect_rows(spark, sf_dir)).select((F.col("page") % 50).alias("bucket"), millionths(F.col("iou")).alias("iou"))
    return measure.deciles(p, ["bucket"], "iou")


@query(f"""WITH {RECTS}, e AS (SELECT kind, x0 % 7 - 3 AS e0, y0 % 5 - 2 AS e1, x1 % 3 - 1 AS e2, y1 % 11 - 5 AS e3 FROM rects)
SELECT kind, count(*) AS n, floor(sum(e0) / count(*) * 1e6 + 0.5)::BIGINT AS e0, floor(sum(e1) / count(*) * 1e6 + 0.5)::BIGINT AS e1, floor(sum(e2) / count(*) * 1e6 + 0.5)::BIGINT AS e2,
  floor(sum(e3) / count(*) * 1e6 + 0.5)::BIGINT AS e3 FROM e GROUP BY ROLLUP (kind)""")
def calibrator_fit_rollup(spark, sf_dir):
    r = F.col("r")
    e = rect_rows(spark, sf_dir).select("kind", (r["x0"] % 7 - 3).alias("e0"), (r["y0"] % 5 - 2).alias("e1"), (r["x1"] % 3 - 1).alias("e2"), (r["y1"] % 11 - 5).alias("e3"))
    out = measure.edge_errors(e, "kind", ["e0", "e1", "e2", "e3"])
    return out.select("kind", "n", *(millionths(F.col(c)).alias(c) for c in ("e0", "e1", "e2", "e3")))


@query("""WITH bins AS (SELECT o_orderpriority AS k, floor(o_totalprice)::BIGINT % 256 AS bin, count(*) AS n FROM orders GROUP BY 1, 2), r AS (
SELECT k, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER a AS w, sum(n * bin) OVER a AS s FROM bins WINDOW w AS (PARTITION BY k ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY k)),
v AS (SELECT k, bin, ((s0::DOUBLE * w - s::DOUBLE * w0) * (s0::DOUBLE * w - s::DOUBLE * w0)) / (w0::DOUBLE * (w - w0)) AS spread FROM r WHERE w0 < w),
t AS (SELECT *, max(spread) OVER (PARTITION BY k) AS top FROM v)
SELECT k, floor((min(bin) + max(bin)) / 2)::BIGINT AS threshold FROM t WHERE spread = top GROUP BY k""")
def otsu_histogram(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bins = o.groupBy(F.col("o_orderpriority").alias("k"), (F.floor("o_totalprice").cast("long") % 256).alias("bin")).agg(F.count("*").alias("n"))
    return measure.otsu(bins, ["k"])


@query(f"WITH {RECTS} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y1 DESC, x0, id) AS place FROM rects QUALIFY place <= 3")
def topk_reading_order(spark, sf_dir):
    w = Window.partitionBy("page").orderBy(F.desc("r.y1"), "r.x0", "id")
    return rect_rows(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 3").select("page", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {RECTS}, g AS (SELECT page % 20 AS bucket, page, id FROM rects), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY page, id) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM g)
SELECT bucket, page, id FROM n WHERE n <= 40 OR floor(k * 40 / n::DOUBLE) <> floor((k - 1) * 40 / n::DOUBLE)""")
def even_sample_down(spark, sf_dir):
    g = rect_rows(spark, sf_dir).select((F.col("page") % 20).alias("bucket"), "page", "id")
    return measure.thinned(g, ["page", "id"], 40, ["bucket"])


# nested data -------------------------------------------------------------------------------


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, props ->> '$.k' AS k_text, (props ->> '$.missing')::BIGINT AS missing FROM events")
def json_props_typed(spark, sf_dir):
    g = lambda p: F.get_json_object("props", p)
    return table(spark, sf_dir, "events").select("event_id", g("$.k").try_cast("long").alias("k"), g("$.k").alias("k_text"), g("$.missing").try_cast("long").alias("missing"))


@query("SELECT user_id, event_type, (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def map_key_values(spark, sf_dir):
    m = F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("long"))
    e = table(spark, sf_dir, "events").select("user_id", F.explode(m).alias("event_type", "k"))
    return e.groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_type || '-' || (props ->> '$.k') AS label, max(event_id) AS seen FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS back FROM r)
SELECT user_id, string_agg(label, ',' ORDER BY seen) AS labels FROM k WHERE back <= 32 GROUP BY user_id""")
def array_last32(spark, sf_dir):
    """The last 32 distinct labels of each user, oldest first."""
    label = F.concat_ws("-", "event_type", F.get_json_object("props", "$.k"))
    seen = table(spark, sf_dir, "events").groupBy("user_id", label.alias("label")).agg(F.max("event_id").alias("seen"))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seen")))
    last = seen.withColumn("back", back).where("back <= 32")  # cut before the shuffle too, as a group limit
    ordered = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seen", "label"))).alias("l"))
    return ordered.select("user_id", F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("labels"))


# pages and documents -------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS page, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS finding FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def structural_diff_docs(spark, sf_dir):
    """Pages whose content hash differs between two versions of a document set."""
    d = table(spark, sf_dir, "documents")
    h = lambda c: F.md5(c.cast("binary"))
    a = d.where("doc_id % 7 <> 0").select("doc_id", h(F.col("text")).alias("a"))
    b = d.where("doc_id % 5 <> 0").select("doc_id", h(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("b"))
    both = a.join(b, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.col("doc_id").alias("page"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed").alias("finding"))


@query("""SELECT p_partkey AS id, CASE WHEN k = 0 THEN p_brand ELSE p_brand || '_' || k END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)""")
def field_name_dedupe(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return decide.deduped_names(p, "p_brand", ["p_partkey"]).select(F.col("p_partkey").alias("id"), "unique_name")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


_PAGE = """p AS (SELECT page_id, page_id % 25 AS doc, html LIKE '%<form%' OR html LIKE '%<input%' AS widgets, length(html) >= 400 AS native, html LIKE '%<table%' AS vector, html LIKE '%<img%' AS raster FROM pages),
m AS (SELECT page_id, doc, CASE WHEN widgets THEN 'acroform' WHEN native AND vector THEN 'native_form' WHEN native AND raster THEN 'hybrid' WHEN native THEN 'native' WHEN raster THEN 'raster' WHEN vector THEN 'vector' ELSE 'blank' END AS mode FROM p)"""


@query(f"WITH {_PAGE} SELECT page_id, mode FROM m")
def page_mode_case(spark, sf_dir):
    """A page's mode by ordered rules over what it holds."""
    h = F.col("html")
    has = lambda s: h.contains(s)
    native = F.length(h) >= 400
    mode = F.when(has("<form") | has("<input"), "acroform").when(native & has("<table"), "native_form").when(native & has("<img"), "hybrid").when(native, "native").when(has("<img"), "raster").when(has("<table"), "vector").otherwise("blank")
    return table(spark, sf_dir, "pages").select("page_id", mode.alias("mode"))


@query(f"""WITH {_PAGE}, c AS (SELECT doc, mode, count(*) AS n FROM m GROUP BY doc, mode)
SELECT doc, mode AS class, sum(n) OVER (PARTITION BY doc)::BIGINT AS pages FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, mode) = 1""")
def document_class_majority(spark, sf_dir):
    m = page_mode_case(spark, sf_dir).groupBy((F.col("page_id") % 25).alias("doc"), "mode").agg(F.count("*").alias("n"))
    return m.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("n"), "mode"))["mode"].alias("class"), F.sum("n").alias("pages"))
