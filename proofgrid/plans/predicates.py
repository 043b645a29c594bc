"""Queries: field lookup, comparisons, transforms, keywords, conditions, event time."""

from __future__ import annotations

import base64
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.conditions import condition
from proofgrid.functions.fields import EventFields, number_from_text
from proofgrid.functions.literals import base64_alignments, dash_spellings
from proofgrid.functions.predicates import ipv4_number, selection
from proofgrid.functions.timestamps import parse_time
from proofgrid.operators.noise import profile_of
from proofgrid.operators.rules import Rule, Ruleset, match_rules, rule_errors
from proofgrid.plans.telemetry import RULES, Query, table, telemetry, telemetry_fields, with_events


def flags(df: DataFrame, fields: EventFields, key: str, tests: dict[str, object]) -> DataFrame:
    """The key and one boolean per named selection."""
    return df.select(key, *[selection(fields, body).alias(name) for name, body in tests.items()])


def over(name: str, key: str, tests: dict[str, object], columns: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return flags(df, EventFields.of(df, columns=columns), key, tests)

    return run


def field_resolve_json(spark, sf_dir):
    """Lookup through nested documents: exact, other case, dotted, unique leaf, ambiguous leaf."""
    # One event in four kinds of document, chosen by its type.
    body = F.concat(
        F.lit('{"Own": '), F.col("props"), F.lit(', "none": null, "empty": "", "list": [], "type": "'),
        F.col("event_type"), F.lit('", "twin": {"a": {"leaf": 1}, "b": {"leaf": 2}}}'),
    )
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(body).alias("doc"))
    fields = EventFields.of(
        df, "doc",
        [("Own", "k"), ("none",), ("empty",), ("list",), ("type",), ("twin", "a", "leaf"), ("twin", "b", "leaf")],
        columns=[],
    )
    out = df.select(
        "event_id",
        fields.locate("K").text.alias("leaf"),
        fields.locate("own.K").text.alias("dotted"),
        fields.locate("TYPE").text.alias("other_case"),
        fields.locate("leaf").present.alias("ambiguous"),
        *[
            selection(fields, body).alias(name)
            for name, body in {
                "none_exists": {"none|exists": True}, "none_null": {"none": None}, "empty_null": {"empty": None},
                "list_null": {"list": None}, "missing_null": {"nope": None}, "type_null": {"type": None},
                "missing_exists": {"nope|exists": True}, "error_small": {"type": "Error", "k|lt": 50},
            }.items()
        ],
    )
    return out


FIELD_SQL = """
SELECT event_id, json_extract_string(props, '$.k') AS leaf, json_extract_string(props, '$.k') AS dotted,
  event_type AS other_case, false AS ambiguous, true AS none_exists, true AS none_null, true AS empty_null,
  true AS list_null, true AS missing_null, false AS type_null, false AS missing_exists,
  event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AS error_small
FROM events
"""

TEXT_TESTS = {
    "any_word": {"text|contains": ["LICENSE", "copyright", "the then"]},
    "all_words": {"text|contains|all": ["the", "and", "with"]},
    "en": {"lang": "EN", "source|startswith": "SRC1"},
    "cased": {"text|contains|cased": "The "},
}
TEXT_SQL = """
SELECT doc_id,
  contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'the then') AS any_word,
  contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'with') AS all_words,
  lower(lang) = 'en' AND starts_with(lower(source), 'src1') AS en,
  contains(text, 'The ') AS cased
FROM documents
"""

PART_TESTS = {
    "starts": {"p_name|startswith": ["RED", "small"]},
    "ends": {"p_name|endswith": "WIDGET"},
    "cased_miss": {"p_name|endswith|cased": "WIDGET"},
    "equal_any": {"p_type": ["economy", "PROMO"], "p_size|gte": 10},
    "number": {"p_size": 15},
    "price": {"p_retailprice|gt": 1000, "p_retailprice|lte": 1400.5},
}
PART_SQL = """
SELECT p_partkey, starts_with(lower(p_name), 'red') OR starts_with(lower(p_name), 'small') AS starts,
  ends_with(lower(p_name), 'widget') AS ends, ends_with(p_name, 'WIDGET') AS cased_miss,
  lower(p_type) IN ('economy', 'promo') AND p_size >= 10 AS equal_any, p_size = 15 AS number,
  p_retailprice > 1000 AND p_retailprice <= 1400.5 AS price
FROM part
"""

URL_TESTS = {
    "secure_blog": {"url": "https://blog.*"},
    "ref": {"url|endswith": "?ref=x"},
    "path": {"url|contains": "/en/??0"},
    "escaped": {"url|contains": "\\?page=*&ref"},
    "star_tail": {"url|startswith": "HTTP://m.*.com/*"},
}
URL_SQL = """
SELECT page_id, regexp_matches(url, '^https://blog\\..*$', 'i') AS secure_blog,
  regexp_matches(url, '.ref=x$', 'i') AS ref, regexp_matches(url, '/en/..0', 'i') AS path,
  regexp_matches(url, '\\?page=.*&ref', 'i') AS escaped, regexp_matches(url, '^HTTP://m\\..*\\.com/', 'i') AS star_tail
FROM pages
"""

REGEX_TESTS = {
    "digits": {"text|re": r"\b\d{3}[-.]\d{3,4}\b"},
    "mail": {"text|re": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}"},
    "first": {"text|re": r"^(?P<word>The|And|Is)\s"},
    "either": {"text|re": ["secret", r"https?://"]},
    "insensitive": {"text|re": "COPYRIGHT|LICEN[CS]E"},
}
REGEX_SQL = """
SELECT doc_id, regexp_matches(text, '\\b[0-9]{3}[-.][0-9]{3,4}\\b', 'i') AS digits,
  regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+\\.[a-z]{2,}', 'i') AS mail,
  regexp_matches(text, '^(The|And|Is)[ \\t\\n\\r\\f\\v]', 'i') AS first,
  regexp_matches(text, 'secret', 'i') OR regexp_matches(text, 'https?://', 'i') AS either,
  regexp_matches(text, 'COPYRIGHT|LICEN[CS]E', 'i') AS insensitive
FROM documents
"""


def pred_numeric_hex(spark, sf_dir):
    """Numbers written as decimal, hexadecimal, signed, grouped or broken text."""
    k = F.expr("CAST(get_json_object(props, '$.k') AS INT)")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("0x"), F.hex(k)))
        .when(F.col("event_type") == "click", F.concat(F.lit("-0X"), F.lower(F.hex(k))))
        .when(F.col("event_type") == "view", F.concat(F.lit(" 1_"), F.lpad(k.cast("string"), 3, "0"), F.lit(" ")))
        .when(F.col("event_type") == "signup", F.concat(k.cast("string"), F.lit("d")))
        .otherwise(F.concat(k.cast("string"), F.lit(".5e1")))
    )
    df = table(spark, sf_dir, "events").select("event_id", text.alias("n"))
    fields = EventFields.of(df, columns=["n"])
    return df.select(
        "event_id",
        number_from_text(F.col("n")).alias("number"),
        selection(fields, {"n": 16}).alias("eq"),
        selection(fields, {"n|gt": 40}).alias("gt"),
        selection(fields, {"n|lte": "0x20"}).alias("lte"),
    )


NUMERIC_SQL = """
WITH v AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
n AS (SELECT event_id, CASE event_type WHEN 'error' THEN k::DOUBLE WHEN 'click' THEN -k::DOUBLE
      WHEN 'view' THEN (1000 + k)::DOUBLE WHEN 'signup' THEN NULL ELSE (k + 0.5) * 10.0::DOUBLE END AS number FROM v)
SELECT event_id, number, coalesce(number = 16, false) AS eq, coalesce(number > 40, false) AS gt,
       coalesce(number <= 32, false) AS lte FROM n
"""


def pred_cidr(spark, sf_dir):
    """Addresses built from the ids, some malformed, against networks of several sizes."""
    part = lambda e: F.expr(e).cast("string")
    address = F.concat_ws(
        ".", F.when(F.col("event_type") == "click", F.lit("010")).otherwise(F.lit("10")),
        part("user_id % 300"), part("event_id div 256 % 256"), part("event_id % 256"),
    )
    df = table(spark, sf_dir, "events").select("event_id", address.alias("ip"))
    fields = EventFields.of(df, columns=["ip"])
    return df.select(
        "event_id",
        ipv4_number(F.col("ip")).alias("number"),
        selection(fields, {"ip|cidr": "10.0.0.0/8"}).alias("net8"),
        selection(fields, {"ip|cidr": ["10.7.1.9/13", "10.40.0.0/16"]}).alias("either"),
        selection(fields, {"ip|cidr": "10.41.3.128/25"}).alias("net25"),
    )


CIDR_SQL = """
WITH a AS (SELECT event_id, CASE WHEN event_type <> 'click' AND user_id % 300 < 256 THEN
  10 * 16777216 + (user_id % 300) * 65536 + (event_id // 256 % 256) * 256 + event_id % 256 END AS number FROM events)
SELECT event_id, number, number IS NOT NULL AS net8,
  coalesce((number >= 167772160 AND number < 167772160 + 524288) OR (number >= 170393600 AND number < 170393600 + 65536), false) AS either,
  coalesce(number >= 170459136 + 896 AND number < 170459136 + 1024, false) AS net25
FROM a
"""


def pred_base64offset(spark, sf_dir):
    """Words found inside base64 of whole texts, at any alignment, and the plain encoding."""
    blob = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    df = table(spark, sf_dir, "documents").select("doc_id", blob.alias("blob"))
    fields = EventFields.of(df, columns=["blob"])
    tests = {
        "any_offset": {"blob|contains|cased|base64offset": ["license", "with the"]},
        "plain": {"blob|startswith|cased|base64": "The"},
    }
    return flags(df, fields, "doc_id", tests)


def _any(column: str, words: list[str], how: str = "contains") -> str:
    return " OR ".join(f"{how}({column}, '{w}')" for w in words)


BASE64_SQL = f"""
WITH b AS (SELECT doc_id, to_base64(encode(text)) AS blob FROM documents)
SELECT doc_id, {_any('blob', base64_alignments('license') + base64_alignments('with the'))} AS any_offset,
  starts_with(blob, '{base64.b64encode(b'The').decode()}') AS plain FROM b
"""


def pred_windash(spark, sf_dir):
    """Dash spellings in page addresses and in texts turned into option-like words."""
    df = table(spark, sf_dir, "pages").select("page_id", "url", F.translate("html", "<", "–").alias("cmd"))
    tests = {
        "slash": {"url|contains|windash": "-en"},
        "dash": {"cmd|contains|windash": ["-title", " /nav"]},
    }
    return flags(df, EventFields.of(df, columns=["url", "cmd"]), "page_id", tests)


WINDASH_SQL = f"""
WITH p AS (SELECT page_id, lower(url) AS url, lower(translate(html, '<', '–')) AS cmd FROM pages)
SELECT page_id, {_any('url', dash_spellings('-en'))} AS slash,
  {_any('cmd', dash_spellings('-title') + dash_spellings(' /nav'))} AS dash FROM p
"""


def keyword_search(spark, sf_dir):
    """Words anywhere in a customer's row, and rows of parts sharing a word with them."""
    customers = table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "part")
    hit = lambda df, key, words, kind: df.filter(
        selection(EventFields.of(df), words)
    ).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return hit(customers, "c_custkey", ["BUILDING", "#00000012"], "customer").unionByName(
        hit(parts, "p_partkey", ["widget", "brand#2?"], "part")
    )


KEYWORD_SQL = """
SELECT 'customer' AS kind, c_custkey AS id FROM customer
WHERE contains(lower(c_mktsegment), 'building') OR contains(lower(c_name), '#00000012')
UNION ALL
SELECT 'part', p_partkey FROM part
WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget') OR regexp_matches(lower(p_brand), 'brand#2.')
"""


def condition_quantifiers(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    fields = telemetry_fields(events)
    events, fields = fields.project(events, ["event_type", "value", "k"])
    chosen = {
        "sel_type": selection(fields, {"event_type": ["error", "purchase"]}),
        "sel_big": selection(fields, [{"value|gt": 80}, {"k|gte": 95}]),
        "filter_low": selection(fields, {"k|lt": 5}),
        "filter_view": selection(fields, {"event_type": "view"}),
    }
    texts = {
        "one": "1 of sel_* and not 1 of filter_*",
        "every": "all of sel_* and not filter_low",
        "bare": "sel* or filter_*",
        "them": "1 of them",
        "mixed": "sel_type and not (filter_low or sel_big) or filter_view and sel_big",
    }
    return events.select("event_id", *[condition(text, chosen).alias(name) for name, text in texts.items()])


CONDITION_SQL = """
WITH s AS (SELECT event_id, event_type IN ('error', 'purchase') AS t, value > 80 OR k >= 95 AS b, k < 5 AS l, event_type = 'view' AS v
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
SELECT event_id, (t OR b) AND NOT (l OR v) AS one, (t AND b) AND NOT l AS every, (t AND b) OR (l AND v) AS bare,
  t OR b OR l OR v AS them, (t AND NOT (l OR b)) OR (v AND b) AS mixed FROM s
"""


def event_time_parse(spark, sf_dir):
    """Event times written in seven forms and read back; unreadable ones counted per form."""
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    form = F.expr("user_id % 8")
    text = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 2, F.floor(us / 1e6).cast("bigint").cast("string"))
        .when(form == 3, F.floor(us / 1e3).cast("bigint").cast("string"))
        .when(form == 4, us.cast("string"))
        .when(form == 5, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")))
        .when(form == 6, F.date_format(ts, "MM/dd/yyyy hh:mm:ss a"))
        .otherwise(F.date_format(ts, "dd MMMM yyyy"))
    )
    df = table(spark, sf_dir, "events").select(form.alias("form"), us.alias("us"), text.alias("text"))
    read = df.withColumn("read", F.unix_micros(parse_time(F.col("text"))))
    return read.groupBy("form").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("read").isNull()).alias("unreadable"),
        F.sum(F.col("us") - F.col("read")).alias("lost_us"),
    )


TIME_SQL = """
WITH e AS (SELECT user_id % 8 AS form, epoch_us(ts) AS us FROM events)
SELECT form, count(*) AS events, count(*) FILTER (form = 7) AS unreadable,
  sum(CASE form WHEN 0 THEN 0 WHEN 3 THEN us % 1000 WHEN 4 THEN 0 WHEN 5 THEN us % 1000000 + 7200000000
      WHEN 7 THEN NULL ELSE us % 1000000 END)::BIGINT AS lost_us
FROM e GROUP BY form
"""

GLOBS = [("blog", "*//blog.*"), ("mobile", "http*://m.*"), ("plain", "*.example.???/*")]


def host_profile(spark, sf_dir):
    """Baseline profile of a page's host by the first matching glob."""
    df = table(spark, sf_dir, "pages").select(profile_of(F.col("url"), GLOBS).alias("profile"))
    return df.groupBy(F.coalesce("profile", F.lit("-")).alias("profile")).agg(F.count(F.lit(1)).alias("pages"))


PROFILE_SQL = """
SELECT CASE WHEN regexp_matches(url, '^.*//blog\\..*$', 'i') THEN 'blog' WHEN regexp_matches(url, '^http.*://m\\..*$', 'i') THEN 'mobile'
  WHEN regexp_matches(url, '^.*\\.example\\..../.*$', 'i') THEN 'plain' ELSE '-' END AS profile, count(*) AS pages
FROM pages GROUP BY 1
"""




BRACE_TESTS = {
    "template": {"body|re": r"\${k:(er|pu)"},
    "up_to": {"body|re": "l{,2}ic.*}$"},
    "open": {"body|re": "{\"k\""},
    "class": {"body|re": "[[{]k:[]}]?v"},
}


def pred_regex_braces(spark, sf_dir):
    """Patterns that Python reads and Java alone would not: braces and brackets that are plain characters."""
    body = F.concat(F.lit("${k:"), F.col("event_type"), F.lit("} "), F.col("props"))
    df = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return flags(df, EventFields.of(df, columns=["body"]), "event_id", BRACE_TESTS)


BRACE_SQL = """
SELECT event_id, event_type IN ('error', 'purchase') AS template, event_type = 'click' AS up_to, contains(props, '{"k"') AS open,
  event_type = 'view' AS class FROM events
"""


def pred_value_list(spark, sf_dir):
    """Event ids against a list of 20,000 values, as indicator lists are; plain texts, wildcards and numbers mixed."""
    values = [f"E{i * 7}" for i in range(20_000)] + ["e*99", 5]
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id")).alias("mark"))
    return flags(df, EventFields.of(df, columns=["mark"]), "event_id", {"listed": {"mark": values}})


NEEDLES = ["".join(chr(97 + i * 593 // 26**d % 26) for d in (4, 3, 2, 1, 0)) for i in range(20_000)]
NEEDLE_TESTS = {"listed": {"text|contains": NEEDLES}, "cased": {"text|contains|cased": [n.title() for n in NEEDLES]}, "keyword": NEEDLES}
NEEDLES_SQL = """
WITH n AS (SELECT chr(97 + (i * 593 // 456976 % 26)::INT) || chr(97 + (i * 593 // 17576 % 26)::INT) || chr(97 + (i * 593 // 676 % 26)::INT)
    || chr(97 + (i * 593 // 26 % 26)::INT) || chr(97 + (i * 593 % 26)::INT) AS w FROM range(20000) AS r(i))
SELECT doc_id, EXISTS (SELECT 1 FROM n WHERE contains(lower(text), w)) AS listed,
  EXISTS (SELECT 1 FROM n WHERE contains(text, upper(w[1]) || w[2:])) AS cased,
  EXISTS (SELECT 1 FROM n WHERE contains(lower(text), w) OR contains(lower(lang), w) OR contains(lower(source), w)) AS keyword
FROM documents
"""

#: 500 patterns of one field: a call number and a word from the needles, in any case.
MANY_TESTS = {"any": {"text|re": [rf"{n[:4]}\w*\s+\w" for n in NEEDLES[::40]]}}
MANY_SQL = """
SELECT doc_id, regexp_matches(text, '(' || (SELECT string_agg(chr(97 + (i * 593 // 456976 % 26)::INT) || chr(97 + (i * 593 // 17576 % 26)::INT)
    || chr(97 + (i * 593 // 676 % 26)::INT) || chr(97 + (i * 593 // 26 % 26)::INT), '|') FROM range(0, 20000, 40) AS r(i))
    || ')[\\pL\\pN\\pM_]*[ \\t\\n\\r\\f\\v]+[\\pL\\pN_]', 'i') AS "any"
FROM documents
"""


VALUE_LIST_SQL = """
SELECT event_id, (event_id % 7 = 0 AND event_id < 140000) OR event_id % 100 = 99 AS listed FROM events
"""


def pred_cidr6(spark, sf_dir):
    """IPv6 addresses in several spellings, some malformed, against networks that cut through a group."""
    h = lambda e: F.lower(F.hex(F.expr(e).cast("bigint")))
    address = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("2001:db8::"), h("user_id % 65536"), F.lit(":"), h("event_id % 65536")))
        .when(F.col("event_type") == "view", F.concat(F.lit(" 2001:DB8:0:0:0:0:"), h("user_id % 65536"), F.lit(":"), h("event_id % 65536"), F.lit("%eth0")))
        .when(F.col("event_type") == "error", F.concat(F.lit("::ffff:10.0."), F.expr("event_id div 256 % 256").cast("string"), F.lit("."), F.expr("event_id % 256").cast("string")))
        .otherwise(F.concat(F.lit("2001:db8::1::"), h("event_id % 65536")))
    )
    df = table(spark, sf_dir, "events").select("event_id", address.alias("ip"))
    tests = {"wide": {"ip|cidr": "2001:db8::/32"}, "narrow": {"ip|cidr": "2001:db8::40:0/107"}, "mapped": {"ip|cidr": "::ffff:10.0.8.0/117"}}
    return flags(df, EventFields.of(df, columns=["ip"]), "event_id", tests)


CIDR6_SQL = """
SELECT event_id, event_type IN ('click', 'view') AS wide,
  event_type IN ('click', 'view') AND user_id % 65536 >= 64 AND user_id % 65536 < 96 AS narrow,
  event_type = 'error' AND event_id // 256 % 256 >= 8 AND event_id // 256 % 256 < 16 AS mapped FROM events
"""


def rule_errors_found(spark, sf_dir):
    """A library with rules that mean nothing: they are named with their reason, the others run on all events."""
    bad = {"network": {"value|cidr": "999.1"}, "pattern": {"event_type|re": "("}, "order": {"value|gt": "much"}}
    library = Ruleset((*RULES.rules, *(Rule(f"bad-{name}", {"sel": body, "condition": "sel"}) for name, body in bad.items())), RULES.sources)
    events = telemetry(spark, sf_dir)
    fields = telemetry_fields(events)
    errors = rule_errors(library, fields)
    good = replace(library, rules=tuple(r for r in library.rules if r.name not in errors))
    hits = match_rules(events, good, fields, ["event_id"]).groupBy("rule").agg(F.count("*").alias("hits"), F.lit(False).alias("skipped"))
    return hits.union(spark.createDataFrame([(name, 0, bool(why)) for name, why in errors.items()], "rule string, hits long, skipped boolean"))


RULE_ERRORS_SQL = with_events(
    """SELECT rule, count(*) AS hits, false AS skipped FROM hits GROUP BY rule
    UNION ALL SELECT * FROM (VALUES ('bad-network', 0, true), ('bad-pattern', 0, true), ('bad-order', 0, true))"""
)

QUERIES = {
    "pred_regex_braces": Query(pred_regex_braces, BRACE_SQL),
    "pred_needles": Query(over("documents", "doc_id", NEEDLE_TESTS, ("text", "lang", "source")), NEEDLES_SQL),
    "pred_regex_many": Query(over("documents", "doc_id", MANY_TESTS, ("text",)), MANY_SQL),
    "pred_value_list": Query(pred_value_list, VALUE_LIST_SQL),
    "pred_cidr6": Query(pred_cidr6, CIDR6_SQL),
    "rule_errors": Query(rule_errors_found, RULE_ERRORS_SQL),
    "field_resolve_json": Query(field_resolve_json, FIELD_SQL),
    "pred_contains": Query(over("documents", "doc_id", TEXT_TESTS, ("text", "lang", "source")), TEXT_SQL),
    "pred_anchors": Query(
        over("part", "p_partkey", PART_TESTS, ("p_name", "p_type", "p_size", "p_retailprice")), PART_SQL
    ),
    "pred_wildcard": Query(over("pages", "page_id", URL_TESTS, ("url",)), URL_SQL),
    "pred_regex": Query(over("documents", "doc_id", REGEX_TESTS, ("text",)), REGEX_SQL),
    "pred_numeric_hex": Query(pred_numeric_hex, NUMERIC_SQL),
    "pred_cidr": Query(pred_cidr, CIDR_SQL),
    "pred_base64offset": Query(pred_base64offset, BASE64_SQL),
    "pred_windash": Query(pred_windash, WINDASH_SQL),
    "keyword_search": Query(keyword_search, KEYWORD_SQL),
    "condition_quantifiers": Query(condition_quantifiers, CONDITION_SQL),
    "event_time_parse": Query(event_time_parse, TIME_SQL),
    "host_profile": Query(host_profile, PROFILE_SQL),
}
