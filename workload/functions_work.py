"""Column functions (text, ids, dates, addresses, secrets, values) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions import (
    dates, ids, jsontext, richtext, secrets, text, urls, values,
)
from waybill.operators import findings as fnd
from waybill.operators import mapping as mp
from waybill.operators import runlog
from waybill.operators import verify as vf
from workload.registry import query
from workload.tables import COLLECTIONS, DESTINATION, FIELDS, FINDINGS, LOG, RECORDS, Tables, key_of, with_

WIDE = r"[\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MARKER = "waybill-key:"


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WIDE}+|{WIDE}+$', '', 'g')"


def canon_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


PART_LABEL = "p_name || ' – ' || p_type || '/' || p_brand"


def part_label():
    return F.concat("p_name", F.lit(" – "), "p_type", F.lit("/"), "p_brand")


@query("canon", f"SELECT p_partkey, {canon_sql(PART_LABEL)} AS canon FROM part")
def canon(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.canon(part_label()).alias("canon"))


@query(
    "clean_name",
    f"""
WITH n AS (
  SELECT doc_id, text, {trim_sql(r"regexp_replace(regexp_replace(text, '[\r\n\t\v\f]+', ' ', 'g'), ' {2,}', ' ', 'g')")} AS c
  FROM documents), m AS (SELECT doc_id, text, CASE WHEN c = '' THEN 'Untitled' ELSE c END AS name FROM n)
SELECT doc_id, md5(name) AS name_md5, length(name)::INT AS name_length,
       name <> {trim_sql("text")} AS changed
FROM m""",
)
def clean_name(t: Tables) -> DataFrame:
    named = t.spread("documents").select("doc_id", "text", text.clean_name(F.col("text")).alias("name"))
    return named.select(
        "doc_id",
        F.md5("name").alias("name_md5"),
        F.length("name").alias("name_length"),
        (F.col("name") != text.wide_trim(F.col("text"))).alias("changed"),
    )


@query(
    "slug",
    f"""SELECT p_partkey, left(trim(regexp_replace(lower({PART_LABEL}), '[^a-z0-9]+', '-', 'g'), '-'), 40)
       AS slug FROM part""",
)
def slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(part_label()).alias("slug"))


@query(
    "normalize_markdown",
    f"""SELECT doc_id, md5({trim_sql(r"nfc_normalize(regexp_replace(regexp_replace(regexp_replace(text || '  ' || chr(13) || chr(10) || chr(10) || chr(10) || doc_id, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))")}) AS md5
       FROM documents""",
)
def normalize_markdown(t: Tables) -> DataFrame:
    padded = F.concat("text", F.lit("  \r\n\n\n"), "doc_id")
    return t.spread("documents").select("doc_id", F.md5(text.normalize_markdown(padded)).alias("md5"))


@query(
    "extract_markers",
    f"""
WITH b AS (
  SELECT o_orderkey, regexp_extract_all('Moved. `{MARKER}tpch:order:' || o_orderkey ||
         '` and {MARKER}tpch:order:' || (o_orderkey + 1) || ' end', '{MARKER}([^\\s`]+)', 1) AS m
  FROM orders)
SELECT o_orderkey, (u.pos - 1)::INT AS pos, u.marker AS marker
FROM b, LATERAL (SELECT unnest(m) AS marker, generate_subscripts(m, 1) AS pos) u""",
)
def extract_markers(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit(f"Moved. `{MARKER}"), key_of("order", "o_orderkey"), F.lit(f"` and {MARKER}"),
        key_of("order", F.col("o_orderkey") + 1), F.lit(" end"),
    )
    found = F.posexplode(mp.markers_in(body, MARKER)).alias("pos", "marker")
    return t.orders.select("o_orderkey", found)


UUID_SQL = (
    "substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21)"
)


@query("strip_id", f"WITH m AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders) SELECT o_orderkey, h AS bare FROM m")
def strip_id(t: Tables) -> DataFrame:
    dashed = F.upper(ids.dashed_uuid(F.md5(F.col("o_orderkey").cast("string"))))
    return t.orders.select("o_orderkey", ids.strip_id(dashed).alias("bare"))


@query("dashed_uuid", f"WITH m AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders) SELECT o_orderkey, {UUID_SQL} AS dashed FROM m")
def dashed_uuid(t: Tables) -> DataFrame:
    digest = F.md5(F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", ids.dashed_uuid(digest).alias("dashed"))


@query(
    "parse_id",
    f"""
WITH m AS (SELECT page_id, url, md5(page_id::VARCHAR) AS h,
                  regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages),
r AS (
  SELECT page_id, h, CASE page_id % 5 WHEN 0 THEN upper(h) WHEN 1 THEN {UUID_SQL}
         WHEN 2 THEN 'https://' || host || '/My-Story-' || h || '?v=2' WHEN 3 THEN url
         ELSE 'not an id ' || page_id END AS raw, host FROM m)
SELECT page_id, raw, CASE WHEN page_id % 5 IN (0, 1) THEN h
  WHEN page_id % 5 = 2 AND regexp_matches(host, '(^|\\.)(example\\.com|example\\.org)$') THEN h END AS id
FROM r""",
)
def parse_id(t: Tables) -> DataFrame:
    digest = F.md5(F.col("page_id").cast("string"))
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    shape = F.col("page_id") % 5
    raw = (
        F.when(shape == 0, F.upper(digest))
        .when(shape == 1, ids.dashed_uuid(digest))
        .when(shape == 2, F.concat(F.lit("https://"), host, F.lit("/My-Story-"), digest, F.lit("?v=2")))
        .when(shape == 3, F.col("url"))
        .otherwise(F.concat(F.lit("not an id "), "page_id"))
    )
    hosts = ["example.com", "example.org"]
    return t.pages.select("page_id", raw.alias("raw"), ids.parse_id(raw, hosts).alias("id"))


@query("entity_key", "SELECT o_orderkey, 'tpch:order:' || o_orderkey AS key, true AS valid FROM orders")
def entity_key(t: Tables) -> DataFrame:
    key = ids.entity_key("tpch", "order", F.col("o_orderkey"))
    return t.orders.select("o_orderkey", key.alias("key"), ids.valid_entity_key(key).alias("valid"))


@query(
    "parse_entity_key",
    "SELECT o_orderkey, 'tpch' AS system, 'order' AS kind, o_orderkey || ':v' || o_orderstatus AS id FROM orders",
)
def parse_entity_key(t: Tables) -> DataFrame:
    key = F.concat(key_of("order", "o_orderkey"), F.lit(":v"), "o_orderstatus")
    return t.orders.select("o_orderkey", F.inline(F.array(ids.parse_entity_key(key))))


@query(
    "user_key",
    f"""
WITH m AS (SELECT c_custkey, c_name, md5(c_custkey::VARCHAR) AS h FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN h WHEN 1 THEN lower(c_name) || '@example.com'
       ELSE h END AS user_key FROM m""",
)
def user_key(t: Tables) -> DataFrame:
    digest = F.md5(F.col("c_custkey").cast("string"))
    raw = (
        F.when(F.col("c_custkey") % 3 == 0, F.upper(ids.dashed_uuid(digest)))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name", F.lit("@Example.COM ")))
        .otherwise(F.upper(digest))
    )
    return t.customer.select("c_custkey", ids.user_key(raw).alias("user_key"))


@query(
    "stable_id",
    """SELECT o_orderkey, 'act_' || left(sha256('create_task'::BLOB || '\\x00'::BLOB ||
       ('tpch:order:' || o_orderkey)::BLOB), 12) AS id FROM orders""",
)
def stable_id(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", ids.stable_id("act", "create_task", key_of("order", "o_orderkey")).alias("id")
    )


CANONICAL_ORDER_SQL = r"""'{"customer":' || o_custkey || ',"priority":"' || o_orderpriority ||
  '","status":"' || o_orderstatus || '","total":' || regexp_replace(o_totalprice::VARCHAR, '\.0$', '') || '}'"""


def canonical_order():
    return jsontext.canonical_json(
        {
            "status": (F.col("o_orderstatus"), "string"),
            "total": (F.col("o_totalprice"), "number"),
            "priority": (F.col("o_orderpriority"), "string"),
            "customer": (F.col("o_custkey"), "plain"),
            "absent": (F.lit(None).cast("string"), "string"),
        }
    )


@query("canonical_json", f"SELECT o_orderkey, {CANONICAL_ORDER_SQL} AS json FROM orders")
def canonical_json(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", canonical_order().alias("json"))


# -- dates -----------------------------------------------------------------------------------------
def date_text():
    """Order dates in five written shapes; the last is not a real day."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shape = F.col("o_orderkey") % 5
    return (
        F.when(shape == 0, day)
        .when(shape == 1, F.concat(day, F.lit("T15:30:00.250Z")))
        .when(shape == 2, F.concat(day, F.lit("T15:30:00+02:00")))
        .when(shape == 3, F.concat(day, F.lit(" 15:30")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
    )


DATE_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:30:00.250Z'
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:30:00+02:00'
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 15:30'
  ELSE strftime(o_orderdate, '%Y') || '-02-30' END"""
ZONE = "America/New_York"
EPOCH_SQL = f"""CASE o_orderkey % 5 WHEN 1 THEN epoch_ms(o_orderdate) + 55800250
  WHEN 2 THEN epoch_ms(o_orderdate) + 48600000
  WHEN 3 THEN epoch_ms(timezone('{ZONE}', o_orderdate + INTERVAL 930 MINUTE)) END"""


@query(
    "parse_date",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'date'
       ELSE 'datetime' END AS kind, {EPOCH_SQL} AS epoch_ms,
       CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 IN (1, 2) END AS had_offset,
       CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 = 3 END AS assumed_zone FROM orders""",
)
def parse_date(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return dates.with_parsed_date(t.spread("orders"), date_text(), none, ZONE, "p").select(
        "o_orderkey", "p.kind", "p.epoch_ms", "p.had_offset", "p.assumed_zone"
    )


@query(
    "is_valid_zone",
    """
WITH z AS (SELECT o_orderkey, ['Europe/Berlin', 'Mars/Olympus', 'UTC', 'America/Bogota']
                  [o_orderkey % 4 + 1] AS zone FROM orders)
SELECT o_orderkey, zone, zone IN (SELECT name FROM pg_timezone_names()) AS valid FROM z""",
)
def is_valid_zone(t: Tables) -> DataFrame:
    zone = vocab.lookup(
        F.col("o_orderkey") % 4,
        {0: "Europe/Berlin", 1: "Mars/Olympus", 2: "UTC", 3: "America/Bogota"},
    )
    return t.orders.select("o_orderkey", zone.alias("zone"), dates.is_valid_zone(zone).alias("valid"))


@query(
    "zoned_to_epoch",
    f"SELECT o_orderkey, epoch_ms(timezone('{ZONE}', o_orderdate + INTERVAL 12 HOUR)) AS epoch_ms FROM orders",
)
def zoned_to_epoch(t: Tables) -> DataFrame:
    noon = F.col("o_orderdate") + F.expr("INTERVAL '12' HOUR")
    return t.orders.select("o_orderkey", dates.zoned_to_epoch(noon, ZONE).alias("epoch_ms"))


@query(
    "date_only_epoch",
    f"SELECT o_orderkey, epoch_ms(timezone('{ZONE}', o_orderdate + INTERVAL 4 HOUR)) AS epoch_ms FROM orders",
)
def date_only_epoch(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", dates.date_only_epoch(F.col("o_orderdate"), ZONE).alias("epoch_ms")
    )


@query(
    "epoch_to_zoned_date",
    f"""SELECT event_id, strftime(timezone('{ZONE}', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events""",
)
def epoch_to_zoned_date(t: Tables) -> DataFrame:
    ms = dates.epoch_ms(F.col("ts"))
    return t.events.select("event_id", dates.epoch_to_zoned_date(ms, ZONE).alias("day"))


@query(
    "zone_offset_ms",
    f"""SELECT event_id, (epoch_ms(timezone('{ZONE}', timezone('UTC', ts))) - epoch_ms(ts))::BIGINT AS offset_ms FROM events""",
)
def zone_offset_ms(t: Tables) -> DataFrame:
    ms = dates.epoch_ms(F.col("ts"))
    return t.events.select("event_id", dates.zone_offset_ms(ms, ZONE).alias("offset_ms"))


@query(
    "convert_date",
    f"""
WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS shape, o_orderdate, {EPOCH_SQL} AS ms FROM orders)
SELECT o_orderkey,
  CASE WHEN shape = 0 THEN epoch_ms(timezone('{ZONE}', o_orderdate + INTERVAL 4 HOUR)) ELSE ms END AS start_ms,
  CASE WHEN shape < 4 THEN shape > 0 END AS start_timed, shape = 4 AS invalid,
  CASE WHEN shape = 4 THEN 'DATE_UNPARSEABLE' WHEN o_orderkey % 2 = 0
       THEN 'DATE_TIMEZONE_NAME_NOT_PRESERVED' WHEN shape = 3 THEN 'DATE_ASSUMED_TIMEZONE' ELSE '' END AS codes
FROM d""",
)
def convert_date(t: Tables) -> DataFrame:
    named = F.when(F.col("o_orderkey") % 2 == 0, F.lit(ZONE))
    none = F.lit(None).cast("string")
    return dates.with_converted_date(t.spread("orders"), date_text(), none, named, ZONE, "d").select(
        "o_orderkey", "d.start_ms", "d.start_timed", "d.invalid",
        F.array_join("d.codes", ",").alias("codes"),
    )


@query(
    "format_date_range",
    """
WITH d AS (SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS s,
                  strftime(l_shipdate, '%Y-%m-%d') AS e, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN s || ' → ' || e || ' (UTC)'
       WHEN 1 THEN s || ' → ' || e ELSE s END AS text FROM d""",
)
def format_date_range(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shape = F.col("l_suppkey") % 3
    end = F.when(shape < 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
    zone = F.when(shape == 0, F.lit("UTC"))
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    return joined.select(
        "l_orderkey", "l_linenumber", dates.format_date_range(start, end, zone).alias("text")
    )


@query(
    "epoch_to_iso",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE
       strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso FROM events""",
)
def epoch_to_iso(t: Tables) -> DataFrame:
    ms = dates.epoch_ms(F.col("ts")).cast("string")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(ms, F.lit(" ms"))).otherwise(ms)
    return t.events.select("event_id", dates.epoch_to_iso(raw).alias("iso"))


@query(
    "priority_from",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 1
       WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END
       WHEN 1 THEN CASE WHEN left(o_orderpriority, 1) <> '5' THEN left(o_orderpriority, 1)::INT END
       END AS priority FROM orders""",
)
def priority_from(t: Tables) -> DataFrame:
    shape = F.col("o_orderkey") % 3
    raw = (
        F.when(shape == 0, F.substring("o_orderpriority", 3, 50))
        .when(shape == 1, F.substring("o_orderpriority", 1, 1))
        .otherwise(F.col("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", values.priority_from(raw).alias("priority"))


# -- addresses and secrets ---------------------------------------------------------------------------
def email_of():
    base = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return F.when(F.col("c_custkey") % 4 == 0, F.replace(base, F.lit("@"), F.lit(" at "))).otherwise(base)


@query("valid_email", "SELECT c_custkey, c_custkey % 4 <> 0 AS valid FROM customer")
def valid_email(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", urls.valid_email(email_of()).alias("valid"))


@query("valid_phone", "SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")
def valid_phone(t: Tables) -> DataFrame:
    digits = F.concat(F.lit("49 30 (100) "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    phone = F.when(F.col("c_custkey") % 3 == 0, digits).otherwise(F.concat(F.lit("+"), digits))
    return t.customer.select("c_custkey", urls.valid_phone(phone).alias("valid"))


def page_address():
    """Page addresses, some spoilt: credentials, another scheme, a space."""
    shape = F.col("page_id") % 5
    rest = F.regexp_replace("url", "^https?://", "")
    return (
        F.when(shape == 1, F.concat(F.lit("https://user:pw@"), rest))
        .when(shape == 2, F.concat(F.lit("ftp://"), rest))
        .when(shape == 3, F.concat(F.col("url"), F.lit(" x")))
        .otherwise(F.col("url"))
    )


ADDRESS_SQL = r"""CASE page_id % 5 WHEN 1 THEN 'https://user:pw@' || regexp_replace(url, '^https?://', '')
  WHEN 2 THEN 'ftp://' || regexp_replace(url, '^https?://', '') WHEN 3 THEN url || ' x' ELSE url END"""


@query(
    "valid_url",
    r"""SELECT page_id, page_id % 5 IN (0, 3, 4) AND regexp_matches(url, '^https?://[a-zA-Z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?$') AS valid FROM pages""",
)
def valid_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.valid_url(page_address()).alias("valid"))


@query(
    "safe_url",
    f"""WITH a AS (SELECT page_id, url, {ADDRESS_SQL} AS raw FROM pages)
SELECT page_id, CASE WHEN page_id % 5 IN (0, 4) AND length(raw) <= 2048
  AND regexp_matches(raw, '^https?://[a-zA-Z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?$') THEN raw END AS safe FROM a""",
)
def safe_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.safe_url(page_address()).alias("safe"))


def secret_text():
    """Document text with a token of a different shape planted in each."""
    tag = F.md5(F.col("doc_id").cast("string"))
    shape = F.col("doc_id") % 6
    planted = (
        F.when(shape == 0, F.concat(F.lit(" ntn_"), tag))
        .when(shape == 1, F.concat(F.lit(" Bearer "), tag))
        .when(shape == 2, F.concat(F.lit(" https://u:"), tag, F.lit("@h.example/x")))
        .when(shape == 3, F.concat(F.lit(" https://h.example/x?a=1&token="), tag, F.lit("&b=2")))
        .when(shape == 4, F.concat(F.lit(" pk_12_"), tag, F.lit(" end")))
        .otherwise(F.lit(" nothing here"))
    )
    return F.concat("text", planted)


SECRET_TEXT = """text || CASE doc_id % 6 WHEN 0 THEN ' ntn_' || md5(doc_id::VARCHAR)
  WHEN 1 THEN ' Bearer ' || md5(doc_id::VARCHAR) WHEN 2 THEN ' https://u:' || md5(doc_id::VARCHAR) || '@h.example/x'
  WHEN 3 THEN ' https://h.example/x?a=1&token=' || md5(doc_id::VARCHAR) || '&b=2'
  WHEN 4 THEN ' pk_12_' || md5(doc_id::VARCHAR) || ' end' ELSE ' nothing here' END"""


def scrub_sql(expr: str) -> str:
    out = expr
    for pattern, replacement in secrets.SCRUB_RULES:
        safe = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{safe}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query("scrub_secrets", f"SELECT doc_id, md5({scrub_sql(SECRET_TEXT)}) AS scrubbed_md5, {scrub_sql(SECRET_TEXT)} <> ({SECRET_TEXT}) AS changed FROM documents")
def scrub_secrets(t: Tables) -> DataFrame:
    raw = t.spread("documents").select("doc_id", secret_text().alias("raw"))
    clean = secrets.scrub(F.col("raw"))
    return raw.select("doc_id", F.md5(clean).alias("scrubbed_md5"), (clean != F.col("raw")).alias("changed"))


def props_map():
    """Event properties as a map, with one more member whose name looks like a credential."""
    base = F.from_json("props", "map<string,string>")
    name = vocab.lookup(
        F.col("event_id") % 4, {0: "password", 1: "api_key", 2: "session", 3: "bearer-token"}
    )
    return F.map_concat(base, F.create_map(name, F.concat(F.lit("Bearer v"), F.lpad(F.col("event_id").cast("string"), 12, "0"))))


NAME_SQL = "['password', 'api_key', 'session', 'bearer-token'][event_id % 4 + 1]"


@query(
    "scrub_struct",
    f"""
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, {NAME_SQL} AS name FROM events)
SELECT event_id, '{{' || CASE WHEN 'k' < name THEN '"k":"' || k || '","' || name || '":"' || v || '"'
       ELSE '"' || name || '":"' || v || '","k":"' || k || '"' END || '}}' AS json,
  '{{"secret":"[REDACTED]","in":[{{"k":"' || k || '","' || name || '":"' || v || '"}}]}}' AS nested
FROM (SELECT *, CASE WHEN event_id % 4 < 2 THEN '[REDACTED]' ELSE 'Bearer [REDACTED]' END AS v FROM e)""",
)
def scrub_struct(t: Tables) -> DataFrame:
    flat = jsontext.canonical_map(secrets.scrub_map(props_map()))
    nested = F.concat(F.lit('{"secret":{"a":1},"in":['), F.to_json(props_map()), F.lit("]}"))
    return t.events.select(
        "event_id", flat.alias("json"), secrets.scrub_json(nested).alias("nested")
    )


@query(
    "find_secret_keys",
    f"""
SELECT event_id, path FROM (
  SELECT event_id, 'conf.' || {NAME_SQL} AS path FROM events WHERE event_id % 4 <> 2
  UNION ALL SELECT event_id, 'list[1].auth_token' FROM events WHERE event_id % 3 = 0)""",
)
def find_secret_keys(t: Tables) -> DataFrame:
    """Properties with a credential-like name one level down, and sometimes one inside a list."""
    name = vocab.lookup(F.col("event_id") % 4, {0: "password", 1: "api_key", 2: "session", 3: "bearer-token"})
    token = F.when(F.col("event_id") % 3 == 0, F.lit("auth_token")).otherwise(F.lit("note"))
    document = F.concat(
        F.lit('{"conf":{"'), name, F.lit('":'), "props", F.lit('},"list":[1,{"'), token, F.lit('":"x"}]}')
    )
    rows = t.events.select("event_id", document.alias("doc"))
    return secrets.credential_paths(rows, "doc", ["event_id"])


@query(
    "hash_tag",
    "SELECT c_custkey, '[item:' || left(sha256(c_name), 8) || ']' AS tag, 'dst-' || left(sha256(c_name), 8) AS id_tag FROM customer",
)
def hash_tag(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", ids.hash_tag("item", name).alias("tag"), ids.hash_id("dst", name).alias("id_tag")
    )


@query(
    "hash_key",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '[key:' || left(sha256(c_name), 8) || ']'
       ELSE 'tpch:customer:' || left(sha256(c_custkey::VARCHAR), 12) END AS hashed FROM customer""",
)
def hash_key(t: Tables) -> DataFrame:
    key = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(key_of("customer", "c_custkey"))
    return t.customer.select("c_custkey", ids.hash_key(key).alias("hashed"))


# -- rich text and typed values ------------------------------------------------------------------------
def raw_rich_text():
    """Each turn as raw rich-text JSON: its role in bold, its text plain, a link to its page."""
    run = lambda text_, bold, href: F.struct(
        F.lit("text").alias("type"), text_.alias("plain_text"), href.alias("href"),
        F.struct(F.lit(bold).alias("bold"), F.lit("default").alias("color")).alias("annotations"),
    )
    none = F.lit(None).cast("string")
    link = F.concat(F.lit("https://h.example/c/"), "conv_id")
    return F.to_json(
        F.array(run(F.concat("role", F.lit(": ")), True, none), run(F.col("text"), False, none),
                run(F.lit(" #"), False, link))
    )


@query("rich_text_plain", "SELECT conv_id, turn, md5(role || ': ' || text || ' #') AS plain_md5 FROM conversations")
def rich_text_plain(t: Tables) -> DataFrame:
    spans = richtext.normalize_spans(raw_rich_text(), "https://h.example/", "tpch")
    return t.conversations.select("conv_id", "turn", F.md5(richtext.plain_text(spans)).alias("plain_md5"))


@query(
    "rich_text_spans",
    """
SELECT conv_id, turn, 0 AS pos, length(role)::INT + 2 AS size, true AS bold, NULL AS href FROM conversations
UNION ALL SELECT conv_id, turn, 1, length(text)::INT, false, NULL FROM conversations
UNION ALL SELECT conv_id, turn, 2, 2, false, 'https://h.example/c/' || conv_id FROM conversations""",
)
def rich_text_spans(t: Tables) -> DataFrame:
    spans = richtext.normalize_spans(raw_rich_text(), "https://h.example/", "tpch")
    long = t.conversations.select("conv_id", "turn", F.posexplode(spans).alias("pos", "span"))
    return long.select(
        "conv_id", "turn", "pos", F.length("span.text").alias("size"),
        F.col("span.bold").alias("bold"), F.col("span.href").alias("href"),
    )


@query(
    "computed_display",
    """
WITH s AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN regexp_replace(o_totalprice::VARCHAR, '\\.0$', '')
  WHEN 1 THEN o_orderpriority || ', ' || o_orderstatus WHEN 2 THEN NULL ELSE o_orderpriority END AS display,
  o_orderkey % 4 <> 2 AS complete FROM s""",
)
def computed_display(t: Tables) -> DataFrame:
    shape = F.col("o_orderkey") % 4
    cell = lambda v: F.struct(F.lit("string").alias("type"), v.alias("string"))
    payload = (
        F.when(shape == 0, F.to_json(F.struct(F.lit("number").alias("type"), F.col("o_totalprice").alias("number"))))
        .when(
            shape == 1,
            F.to_json(F.struct(F.lit("array").alias("type"),
                               F.array(cell(F.col("o_orderpriority")), cell(F.lit("")), cell(F.col("o_orderstatus"))).alias("array"))),
        )
        .when(shape == 2, F.lit('{"type":"incomplete"}'))
        .otherwise(F.to_json(cell(F.col("o_orderpriority"))))
    )
    parsed = t.orders.select("o_orderkey", F.try_parse_json(payload).alias("payload"))
    return values.with_computed_display(parsed, "rollup", "payload", "c").select(
        "o_orderkey", "c.display", "c.complete"
    )


@query(
    "unique_id_display",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR ELSE 'ORD-' || o_orderkey END AS display FROM orders",
)
def unique_id_display(t: Tables) -> DataFrame:
    prefix = F.when(F.col("o_orderkey") % 3 != 0, F.lit("ORD"))
    return t.orders.select("o_orderkey", ids.unique_id_display(prefix, F.col("o_orderkey")).alias("display"))


@query(
    "typed_value",
    """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, event_id % 6 AS shape FROM events)
SELECT event_id,
  CASE shape WHEN 0 THEN 'number' WHEN 1 THEN 'select' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'unsupported'
       WHEN 4 THEN 'multiSelect' ELSE 'url' END AS kind,
  CASE WHEN shape = 0 THEN k END AS number, CASE WHEN shape = 1 THEN 'option ' || k::BIGINT END AS name,
  CASE WHEN shape = 2 THEN k > 50 END AS flag,
  CASE WHEN shape = 4 THEN 'a' || k::BIGINT || ',b' END AS names,
  CASE WHEN shape = 5 THEN 'https://h.example/' || k::BIGINT END AS text, shape = 3 AS malformed
FROM e""",
)
def typed_value(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    shape = F.col("event_id") % 6
    payload = (
        F.when(shape == 0, k)
        .when(shape == 1, F.concat(F.lit('{"name":"option '), k, F.lit('"}')))
        .when(shape == 2, (k.cast("double") > 50).cast("string"))
        .when(shape == 3, F.concat(F.lit('"'), k, F.lit('"')))
        .when(shape == 4, F.concat(F.lit('[{"name":"a'), k, F.lit('"},{"name":"b"}]')))
        .otherwise(F.concat(F.lit('"https://h.example/'), k, F.lit('"')))
    )
    source = vocab.lookup(
        shape, {0: "number", 1: "select", 2: "checkbox", 3: "number", 4: "multi_select", 5: "url"}
    )
    raw = t.events.select(
        "event_id", values.field_kind(source).alias("kind"), F.try_parse_json(payload).alias("payload")
    )
    return values.with_typed_value(raw, "kind", "payload", "v").select(
        "event_id", "v.kind", "v.number", "v.name", "v.flag",
        F.array_join("v.names", ",").alias("names"), "v.text", "v.malformed",
    )


KIND_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FIELD_KINDS.items())


@query(
    "field_kind",
    f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey % 23 AS n FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, {list(vocab.FIELD_KINDS) + ["button", "place"]}[n + 1] AS source_type FROM s)
SELECT source_type, CASE source_type {KIND_CASE} ELSE 'unsupported' END AS kind,
       source_type IN ({", ".join(repr(x) for x in vocab.READ_ONLY_TYPES)}) AS read_only,
       count(*)::BIGINT AS n FROM m GROUP BY ALL""",
)
def field_kind(t: Tables) -> DataFrame:
    names = list(vocab.FIELD_KINDS) + ["button", "place"]
    source = vocab.lookup(F.col("l_suppkey") % 23, dict(enumerate(names)))
    typed = t.lineitem.select(source.alias("source_type")).select(
        "source_type",
        values.field_kind(F.col("source_type")).alias("kind"),
        values.read_only(F.col("source_type")).alias("read_only"),
    )
    return typed.groupBy("source_type", "kind", "read_only").agg(F.count("*").alias("n"))


def wide_cells(t: Tables) -> DataFrame:
    """Line items as typed cells of many kinds."""
    k = F.col("l_suppkey") % 8
    kinds = ["number", "select", "multiSelect", "date", "checkbox", "relation", "person", "unsupported"]
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    user = F.struct(
        F.lit(None).cast("string").alias("key"), F.col("l_suppkey").cast("string").alias("id"),
        F.when(F.col("l_suppkey") % 16 == 6, F.concat(F.lit("Supplier "), "l_suppkey")).alias("name"),
        F.lit(None).cast("string").alias("email"), F.lit("person").alias("type"),
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        vocab.lookup(k, dict(enumerate(kinds))).alias("kind"),
        F.lit(None).cast("string").alias("text"),
        F.col("l_extendedprice").alias("number"),
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("name"),
        F.when(F.col("l_quantity") > 5, F.array("l_returnflag", "l_linestatus"))
        .otherwise(F.array().cast("array<string>")).alias("names"),
        (F.col("l_discount") > 0.05).alias("flag"),
        F.struct(day("l_shipdate").alias("start"), F.lit(None).cast("string").alias("end"),
                 F.lit("UTC").alias("time_zone")).alias("date"),
        F.array(user).alias("users"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("targets"),
    )


PLAIN_SQL = """CASE l_suppkey % 8 WHEN 0 THEN regexp_replace(l_extendedprice::VARCHAR, '\\.0$', '')
  WHEN 1 THEN CASE WHEN l_quantity > 5 THEN l_returnflag END
  WHEN 2 THEN CASE WHEN l_quantity > 5 THEN l_returnflag || ', ' || l_linestatus END
  WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d') || ' (UTC)'
  WHEN 4 THEN CASE WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END
  WHEN 5 THEN '2 linked item(s)'
  WHEN 6 THEN CASE WHEN l_suppkey % 16 = 6 THEN 'Supplier ' || l_suppkey ELSE l_suppkey::VARCHAR END END"""


@query("value_to_plain", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {PLAIN_SQL} AS plain FROM lineitem")
def value_to_plain(t: Tables) -> DataFrame:
    return wide_cells(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.value_to_plain().alias("plain")
    )


@query("value_presence", f"SELECT l_suppkey % 8 AS k, ({PLAIN_SQL}) IS NOT NULL AS present, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def value_presence(t: Tables) -> DataFrame:
    marked = wide_cells(t).select((F.col("l_suppkey") % 8).alias("k"), values.value_presence().alias("present"))
    return marked.groupBy("k", "present").agg(F.count("*").alias("n"))


@query(
    "value_to_markdown",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '[' || url || '](' || url || ')'
       WHEN 1 THEN '[logo](' || url || '), scan (file not migrated)' ELSE url END AS markdown FROM pages""",
)
def value_to_markdown(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = vocab.lookup(F.col("page_id") % 3, {0: "url", 1: "files", 2: "text"})
    file = lambda name, hosting, url: F.struct(
        F.lit(name).alias("name"), F.lit(hosting).alias("hosting"), url.alias("url"))
    cells = t.pages.select(
        "page_id", kind.alias("kind"), F.col("url").alias("text"), F.lit(None).cast("double").alias("number"),
        none.alias("name"), F.array(F.lit("logo"), F.lit("scan")).alias("names"),
        F.lit(None).cast("boolean").alias("flag"),
        F.lit(None).cast("struct<start:string,end:string,time_zone:string>").alias("date"),
        F.lit(None).cast("array<struct<id:string,name:string,email:string>>").alias("users"),
        F.lit(None).cast("array<string>").alias("targets"),
        F.array(file("logo", "external", F.col("url")), file("scan", "internal", none)).alias("files"),
    )
    return cells.select(
        "page_id", values.value_to_markdown(rich=none, files=F.col("files")).alias("markdown")
    )


@query(
    "attachment_ref",
    r"""
WITH f AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages),
x AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS idx FROM f),
n AS (SELECT page_id, idx::INT AS idx, link, CASE WHEN idx % 3 = 0 THEN 'file-' || (idx + 1) ELSE link END AS name FROM x)
SELECT page_id, idx, 'tpch:file:' || left(sha256('tpch:page:' || page_id || '|Files|' || idx || '|' || name), 24) AS key,
  name, CASE WHEN idx % 2 = 0 THEN 'external' ELSE 'internal' END AS hosting,
  CASE WHEN idx % 2 = 0 AND regexp_matches(link, '^https?://[a-zA-Z0-9.-]+') THEN link END AS url FROM n""",
)
def attachment_ref(t: Tables) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    files = F.transform(links, lambda link, i: F.struct(
        F.when(i % 3 == 0, F.lit("  ")).otherwise(link).alias("name"),
        F.when(i % 2 == 0, F.lit("external")).otherwise(F.lit("file")).alias("type"),
        link.alias("url"),
    ))
    raw = t.pages.select(
        "page_id", key_of("page", "page_id").alias("owner"), F.lit("Files").alias("field"),
        files.alias("files"),
    )
    from waybill.operators.cells import attachment_refs

    return attachment_refs(raw, "tpch").select("page_id", "idx", "key", "name", "hosting", "url")


@query(
    "field_compare",
    with_(DESTINATION) + r"""
SELECT o_orderkey,
  CASE WHEN d.price IS NULL THEN 'unverified' WHEN d.price = o_totalprice THEN 'verified' ELSE 'mismatched' END AS price,
  'verified' AS status,
  CASE WHEN d.priority = o_orderpriority THEN 'verified' ELSE 'mismatched' END AS priority,
  'verified' AS ordered
FROM orders JOIN destination d ON d.destination_id = 'dst-' || o_orderkey""",
)
def field_compare(t: Tables) -> DataFrame:
    joined = t.orders.withColumn("destination_id", F.concat(F.lit("dst-"), "o_orderkey")).join(
        t.destination, "destination_id"
    )
    rules = {
        "price": vf.Rule("price", "number", "o_totalprice", "price", if_absent="unverified"),
        "status": vf.Rule("status", "status", "o_orderstatus", "status"),
        "priority": vf.Rule("priority", "text", "o_orderpriority", "priority"),
        "ordered": vf.Rule("ordered", "text", "o_day", "ordered"),
    }
    days = joined.withColumn("o_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return days.select(
        "o_orderkey",
        *[vf.field_status(r, F.col(r.planned), F.col(r.actual)).alias(n) for n, r in rules.items()],
    )


@query(
    "infer_target",
    with_(RECORDS, COLLECTIONS, FIELDS) + """
SELECT collection, field_id, CASE field_id WHEN 'status' THEN 'status' WHEN 'priority' THEN 'priority'
       WHEN 'ordered' THEN 'due_date' END AS target FROM fields""",
)
def infer_target(t: Tables) -> DataFrame:
    return mp.infer_targets(t.fields).select("collection", "field_id", "target")


@query(
    "event_label",
    with_(LOG) + """
SELECT id, CASE type WHEN 'action_succeeded' THEN CASE id % 3 WHEN 0 THEN 'Created' WHEN 1 THEN 'Linked' ELSE 'Written' END
  WHEN 'action_failed' THEN 'Write failed' WHEN 'approved' THEN 'Plan approved'
  WHEN 'in_flight' THEN 'In flight' ELSE 'Progress' END AS label,
  type IN ('action_succeeded', 'action_failed', 'approved') AS known FROM log""",
)
def event_label(t: Tables) -> DataFrame:
    message = vocab.lookup(
        F.col("id") % 3, {0: "Create task", 1: "Link a to b", 2: "Something else"}
    )
    shown = runlog.event_label(F.col("type"), message)
    return t.log.select("id", shown["label"].alias("label"), shown["known"].alias("known"))


LABEL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.OUTCOME_LABELS.items())
RANK_CASE = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(vocab.OUTCOMES_BY_RANK))


@query(
    "outcome_label",
    with_(FINDINGS) + f"""
SELECT outcome, CASE outcome {LABEL_CASE} END AS label, CASE outcome {RANK_CASE} END AS rank,
       count(*)::BIGINT AS n FROM findings GROUP BY ALL""",
)
def outcome_label(t: Tables) -> DataFrame:
    counted = t.findings.groupBy("outcome").agg(F.count("*").alias("n"))
    return fnd.with_outcome_label(counted).select("outcome", "label", "rank", "n")


@query(
    "replace_everywhere",
    """SELECT doc_id, md5(replace(text, 'the', '[x]')) AS text_md5, replace(lang, 'the', '[x]') AS lang,
       replace(source, 'the', '[x]') AS source,
       ((length(text) - length(replace(text, 'the', ''))) / 3 + (length(source) - length(replace(source, 'the', ''))) / 3
        + (length(lang) - length(replace(lang, 'the', ''))) / 3)::BIGINT AS replaced FROM documents""",
)
def replace_everywhere(t: Tables) -> DataFrame:
    from waybill.operators.quality import replace_everywhere as replace

    done = replace(t.documents, "the", "[x]")
    return done.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "replaced")
