from __future__ import annotations

import datetime as dt
import unicodedata
import zoneinfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waybill.functions import dates, ids, jsontext, richtext, secrets, text, urls, values


# -- text ----------------------------------------------------------------------------------------------
def test_canon_makes_variants_equal(column):
    got = column(text.canon, ["To-do", "to do", "  TO DO ", "Ｔｏ－ｄｏ", "ﬁnal", "Éclair!", "", None])
    assert got == ["to do", "to do", "to do", "to do", "final", "éclair", "", None]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30).filter(lambda s: "\x00" not in s and s.isprintable()), min_size=1, max_size=40))
def test_normal_forms_match_the_standard(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string")
    forms = ["NFC", "NFKC", "NFKD"]
    got = df.select("i", *[text.normal_form(F.col("x"), f).alias(f) for f in forms]).orderBy("i").collect()
    known = [s for s in samples if all(unicodedata.category(c) != "Cn" for c in s)]
    for row, sample in zip(got, samples):
        if sample in known:
            assert [row[f] for f in forms] == [unicodedata.normalize(f, sample) for f in forms]


def test_trim_reads_from_both_ends(column):
    """A pattern tried a long run inside a text once per sign of it, and cut before a last line end that is no white space."""
    run = " \t" * 200_000
    kept = ["a \x85", "a\u2028\x85", f"a{run}b", ""]
    assert column(text.wide_trim, [*kept, "\ufeff\u3000 a\r\n\u2029", run, None]) == [*kept, "a", "", None]
    assert column(text.clean_name, [f"a{run}b", f"\xa0{run}", "a \n", "\n\x0b \fa  b c\td", None]) == ["a b", "Untitled", "a", "a b c d", None]


def test_clean_name(column):
    raw = ["a\r\nb", "  a   b ", "\n\t", "", "plain", " x "]
    assert column(text.clean_name, raw) == ["a b", "a b", "Untitled", "Untitled", "plain", "x"]
    assert column(text.name_changed, raw) == [True, True, True, True, False, False]


def test_slug(column):
    got = column(text.slug, ["Hello, World!", "Ünïcode Tést", "---", "x" * 50, "a b"])
    assert got == ["hello-world", "u-ni-code-te-st", "untitled", "x" * 40, "a-b"]


def test_normalize_markdown(column):
    got = column(text.normalize_markdown, ["a  \r\nb\t\r\n\r\n\r\n\r\nc \n", None, "é", "a\n\n\n\n\nb"])
    assert got == ["a\nb\n\nc", "", "é", "a\n\nb"]


def test_number_text(column):
    got = column(text.number_text, [1.0, 0.5, 112946.26, 12345678.912, 1e21, 1e-7, -3.0, 0.0, 1.5e-5, None], "double")
    assert got == ["1", "0.5", "112946.26", "12345678.912", "1e+21", "1e-7", "-3", "0", "0.000015", None]


def test_first_difference(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("a", "a\n\nb"), ("a\n\nb", "a"), ("a", "a")], "e string, a string")
    got = text.with_first_difference(df, F.col("e"), F.col("a"), "d").select("d.*").collect()
    assert [tuple(r) for r in got] == [
        (2, "b", "x"), (2, "(end of text)", "b"), (2, "b", "(end of text)"), (2, "(end of text)", "(end of text)"),
    ]


def test_search_terms(spark):
    df = spark.createDataFrame([("Alpha beta",), ("beta",)], "x string")
    count = lambda q: df.where(text.matches_terms(F.col("x"), q)).count()
    assert [count("  BETA alpha "), count("beta"), count(""), count("gamma")] == [1, 2, 2, 0]


# -- ids ------------------------------------------------------------------------------------------------
HEX = "7be1a90c52d84f36a0c9e4417d35f2b8"
UUID = "7be1a90c-52d8-4f36-a0c9-e4417d35f2b8"


def test_ids(column):
    assert column(ids.strip_id, [UUID.upper()]) == [HEX]
    assert column(ids.dashed_uuid, [HEX]) == [UUID]
    parse = lambda x: ids.parse_id(x, ["docs.example"])
    given_ = [
        HEX.upper(), UUID, f"https://www.docs.example/My-Story-{HEX}?v=1", f"https://docs.example/{UUID}",
        f"https://evil-docs.example.com/{HEX}", f"https://notdocs.example/{HEX}", "nope", f" {HEX} ",
    ]
    assert column(parse, given_) == [HEX, HEX, HEX, HEX, None, None, None, HEX]


def test_entity_and_user_keys(column):
    assert column(ids.valid_entity_key, ["a:b:c", "a:b:c:d", "A:b:c", "a::c", "a:b:"]) == [True, True, False, False, False]
    assert column(lambda x: ids.parse_entity_key(x)["id"], ["a:b:c:d"]) == ["c:d"]
    assert column(ids.user_key, [UUID.upper(), " Ann@X.org ", "short-id"]) == [HEX, "ann@x.org", "short-id"]


def test_stable_id_separates_its_parts(spark):
    row = spark.range(1).select(ids.stable_id("act", "ab", "c").alias("x"), ids.stable_id("act", "a", "bc").alias("y")).first()
    import hashlib

    assert row.x == "act_" + hashlib.sha256(b"ab\x00c").hexdigest()[:12]
    assert row.x != row.y


def test_canonical_json_is_sorted_and_strict(spark):
    df = spark.createDataFrame([("é\"\n", 1.0, 7)], "s string, n double, i int")
    members = {"z": (F.col("n"), "number"), "a": (F.col("s"), "string"), "m": (F.col("i"), "plain"), "none": (F.lit(None).cast("string"), "string")}
    assert df.select(jsontext.canonical_json(members)).first()[0] == '{"a":"é\\"\\n","m":7,"z":1}'
    bad = spark.createDataFrame([(float("nan"),)], "n double")
    with pytest.raises(Exception, match="non-finite"):
        bad.select(jsontext.canonical_json({"n": (F.col("n"), "number")})).collect()


# -- dates ----------------------------------------------------------------------------------------------
def parsed(spark, texts, zone=None, default="UTC"):
    df = spark.createDataFrame([(i, s, zone) for i, s in enumerate(texts)], "i int, x string, z string")
    rows = dates.with_parsed_date(df, F.col("x"), F.col("z"), default, "p").orderBy("i").select("p").collect()
    return [r.p for r in rows]


def test_date_text_rules(spark):
    good = parsed(spark, ["2026-02-28", "2024-02-29", " 2026-01-02T03:04Z ", "2026-01-02 03:04:05.123456789+0530", "2026-01-02T03:04:05-03"])
    assert [(g.kind, g.had_offset) for g in good] == [("date", False), ("date", False)] + [("datetime", True)] * 3
    at = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert good[2].epoch_ms == at(2026, 1, 2, 3, 4)
    assert good[3].epoch_ms == at(2026, 1, 1, 21, 34, 5) + 123
    assert good[4].epoch_ms == at(2026, 1, 2, 6, 4, 5)
    bad = ["2026-02-29", "2026-13-01", "2026-01-02T24:00Z", "2026-01-02T03:60", "0099-01-01", "2026-1-2", "tomorrow", "", "2026-01-02T03:04:05.Z"]
    assert parsed(spark, bad) == [None] * len(bad)


def test_floating_times_and_zone_names(spark):
    zoned = parsed(spark, ["2026-07-01T12:00"], "Europe/Berlin", "America/New_York")[0]
    unknown = parsed(spark, ["2026-07-01T12:00"], "Mars/Olympus", "America/New_York")[0]
    assumed = parsed(spark, ["2026-07-01T12:00"], None, "America/New_York")[0]
    assert (zoned.epoch_ms, zoned.assumed_zone) == (1782900000000, False)
    assert (unknown.epoch_ms, unknown.assumed_zone) == (1782921600000, False)
    assert (assumed.epoch_ms, assumed.assumed_zone) == (1782921600000, True)


def brute_force_epoch(wall: dt.datetime, zone: str) -> int:
    """Search all instants around the wall clock: earliest that shows it, else push it past a gap."""
    tz, utc = zoneinfo.ZoneInfo(zone), dt.timezone.utc
    naive = wall.replace(tzinfo=utc)
    hits = [
        naive + dt.timedelta(minutes=m) for m in range(-15 * 60, 15 * 60, 15)
        if (naive + dt.timedelta(minutes=m)).astimezone(tz).replace(tzinfo=utc) == naive
    ]
    if hits:
        return int(min(hits).timestamp() * 1000)
    before = (naive - dt.timedelta(days=1)).astimezone(tz).utcoffset()
    return int((naive - before).timestamp() * 1000)


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Pacific/Kiritimati", "Pacific/Pago_Pago"])
def test_zone_conversion_against_search(spark, zone):
    tz = zoneinfo.ZoneInfo(zone)
    start, walls = dt.datetime(2026, 1, 1), []
    for hour in range(0, 365 * 24):
        at = start + dt.timedelta(hours=hour)
        if at.replace(tzinfo=tz).utcoffset() != (at + dt.timedelta(hours=1)).replace(tzinfo=tz).utcoffset():
            walls += [at + dt.timedelta(minutes=m) for m in range(-180, 240, 15)]
    walls += [dt.datetime(2026, 6, 1, 0, 0), dt.datetime(2026, 12, 31, 23, 45)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(walls)], "i int, w timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(dates.zoned_to_epoch(F.col("w"), zone)).collect()]
    assert got == [brute_force_epoch(w, zone) for w in walls]


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 8, 2, 30),)], "w timestamp_ntz")
    def both():
        row = df.select(dates.zoned_to_epoch(F.col("w"), "America/New_York"), dates.epoch_to_zoned_date(F.lit(1782873000000), "Asia/Tokyo"),
                        dates.zone_offset_ms(F.lit(1782873000000), "Asia/Tokyo"), F.unix_micros(dates.instant(F.col("w")))).first()
        return tuple(row)

    utc = both()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert both() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == (1772955000000, "2026-07-01", 9 * 3600 * 1000, 1772937000000000)


def test_every_listed_zone_converts(spark):
    zones = spark.createDataFrame([(z,) for z in dates.zone_names()], "z string")
    wall = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    assert zones.select(dates.zoned_to_epoch(wall, F.col("z")).alias("e")).where("e is null").count() == 0


def test_convert_date_codes(spark):
    rows = [
        ("2026-05-01", None, None), ("2026-05-01", "2026-05-03", "Europe/Berlin"), ("2026-05-01T10:00", None, None),
        ("bad", None, None), ("2026-05-01", "bad", None),
    ]
    df = spark.createDataFrame(rows, "s string, e string, z string")
    got = dates.with_converted_date(df, F.col("s"), F.col("e"), F.col("z"), "UTC", "d").select("d.*").collect()
    assert [(r.invalid, r.codes, r.start_timed) for r in got] == [
        (False, [], False), (False, ["DATE_TIMEZONE_NAME_NOT_PRESERVED"], False), (False, ["DATE_ASSUMED_TIMEZONE"], True),
        (True, ["DATE_UNPARSEABLE"], None), (True, ["DATE_UNPARSEABLE"], None),
    ]
    assert got[0].start_ms == 1777608000000 and got[1].end_ms == 1777780800000


# -- addresses and secrets --------------------------------------------------------------------------------
def test_urls(column):
    given_ = ["https://h.example/a", "HTTP://h.example", "ftp://h.example", "https://u:p@h.example", "https:///x", "h.example", "https://h.example:8080/a b", None]
    assert column(urls.valid_url, given_) == [True, True, False, False, False, False, True, False]
    assert column(urls.external_url, [" HTTPS://H.Example?q=1 ", "http://h.example:80/a b", "https://u@h.example/"]) == [
        "https://h.example/?q=1", "http://h.example/a%20b", None,
    ]


def test_safe_url_is_strict(column):
    bad = [
        " https://h.example", "https://h.example/​x", "javascript:alert(1)", "//h.example", "https:/h.example", "https://h\\x",
        "https://u:p@h.example/", "https://h.example/" + "a" * 2048, "mailto:nobody", "",
    ]
    assert column(urls.safe_url, bad) == [None] * len(bad)
    assert column(urls.safe_url, ["https://h.example/a", "mailto:a@b.example"]) == ["https://h.example/a", "mailto:a@b.example"]


def test_mail_and_phone(column):
    assert column(urls.valid_email, ["a@b.co", "a b@c.d", "a@b", "x" * 250 + "@b.co"]) == [True, False, False, False]
    assert column(urls.valid_phone, ["+49 (30) 123-456", "0301234567", " +1 23456 ", "+1234"]) == [True, False, True, False]


def test_scrub(column):
    token = "A1" * 10
    raw = [
        f"x ntn_{token} y", f"secret_{token}", f"pk_123_{token}", f"Bearer {token}", f'authorization: "{token}"',
        f"https://h.example/?a=1&sig={token}&b=2", "https://user:pw@h.example/", "ntn_short", "exact-value-1",
    ]
    got = column(lambda x: secrets.scrub(x, ["exact-value-1", "short"]), raw)
    assert not any(token in g for g in got)
    assert got[5] == "https://h.example/?a=1&sig=[REDACTED]&b=2"
    assert got[6] == "https://[REDACTED]@h.example/" and got[7] == "ntn_short" and got[8] == "[REDACTED]"


def test_scrub_json_is_deep(column):
    raw = ['{"a":{"Password":{"x":1}},"l":["Bearer abcdefghij",{"api-key":"k","apiKey":"k"}]}', "not json", None]
    assert column(secrets.scrub_json, raw) == [
        '{"a":{"Password":"[REDACTED]"},"l":["Bearer [REDACTED]",{"api-key":"k","apiKey":"[REDACTED]"}]}', "[REDACTED]", None,
    ]
    deep = '{"n":' * 40 + '"say \\"Bearer abcdefghij\\" ok"' + "}" * 40
    assert column(secrets.scrub_json, [deep, '["a:b","ntn_0123456789abcdef0"]', "[" * 100_000]) == [
        deep.replace("abcdefghij", "[REDACTED]"), '["a:b","[REDACTED]"]', "[REDACTED]",
    ]


def test_credential_paths_reach_every_level(spark):
    doc = '{"api_key":1,"a":{"b":[{"x_token":"t"},{"ok":{"PASSWORD":2}}]},"tokens":3,"deep":' + '{"d":' * 30 + '{"secret":1}' + "}" * 31
    df = spark.createDataFrame([(1, doc)], "id int, doc string")
    rows = secrets.credential_paths(df, "doc", ["id"]).collect()
    assert sorted(r.path for r in rows) == ["a.b[0].x_token", "a.b[1].ok.PASSWORD", "api_key", "deep" + ".d" * 30 + ".secret"]
    assert secrets.credential_paths(df.limit(0), "doc", ["id"]).count() == 0


# -- values ---------------------------------------------------------------------------------------------
def test_priority(column):
    got = column(values.priority_from, ["1", " 4 ", "5", "0", "Urgent!", "MEDIUM", "none", "1.5", "", None])
    assert got == [1, 4, None, None, 1, 3, None, None, None, None]


def typed(spark, kind, payloads):
    df = spark.createDataFrame([(i, kind, p) for i, p in enumerate(payloads)], "i int, k string, p string")
    parsed_ = df.withColumn("p", F.try_parse_json("p"))
    return [r.v for r in values.with_typed_value(parsed_, "k", "p", "v").orderBy("i").select("v").collect()]


def test_typed_values_never_fail(spark):
    numbers = typed(spark, "number", ["1.5", "null", '"1"', "{}", None])
    assert [(n.number, n.malformed) for n in numbers] == [(1.5, False), (None, False), (None, True), (None, True), (None, False)]
    selects = typed(spark, "select", ['{"name":"A","id":"x"}', "null", '{"id":"x"}', '"A"'])
    assert [(s.kind, s.name) for s in selects] == [("select", "A"), ("select", None), ("unsupported", None), ("unsupported", None)]
    boxes = typed(spark, "checkbox", ["true", "null", "1"])
    assert [b.malformed for b in boxes] == [False, True, True]
    dates_ = typed(spark, "date", ['{"start":"2026-01-01","time_zone":"UTC"}', "null", '{"end":"x"}'])
    assert [d.date.start if d.date else None for d in dates_] == ["2026-01-01", None, None]
    ids_ = typed(spark, "uniqueId", ['{"prefix":"T","number":7}', '{"number":7}', '{"prefix":"T"}'])
    assert [u.text for u in ids_] == ["T-7", "7", None]


def test_typed_computed_values_show_arrays(spark):
    rows = [
        (0, '{"type": "array", "array": [{"type": "number", "number": 2}, {"type": "title", "title": [{"plain_text": "a"}, {"plain_text": "b"}]}]}'),
        (1, '{"type": "number", "number": 3.5}'), (2, '{"type": "array", "array": []}'), (3, '{"type": "incomplete"}'),
        (4, '{"type": "string", "string": "text"}'), (5, '{"type": "date", "date": {"start": "2026-01-02"}}'), (6, "null"),
    ]
    df = spark.createDataFrame(rows, "i int, p string").select("i", F.lit("computed").alias("k"), F.try_parse_json("p").alias("p"))
    got = values.with_typed_value(df, "k", "p", "v").orderBy("i").select("v").collect()
    assert [r.v.text for r in got] == ["2, ab", "3.5", "", None, "text", "2026-01-02", None]
    assert not any(r.v.malformed for r in got)


def test_computed_display(spark):
    many = '{"type":"array","array":[' + ",".join('{"type":"number","number":%d}' % i for i in range(21)) + "]}"
    payloads = ['{"type":"number","number":900.0}', '{"type":"boolean","boolean":true}', many, '{"type":"unsupported"}', "{}",
                '{"type":"array","array":[{"type":"title","title":[{"plain_text":"a"},{"plain_text":"b"}]},{"type":"date","date":{"start":"d"}},{"type":"people","people":[]}]}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string").withColumn("p", F.try_parse_json("p"))
    got = values.with_computed_display(df, "rollup", "p", "c").orderBy("i").select("c.*").collect()
    assert [tuple(r) for r in got] == [
        ("900", True), ("true", True), (", ".join(map(str, range(21))), True), (None, False), (None, False), ("ab, d", True),
    ]


# -- rich text ------------------------------------------------------------------------------------------
def markdown(spark, spans):
    fields = ["text", "bold", "italic", "strikethrough", "underline", "code", "color", "href", "mention_kind", "mention_target", "equation"]
    from waybill.schemas import SPAN

    rows = [tuple(s.get(f, False if f in richtext.STYLE else None) for f in fields) for s in spans]
    df = spark.createDataFrame([(rows,)], f"s array<{SPAN}>")
    return df.select(richtext.spans_markdown(F.col("s"))).first()[0]


def test_inline_markdown(spark):
    assert markdown(spark, [dict(text="a", bold=True), dict(text="b", bold=True), dict(text=" c")]) == "**ab** c"
    assert markdown(spark, [dict(text=" x ", italic=True, bold=True)]) == " ***x*** "
    assert markdown(spark, [dict(text="a*b_[c]")]) == "a\\*b\\_\\[c\\]"
    assert markdown(spark, [dict(text="# no\n1. no\n- no")]) == "\\# no  \n1\\. no  \n\\- no"
    assert markdown(spark, [dict(text="x`y", code=True)]) == "``x`y``"
    assert markdown(spark, [dict(text="`y", code=True)]) == "`` `y ``"
    assert markdown(spark, [dict(text="l", href="https://h.example/a(b) c")]) == "[l](https://h.example/a%28b%29%20c)"
    assert markdown(spark, [dict(text="l", href="javascript:x")]) == "l"
    assert markdown(spark, [dict(text="e", equation="x^2")]) == "`x^2`"


def test_signs_leave_out_no_match(frame):
    """Patterns run behind a plain search for their signs, and find what they find alone."""
    texts = ["/Users/a", "x /home/", "/private/", "/var/folders", "a /tmp/", "b/tmp/", "/root", "a/root", "/root/x", "c:/", r"C:\x", "c:x", r"\\\\h\\", r"\h",
             "FILE://", "xfile://", "~/", "a ~/", "a~/", "eyJ" + "a" * 10 + "." + "b" * 10 + ".ccccc", "sk-" + "a" * 20, "secret_" + "a" * 16,
             "ntn_" + "b" * 16, "pk_1_" + "a" * 12, "bearer " + "a" * 16, "authorization :", "", None]
    patterns = [*secrets.LEAK_RULES.values(), *secrets.MACHINE_PATHS.values()]
    df = frame([(t,) for t in texts], "x string")
    for pattern in patterns:
        rows = df.select(F.col("x").rlike(pattern).alias("alone"), secrets.holds(F.col("x"), pattern).alias("behind")).collect()
        assert [r.alone or False for r in rows] == [r.behind or False for r in rows]
        assert any(r.alone for r in rows)
    assert set(secrets.SIGNS) <= set(patterns)
