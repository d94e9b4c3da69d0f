"""Where each source field, value and person goes at the destination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions.ids import user_key
from waybill.functions.text import canon, matches_terms, wide_trim
from waybill.functions.values import priority_from
from waybill.operators.findings import outcome_words
from waybill.session import config_frame

START_NAME = r"(?i)(^|\W)(start|begin|from|kickoff)"
DUE_NAME = r"(?i)(^|\W)(due|deadline|end|finish|target)"


def markers_in(text: Column, prefix: str) -> Column:
    """All provenance keys in a text."""
    literal = "".join("\\" + c if c in "-:.[](){}+*?|^$\\" else c for c in prefix)
    return F.regexp_extract_all(text, F.lit(rf"{literal}([^\s`]+)"), F.lit(1))


# -- targets of fields ----------------------------------------------------------------------------------
def _candidates(fields: DataFrame) -> DataFrame:
    """First and second choice of each field by kind and name."""
    kind, name = F.col("kind"), F.col("name")
    per_collection = Window.partitionBy("collection")
    only_date = F.count_if(kind == "date").over(per_collection) == 1
    due = (kind == "date") & (name.rlike(DUE_NAME) | only_date)
    first = (
        F.when(kind == "status", F.lit("status"))
        .when((kind == "select") & name.rlike("(?i)prio"), F.lit("priority"))
        .when((kind == "date") & name.rlike(START_NAME), F.lit("start_date"))
        .when(due, F.lit("due_date"))
        .when((kind == "person") & name.rlike("(?i)(owner|assign|responsible|lead|dri)"), F.lit("assignees"))
        .when((kind == "multiSelect") & name.rlike("(?i)(tag|label)"), F.lit("tags"))
    )
    return fields.withColumn("_first", first).withColumn(
        "_second", F.when((F.col("_first") == "start_date") & due, F.lit("due_date"))
    )


def infer_targets(fields: DataFrame) -> DataFrame:
    """The target a field would get if no other field wanted it."""
    return _candidates(fields).withColumn("target", F.col("_first")).drop("_first", "_second")


def _winner(claims: DataFrame, target: str) -> Column:
    """Lowest position among the claimants of a target in a collection."""
    return F.row_number().over(Window.partitionBy("collection", target).orderBy("pos"))


def claim_targets(fields: DataFrame) -> DataFrame:
    """One field per single-valued target: explicit claims first, then inference in field order.

    fields carry ``explicit_to`` (null when the configuration says nothing). A second explicit
    claim is a conflict. A date field that loses its start date may still take the due date.
    Windows run over the fields of one collection, which its schema bounds.
    """
    single = list(vocab.TARGET_KINDS)
    claims = _candidates(fields)
    explicit = F.col("explicit_to").isin(*single)
    taken = F.collect_set(F.when(explicit, F.col("explicit_to"))).over(Window.partitionBy("collection"))
    order = F.row_number().over(Window.partitionBy("collection", "explicit_to").orderBy("pos"))
    base = claims.withColumn("_taken", taken).withColumn("_order", order)
    open_for = lambda c: F.col("explicit_to").isNull() & F.col(c).isNotNull() & ~F.array_contains("_taken", F.col(c))
    first = base.withColumn("_want", F.when(open_for("_first"), F.col("_first")))
    rank1 = F.row_number().over(Window.partitionBy("collection", "_want").orderBy("pos"))
    is_due = F.col("_want") == "due_date"
    won = first.withColumn(
        "_won", F.when(F.col("_want").isNotNull() & ~is_due & (rank1 == 1), F.col("_want"))
    )
    # Due date: direct wishes and fields that lost their start date compete in field order.
    wants_due = is_due | (F.col("_won").isNull() & open_for("_second"))
    due = won.withColumn("_due", F.when(F.coalesce(wants_due, F.lit(False)), F.lit("due_date")))
    rank2 = F.row_number().over(Window.partitionBy("collection", "_due").orderBy("pos"))
    inferred = F.coalesce(
        F.col("_won"), F.when(F.col("_due").isNotNull() & (rank2 == 1), F.col("_due"))
    )
    done = due.withColumn("_inferred", inferred)
    conflict = explicit & (F.col("_order") > 1)
    return done.select(
        *fields.columns,
        F.when(explicit, F.col("explicit_to")).otherwise(F.col("_inferred")).alias("target"),
        F.coalesce(explicit, F.lit(False)).alias("explicit"),
        F.coalesce(conflict, F.lit(False)).alias("conflict"),
    )


def mapping_config_errors(fields: DataFrame, config: DataFrame) -> DataFrame:
    """Blocking errors of a mapping: unknown field names, kinds a target cannot hold, relations
    mapped as fields. config: collection, name, to."""
    known = fields.select("collection", "name", "kind", F.lit(True).alias("_known"))
    joined = config.join(known, ["collection", "name"], "left")
    allowed = reduce(
        lambda a, t: a | ((F.col("to") == t) & F.col("kind").isin(*vocab.TARGET_KINDS[t])),
        vocab.TARGET_KINDS, F.lit(False),
    )
    simple = F.col("to").isin(*vocab.TARGET_KINDS)
    code = (
        F.when(F.col("_known").isNull(), F.lit("MAPPING_UNKNOWN_FIELD"))
        .when((F.col("kind") == "relation") & (F.col("to") != "skip"), F.lit("MAPPING_INCOMPATIBLE"))
        .when((F.col("kind") != "relation") & simple & ~allowed, F.lit("MAPPING_INCOMPATIBLE"))
    )
    return joined.withColumn("code", code).where(F.col("code").isNotNull()).select(
        "collection", F.col("name").alias("field"), "code", F.lit("error").alias("severity")
    )


def resolve_custom_field(wanted: DataFrame, targets: DataFrame, normalize: bool = True) -> DataFrame:
    """Target field by id, else by canonical name; then whether its type can hold the kind.

    wanted: field_id, kind, field. targets: target_id, target_name, target_type, pos.
    """
    by_id = targets.select(F.col("target_id").alias("_wanted"), F.struct("target_id", "target_name", "target_type").alias("_by_id"))
    by_name = targets.groupBy(canon(F.col("target_name"), normalize).alias("_canon")).agg(
        F.min_by(F.struct("target_id", "target_name", "target_type"), F.col("pos")).alias("_by_name")
    )
    keyed = wanted.withColumn("_wanted", wide_trim(F.col("field"))).withColumn(
        "_canon", canon(F.col("_wanted"), normalize)
    )
    joined = keyed.join(by_id, "_wanted", "left").join(by_name, "_canon", "left")
    target = F.coalesce("_by_id", "_by_name")
    fits = reduce(
        lambda a, k: a | ((F.col("kind") == k) & target["target_type"].isin(*vocab.CUSTOM_FIELD_TYPES[k])),
        vocab.CUSTOM_FIELD_TYPES, F.lit(False),
    )
    code = F.when(target.isNull(), F.lit("MAPPING_CUSTOM_FIELD_UNKNOWN")).when(
        ~fits, F.lit("MAPPING_CUSTOM_FIELD_TYPE")
    )
    return joined.select(
        *wanted.columns, target["target_id"].alias("target_id"),
        target["target_type"].alias("target_type"), code.alias("code"),
    )


# -- collections ------------------------------------------------------------------------------------------
def _loose(text: Column) -> Column:
    return F.replace(F.lower(wide_trim(text)), F.lit("-"), F.lit(""))


def match_collections(collections: DataFrame, config: DataFrame) -> DataFrame:
    """Each collection with the first configuration entry that names it by id, name or key.

    The three ways are three equi-joins, so none of them compares every pair. config: pos, source,
    list_id.
    """
    by_id = collections.select("key", _loose(F.col("id")).alias("_k"))
    by_name = collections.select("key", _loose(F.col("name")).alias("_k"))
    loose = config.select("pos", "source", "list_id", _loose(F.col("source")).alias("_k"))
    exact = config.select("pos", "source", "list_id", wide_trim(F.col("source")).alias("key"))
    hits = (
        by_id.join(loose, "_k").drop("_k")
        .unionByName(by_name.join(loose, "_k").drop("_k"))
        .unionByName(collections.select("key").join(exact, "key"))
    )
    first = hits.groupBy("key").agg(F.min_by(F.struct("pos", "source", "list_id"), F.col("pos")).alias("_m"))
    return collections.join(first, "key", "left").select(
        *collections.columns, F.col("_m.source").alias("source"), F.col("_m.list_id").alias("list_id")
    )


def unselected_config(collections: DataFrame, config: DataFrame) -> DataFrame:
    """Configuration entries that name no collection that was read (blocking)."""
    names = (
        collections.select(_loose(F.col("id")).alias("_k"))
        .unionByName(collections.select(_loose(F.col("name")).alias("_k")))
    )
    keys = collections.select(F.col("key").alias("_key"))
    missing = config.withColumn("_k", _loose(F.col("source"))).join(names, "_k", "left_anti")
    return missing.withColumn("_key", wide_trim(F.col("source"))).join(keys, "_key", "left_anti").select(
        *config.columns, F.lit("CONFIG_SOURCE_NOT_SELECTED").alias("code")
    )


def unmapped_collections(matched: DataFrame) -> DataFrame:
    """Collections without an entry: reported with their row count, none of their rows move."""
    return matched.where(F.col("list_id").isNull()).select(
        "key", "name", "record_count", F.lit("COLLECTION_NOT_MAPPED").alias("code")
    )


# -- values -----------------------------------------------------------------------------------------------
def _by_canon(df: DataFrame, source: str, target: str, normalize: bool, by: Sequence[str] = ()) -> DataFrame:
    """One target per canonical source text; the last entry wins."""
    return df.groupBy(*by, canon(F.col(source), normalize).alias("_canon")).agg(
        F.max_by(target, "pos").alias("_to")
    )


def value_lookup(value_map: DataFrame, names: DataFrame, normalize: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Canonical option text to destination name: valid explicit entries, else equal names.

    value_map: pos, from, to. names: pos, name. Both are bounded by the destination's schema. With ``by`` (the field, say)
    both hold entries of several maps, and each has its own texts.
    """
    real = _by_canon(names, "name", "name", normalize, by)
    explicit = (
        value_map.withColumn("_t", canon(F.col("to"), normalize))
        .join(real.select(*by, F.col("_canon").alias("_t"), F.col("_to").alias("_real")), [*by, "_t"])
        .groupBy(*by, canon(F.col("from"), normalize).alias("_canon"))
        .agg(F.max_by("_real", "pos").alias("_explicit"))
    )
    return explicit.join(real, [*by, "_canon"], "full").select(
        *by, "_canon", F.coalesce("_explicit", "_to").alias("target"),
        F.when(F.col("_explicit").isNotNull(), F.lit("value_map")).otherwise(F.lit("name_match")).alias("via"),
    )


def value_map_join(
    values: DataFrame, text: str, value_map: DataFrame, names: DataFrame, normalize: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Map option text to the destination; null target means unmapped.

    ``by`` names the columns (the field, say) that a value shares with its map, so all fields are mapped in one pass. The
    canonical form is taken once per distinct text of a mapped field, and the cells join on the text as it is.
    """
    lookup = value_lookup(value_map, names, normalize, by)
    return values.join(_per_text(values, text, lookup, normalize, by), [*by, text], "left")


def _per_text(values: DataFrame, text: str, lookup: DataFrame, normalize: bool, by: Sequence[str] = ()) -> DataFrame:
    """A lookup by canonical text as a lookup by the texts that occur."""
    texts = values.select(*by, text).where(F.col(text).isNotNull())
    if by:
        texts = texts.join(lookup.select(*by).distinct(), list(by), "left_semi")
    return texts.distinct().withColumn("_canon", canon(F.col(text), normalize)).join(lookup, [*by, "_canon"]).drop("_canon")


def value_map_validate(value_map: DataFrame, names: DataFrame, normalize: bool = True) -> DataFrame:
    """Explicit targets that do not exist at the destination (blocking)."""
    held = names.select(canon(F.col("name"), normalize).alias("_t")).distinct()
    return value_map.withColumn("_t", canon(F.col("to"), normalize)).join(held, "_t", "left_anti").drop("_t")


def priority_map_validate(value_map: DataFrame) -> DataFrame:
    """Explicit priorities that are neither 1 to 4 nor a known name (blocking)."""
    return value_map.where(priority_from(F.col("to").cast("string")).isNull())


def unmapped_options(mapped: DataFrame) -> DataFrame:
    """Options without an equivalent, gathered per field in option order.

    mapped: field_id, option, pos, target. Options of one field are bounded by its definition.
    """
    missing = mapped.where(F.col("target").isNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "option"))), lambda s: s["option"])
    return missing.groupBy("field_id").agg(ordered.alias("unmapped"))


def suggest_status(unmapped: DataFrame, statuses: DataFrame) -> DataFrame:
    """For an unmapped option with a status group: the one status of that group's types, if there
    is exactly one. unmapped: option, group. statuses: name, type."""
    spark = unmapped.sparkSession
    types = config_frame(
        spark, [(g, t) for g, ts in vocab.STATUS_GROUP_TYPES.items() for t in ts], "_group string, type string"
    )
    only = (
        types.join(statuses, "type").groupBy("_group")
        .agg(F.count("*").alias("_n"), F.first("name").alias("suggestion")).where(F.col("_n") == 1)
    )
    return unmapped.withColumn("_group", canon(F.col("group"))).join(only, "_group").drop("_group", "_n")


def tag_match(rows: DataFrame, keys: list[str], tags: str, held: DataFrame) -> DataFrame:
    """Tags that exist at the destination (its spelling, no repeats) and those that do not.

    Tags of one row are bounded; ``held`` has one column, name.
    """
    lookup = _by_canon(held.withColumn("pos", F.lit(0)), "name", "name", True)
    exploded = rows.select(*keys, F.posexplode(tags).alias("_pos", "_tag")).withColumn(
        "_canon", canon(F.col("_tag"))
    )
    joined = exploded.join(lookup, "_canon", "left")
    ordered = lambda c, keep: F.transform(
        F.array_sort(F.collect_list(F.when(keep, F.struct("_pos", c)))), lambda s: s[c]
    )
    hit = F.col("_to").isNotNull()
    return joined.groupBy(*keys).agg(
        F.array_distinct(ordered("_to", hit)).alias("applied"), ordered("_tag", ~hit).alias("missing")
    )


def dropdown_match(cells: DataFrame, text: str, options: DataFrame, normalize: bool = True) -> DataFrame:
    """Option text to option id; a miss keeps the text. options: option_id, name, pos."""
    lookup = _by_canon(options, "name", "option_id", normalize)
    joined = cells.join(_per_text(cells, text, lookup, normalize), text, "left")
    return joined.withColumn("option_id", F.col("_to")).withColumn(
        "fallback", F.when(F.col("_to").isNull(), F.col(text))
    ).drop("_to")


def option_difference(options: DataFrame, held: DataFrame, normalize: bool = True) -> DataFrame:
    """Source options EXCEPT destination options, compared by canonical text."""
    names = held.select(canon(F.col("name"), normalize).alias("_canon")).distinct()
    return options.withColumn("_canon", canon(F.col("option"), normalize)).join(
        names, "_canon", "left_anti"
    ).drop("_canon")


def field_rule_outcomes(mapped: DataFrame) -> DataFrame:
    """Rule outcome per field from the coverage of its options.

    mapped: field_id, target_kind, target_type, kind, option, target.
    """
    same = ["number", "checkbox", "date", "url", "email", "phone"]
    identical = (F.col("kind") == F.col("target_type")) & F.col("kind").isin(*same)
    choice = F.col("target_type").isin("drop_down", "labels")
    counted = mapped.groupBy("field_id", "kind", "target_kind", "target_type").agg(
        F.count("option").alias("options"),
        F.count_if(F.col("option").isNotNull() & F.col("target").isNull()).alias("unmapped"),
    )
    complete = (
        F.when(F.col("target_kind") == "status", F.lit("supported"))
        .when(F.col("target_kind") == "priority", F.lit("transformed"))
        .when(F.col("target_kind").isin("due_date", "start_date"), F.lit("supported"))
        .when(F.col("target_kind").isin("assignees", "tags"), F.lit("transformed"))
        .when(identical | choice, F.lit("supported"))
        .otherwise(F.lit("transformed"))
    )
    return counted.withColumn(
        "outcome", F.when(F.col("unmapped") > 0, F.lit("lossy")).otherwise(complete)
    )


def date_slots(cells: DataFrame, record: str = "record") -> DataFrame:
    """Start and due instants of a record from its due-date and start-date fields.

    cells: record, target (due_date | start_date), pos, start_ms, end_ms. A range in one field also
    fills the other slot unless that field comes first; the part that is lost is named.
    """
    of = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    per = cells.groupBy(record).agg(
        *[of(t, c).alias(f"{t}_{c}") for t in ("due_date", "start_date") for c in ("pos", "start_ms", "end_ms")]
    )
    due_start, due_end = F.col("due_date_start_ms"), F.col("due_date_end_ms")
    start_start, start_end = F.col("start_date_start_ms"), F.col("start_date_end_ms")
    start_first = F.col("start_date_pos") < F.col("due_date_pos")
    lost = (
        F.when(due_end.isNotNull() & start_start.isNotNull() & start_first, F.lit("DATE_RANGE_START_LOST"))
        .when(start_end.isNotNull() & due_start.isNotNull() & ~start_first, F.lit("DATE_RANGE_END_LOST"))
    )
    return per.select(
        record,
        F.coalesce(due_end, due_start, start_end).alias("due_ms"),
        F.coalesce(start_start, F.when(due_end.isNotNull(), due_start)).alias("start_ms"),
        lost.alias("lost"),
    )


# -- people -----------------------------------------------------------------------------------------------
def _member_map(user_map: DataFrame, members: DataFrame) -> DataFrame:
    """Explicit entries that name a member: user key to member id, the last entry wins."""
    valid = user_map.join(members.select(F.col("id").alias("target")), "target", "left_semi")
    return valid.groupBy(user_key(F.col("source")).alias("_key")).agg(F.max_by("target", "pos").alias("_id"))


def resolve_users(
    users: DataFrame, user_map: DataFrame, members: DataFrame, match_by_email: bool = False
) -> DataFrame:
    """Person to member: explicit by id, explicit by e-mail, then (when asked) equal e-mail.

    users: key, id, email. user_map: pos, source, target. members: id, email, pos.
    """
    explicit = _member_map(user_map, members)
    by_id = explicit.select(F.col("_key").alias("_id_key"), F.col("_id").alias("_by_id"))
    by_mail = explicit.select(F.col("_key").alias("_mail_key"), F.col("_id").alias("_by_mail"))
    keyed = users.withColumn("_id_key", user_key(F.col("id"))).withColumn(
        "_mail_key", user_key(F.col("email"))
    ).withColumn("_mail", F.lower(wide_trim(F.col("email"))))
    joined = keyed.join(by_id, "_id_key", "left").join(by_mail, "_mail_key", "left")
    if match_by_email:
        same = members.where(F.col("email").isNotNull()).groupBy(
            F.lower(wide_trim(F.col("email"))).alias("_mail")
        ).agg(F.min_by("id", "pos").alias("_same"))
        joined = joined.join(same, "_mail", "left")
    else:
        joined = joined.withColumn("_same", F.lit(None).cast(members.schema["id"].dataType))
    stated = F.coalesce("_by_id", "_by_mail")
    return joined.select(
        *users.columns, F.coalesce(stated, F.col("_same")).alias("member_id"),
        F.when(stated.isNotNull(), F.lit("explicit")).when(F.col("_same").isNotNull(), F.lit("email")).alias("via"),
    )


def invalid_user_targets(user_map: DataFrame, members: DataFrame) -> DataFrame:
    """User-map entries that point to somebody who is not a member (blocking)."""
    return user_map.join(members.select(F.col("id").alias("target")), "target", "left_anti")


def user_tally(assignments: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct people mapped and unmapped, and the assignments that notify somebody.

    assignments: action_id, user_key, disposition. resolved: key, member_id.
    """
    people = resolved.select(F.col("key").alias("user_key"), "member_id")
    joined = assignments.join(people, "user_key", "left")
    mapped = F.col("member_id").isNotNull()
    # Per person first: distinct counts then need no expansion of the assignments.
    per_user = joined.groupBy("user_key").agg(
        F.max(mapped).alias("_mapped"),
        F.count_if(mapped & (F.col("disposition") != "skip")).alias("_notify"),
    )
    return per_user.agg(
        F.count_if("_mapped").alias("mapped"), F.count_if(~F.col("_mapped")).alias("unmapped"),
        F.sum("_notify").alias("notify"),
    )


# -- the mapping table itself ---------------------------------------------------------------------------
def mapping_search_text() -> Column:
    words = lambda c, table: vocab.lookup(F.col(c), table, F.col(c))
    return F.concat_ws(
        " \n ", F.coalesce("collection_name", "collection"), "field_name", "source_type", "kind",
        words("target_kind", vocab.TARGET_LABELS), "target_kind",
        words("transform", vocab.TRANSFORM_LABELS), "transform", outcome_words(F.col("outcome")),
        "reason", F.when(F.col("explicit"), F.lit("explicit config")).otherwise(F.lit("inferred")),
        F.array_join("unmapped", " \n "), F.array_join(F.map_keys("value_map"), " \n "),
    )


def filter_mappings(
    mappings: DataFrame, collections: DataFrame, collection: str = "all", query: str = "",
    outcome: str = "all",
) -> DataFrame:
    names = collections.select(F.col("key").alias("collection"), F.col("name").alias("collection_name"))
    rows = mappings if collection == "all" else mappings.where(F.col("collection") == collection)
    rows = rows.join(names, "collection", "left").where(matches_terms(mapping_search_text(), query))
    return rows if outcome == "all" else rows.where(F.col("outcome") == outcome)


def outcome_chip_counts(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Count per outcome plus an `all` total, in one pass over the rows."""
    counted = rows.rollup(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return counted.select(
        F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("outcome")).alias("outcome"), "n"
    )
