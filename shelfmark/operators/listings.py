"""Listings and details of inspections. Dimensions grow with the registry, so no side is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_or_all(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows where the column has this value; all rows if the value is None, empty or ALL."""
    return df if value in (None, "", "ALL") else df.where(F.col(column) == value)


def by_officer(df: DataFrame, users: DataFrame, code: str | None) -> DataFrame:
    """Rows of this officer; all rows if no officer has the code."""
    found = users.where(F.col("officer_code") == code).select("user_id").first() if code else None
    return df if found is None else df.where(F.col("officer_id") == found[0])


def inspection_list(inspections: DataFrame, stores: DataFrame, users: DataFrame, violations: DataFrame, status: str | None = None, supervisor_status: str | None = None,
                    officer_code: str | None = None, with_assignee: bool = False, limit: int = 50) -> DataFrame:
    """The newest inspections with their store, officer and number of violations.

    The top rows are taken first; the joins and the count see them alone. Of equal times the larger id is the newer.
    """
    picked = by_officer(equal_or_all(equal_or_all(inspections, "compliance_status", status), "supervisor_status", supervisor_status), users, officer_code)
    top = picked.orderBy(F.desc("created_at"), F.desc("inspection_id")).limit(limit)
    count = violations.join(F.broadcast(top.select("inspection_id")), "inspection_id", "left_semi").groupBy("inspection_id").agg(F.count(F.lit(1)).alias("n"))
    name = lambda key, as_: users.select(F.col("user_id").alias(key), F.col("full_name").alias(as_))
    rows = (top.join(stores.select("store_id", "store_name"), "store_id", "left").join(name("officer_id", "officer"), "officer_id", "left")
            .join(name("assigned_to_id", "assignee"), "assigned_to_id", "left").join(count, "inspection_id", "left"))
    more = [F.col("assignee").alias("assigned_name"), "fee"] if with_assignee else ["sync_status"]
    return rows.select(
        "inspection_id", "inspection_number", "category", "score_tenths", "officer_verified", F.coalesce("store_name", F.lit("Unassigned Store")).alias("store_name"), F.coalesce("officer", F.lit("Inspector")).alias("officer_name"),
        "compliance_status", "supervisor_status", F.coalesce("n", F.lit(0)).alias("violations_count"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_text"), F.coalesce(F.nullif(F.col("evidence_image_path"), F.lit("")), "image_path").alias("shown_image"), *more)


def inspection_detail(inspections: DataFrame, stores: DataFrame, users: DataFrame, violations: DataFrame) -> DataFrame:
    """Every inspection with its store, officer and violations in one line, in the order of code, severity and amount."""
    line = F.struct("rule_code", "severity", "amount")
    nested = violations.groupBy("inspection_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["rule_code"], x["severity"], x["amount"].cast("string"))), ",")
    return (inspections.join(stores, "store_id", "left").join(users.withColumnRenamed("user_id", "officer_id"), "officer_id", "left").join(nested, "inspection_id", "left")
            .select("inspection_id", "store_code", "store_name", "officer_code", text.alias("codes"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("violations_count")))


def inspection_documents(inspections: DataFrame, stores: DataFrame, users: DataFrame, declarations: DataFrame, violations: DataFrame, inspection_id: int | None = None) -> DataFrame:
    """Every inspection, or the one of this id, as a nested row: struct store and officer, arrays declarations and violations.

    A store or an officer that is not there is a null struct; without declarations or violations the array is empty.
    Declarations are of the inspection's image. Each side is put together before the join, so a joined row is a whole one.
    Stores and officers are joined while rows are narrow, the arrays after them, so each array is moved once at most. For
    one inspection, all sides are cut down to its rows first.
    """
    if inspection_id is not None:
        inspections, violations = (df.where(F.col("inspection_id") == inspection_id) for df in (inspections, violations))
        of_it = lambda df, column, key: df.join(F.broadcast(inspections.select(F.col(column).alias(key))), key, "left_semi")  # noqa: E731  one row
        declarations, stores, users = of_it(declarations, "image_id", "image_id"), of_it(stores, "store_id", "store_id"), of_it(users, "officer_id", "user_id")
    nested = lambda df, key, columns, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    decs = nested(declarations, "image_id", ["field_name", "detected_value", "is_present", "stored_confidence", "readability"], "declarations")
    viols = nested(violations, "inspection_id", ["rule_code", "category", "severity", "amount"], "violations")
    store = stores.select("store_id", F.struct("store_id", "store_code", "store_name", "fssai_license", "city").alias("store"))
    officer = users.select(F.col("user_id").alias("officer_id"), F.struct("user_id", "officer_code", "full_name").alias("officer"))
    rows = inspections.join(store, "store_id", "left").join(officer, "officer_id", "left").join(viols, "inspection_id", "left").join(decs, "image_id", "left")
    empty = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    return rows.select("inspection_id", "inspection_number", "store", "officer", "category", "compliance_status", "score_tenths", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_text"),
                       "officer_verified", "supervisor_status", "fee", "image_path", "evidence_image_path", "sync_status", empty(decs, "declarations"), empty(viols, "violations"))


def rules_catalog(rules: DataFrame, violations: DataFrame) -> DataFrame:
    """The rules by code, with the fee that is due by default and how often each was broken."""
    fee = F.when(F.col("severity") == "CRITICAL", 10000).otherwise(5000)
    broken = violations.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(broken, "rule_code", "left").select(
        "rule_code", "category", "severity", fee.alias("fee"), "legal_reference", F.col("legal_reference").alias("rule_clause"), F.coalesce("n", F.lit(0)).alias("violations_count")).orderBy("rule_code")


def traceability(matrix: DataFrame, declarations: DataFrame) -> DataFrame:
    """The statutory matrix, with how many declarations of each row's fields there are and how many of those are present.

    ``matrix`` has in ``field_names`` the fields that a row is about, none if no field is; ``declarations``: field_name, is_present.
    """
    counts = declarations.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_present").alias("present"))
    fields = matrix.select("declaration", F.explode("field_names").alias("field_name")).join(counts, "field_name").groupBy("declaration").agg(F.sum("n").alias("n"), F.sum("present").alias("present"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return matrix.drop("field_names").join(fields, "declaration", "left").select(*matrix.drop("field_names").columns, zero("n", "declared"), zero("present", "present"))


def users_by_role(users: DataFrame, role: str | None = None) -> DataFrame:
    return equal_or_all(users, "role", role).select("user_id", "officer_code", "full_name", "role", "is_active")
