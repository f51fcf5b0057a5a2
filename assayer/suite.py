"""One query for each operator over the test tables, and the SQL that gives the same rows.

A query validates a whole table and returns its results.  The SQL states each rule's
count of violations on its own, so it shares nothing with the engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.builders import ColumnBuilder, RelationBuilder, date_column, float_column, integer_column, relation, string_column
from assayer.operators.moments import profile
from assayer.report import JsonReporter
from assayer.results import CAST_FAILURE
from assayer.shipping import shared_folder
from assayer.sources.sizing import SplitSize
from assayer.tables import CsvTable, FrameTable, ParquetTable, Validator

@dataclass
class Count:
    """What SQL says of a rule: its violations as an aggregate over ``source``."""

    target: str
    rule: str
    errors: str
    threshold: float = 0.0
    kind: str = "column"
    message: str | None = None


@dataclass
class Case:
    table: str
    columns: Callable[[], list[ColumnBuilder]]
    counts: list[Count]
    relations: Callable[[], list[RelationBuilder]] = lambda: []
    select: dict[str, str] | None = None  # column: Spark SQL; the Parquet file itself if None
    source: str | None = None  # the same for DuckDB; the table itself if None
    text: bool = False
    order_by: list[str] | None = None
    compat: bool = False
    files: str | None = None  # "csv" or "parquet": the selected columns are written to such files first
    written_by: list[str] | None = None  # columns that order what is written

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/{self.table}.parquet"
        if self.select is None:
            table = ParquetTable(path, self.table, spark, self.order_by, self.compat)
        else:
            rows = spark.read.parquet(path)
            rows = rows.orderBy(*self.written_by) if self.written_by else rows
            frame = rows.selectExpr(*(f"{e} AS `{n}`" for n, e in self.select.items()))
            table = self._from_files(frame) if self.files else FrameTable(frame, self.table, self.order_by, self.compat, self.text)
        return table.prepare(self.columns(), self.relations()).results()

    def _from_files(self, frame: DataFrame) -> CsvTable | ParquetTable:
        folder = shared_folder(frame.sparkSession, f"{self.table}.{self.files}") + f"/{self.table}.{self.files}"
        if self.files == "csv":
            frame.write.option("header", True).option("emptyValue", "").csv(folder)
            return CsvTable(folder, self.table, frame.sparkSession, self.order_by, self.compat, split=SplitSize())
        frame.write.parquet(folder)
        return ParquetTable(folder, self.table, frame.sparkSession, self.order_by, self.compat)

    def sql(self) -> str:
        source = self.source or f"SELECT * FROM {self.table}"
        rows = ", ".join(f"{c.errors} AS e{i}" for i, c in enumerate(self.counts))
        parts = []
        for i, c in enumerate(self.counts):
            message = "CAST(NULL AS VARCHAR)" if c.message is None else "'" + c.message.replace("'", "''") + "'"
            share = f"CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * e{i} / n END"
            parts.append(
                f"SELECT '{self.table}' AS table_name, '{c.kind}' AS kind, '{c.target}' AS target, '{c.rule}' AS rule_name, e{i}::BIGINT AS error_count, "
                f"{share} AS error_percentage, {c.threshold}::DOUBLE AS threshold, {share} <= {c.threshold} AS passed, {message} AS error_message FROM counted"
            )
        return f"WITH source AS ({source}), counted AS (SELECT count(*) AS n, {rows} FROM source) " + " UNION ALL ".join(parts)


def when(condition: str) -> str:
    """Rows where the condition holds; null is no violation."""
    return f"count(*) FILTER (WHERE {condition})"


def number_case(name: str, table: str, column: str, add: Callable, rule: str, condition: str, floats: bool = True) -> tuple[str, Case]:
    make = float_column if floats else integer_column
    return name, Case(table, lambda: [add(make(column))], [Count(column, rule, when(condition))])


EPS = "2.220446049250313e-16"
SHARED = "regexp_matches"


def text_case(name: str, table: str, column: str, add: Callable, rule: str, condition: str) -> tuple[str, Case]:
    return name, Case(table, lambda: [add(string_column(column))], [Count(column, rule, when(condition))])


def _prefix_case(name: str, add: Callable, rule: str, pattern: str, spark_expr: str, duck_expr: str, table: str = "documents") -> tuple[str, Case]:
    return name, Case(table, lambda: [add(string_column("x"))], [Count("x", rule, when(f"NOT regexp_matches(x, '{pattern}')"))], select={"x": spark_expr}, source=f"SELECT {duck_expr} AS x FROM {table}")


ORDERS = "SELECT o_orderkey, o_orderdate::DATE AS d, o_totalprice FROM orders"
DATES = {"d": "cast(o_orderdate AS date)"}


def date_case(name: str, add: Callable, rule: str, condition: str) -> tuple[str, Case]:
    return name, Case("orders", lambda: [add(date_column("d"))], [Count("d", rule, when(condition))], select=DATES, source=ORDERS)


def _date_relations() -> dict[str, Case]:
    out = {}
    for op, sql, title in (("gt", ">", "GreaterThan"), ("gte", ">=", "GreaterThanEqual"), ("=", "=", "Equal"), ("lte", "<=", "LesserThanEqual"), ("lt", "<", "LesserThan")):
        key = {"=": "eq"}.get(op, op)
        out[f"rel_date_{key}"] = Case(
            "orders",
            lambda: [date_column("a"), date_column("b")],
            [Count("a | b", f"DateCompare {title}", when(f"NOT coalesce(a {sql} b, false) AND NOT (a IS NULL AND b IS NULL)"), kind="relation")],
            lambda op=op: [relation("a", "b").date_comparaison(op)],
            {"a": "nullif(cast(o_orderdate AS date), date'1995-03-01')", "b": "date_add(cast(o_orderdate AS date), cast(o_orderkey % 3 AS int) - 1)"},
            "SELECT nullif(o_orderdate::DATE, DATE '1995-03-01') AS a, o_orderdate::DATE + ((o_orderkey % 3)::INTEGER - 1) AS b FROM orders",
        )
        out[f"rel_num_{key}"] = Case(
            "lineitem",
            lambda: [float_column("a"), float_column("b")],
            [Count("a | b", f"DateCompare {title}", when(f"NOT coalesce(a {sql} b AND NOT isnan(a) AND NOT isnan(b), false) AND NOT (a IS NULL AND b IS NULL)"), kind="relation")],
            lambda op=op: [relation("a", "b").numeric_comparaison(op)],
            {"a": "CASE WHEN l_linenumber = 7 THEN double('NaN') ELSE nullif(l_quantity, 5.0) END", "b": "nullif(floor(l_discount * 1000) / 2, 10.0)"},
            "SELECT CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE nullif(l_quantity, 5.0) END AS a, nullif(floor(l_discount * 1000) / 2, 10.0) AS b FROM lineitem",
        )
    return out


CASES: dict[str, Case] = dict(
    [
        number_case("num_between", "lineitem", "l_quantity", lambda c: c.between(5, 45), "Between", "l_quantity < 5 OR l_quantity > 45"),
        number_case("num_min", "lineitem", "l_extendedprice", lambda c: c.min(2000), "Min", "l_extendedprice < 2000"),
        number_case("num_max", "lineitem", "l_extendedprice", lambda c: c.max(50000), "Max", "l_extendedprice > 50000"),
        number_case("num_positive", "customer", "c_acctbal", lambda c: c.is_positive(), "IsPositive", f"c_acctbal < {EPS}"),
        number_case("num_negative", "customer", "c_acctbal", lambda c: c.is_negative(), "IsNegative", f"c_acctbal > -{EPS}"),
        number_case("num_non_negative", "customer", "c_acctbal", lambda c: c.is_non_negative(), "IsNonNegative", "c_acctbal < 0"),
        number_case("num_non_positive", "events", "value", lambda c: c.is_non_positive(), "IsNonPositive", "value > 0"),
        number_case("int_positive", "events", "user_id", lambda c: c.is_positive(), "IsPositive", "user_id < 1", False),
        number_case("int_between", "part", "p_size", lambda c: c.between(3, 40), "Between", "p_size < 3 OR p_size > 40", False),
        text_case("str_len_between", "documents", "text", lambda c: c.with_length_between(100, 2000), "WithLengthBetween", "strlen(text) < 100 OR strlen(text) > 2000"),
        text_case("str_len_min", "documents", "text", lambda c: c.with_min_length(300), "WithMinLength", "strlen(text) < 300"),
        text_case("str_len_max", "part", "p_name", lambda c: c.with_max_length(12), "WithMaxLength", "strlen(p_name) > 12"),
        text_case("str_len_exact", "customer", "c_mktsegment", lambda c: c.is_exact_length(9), "IsExactLength", "strlen(c_mktsegment) <> 9"),
        text_case("str_is_in", "orders", "o_orderstatus", lambda c: c.is_in(["F", "O"]), "IsIn", "o_orderstatus NOT IN ('F', 'O')"),
        text_case("str_is_in_none", "customer", "c_mktsegment", lambda c: c.is_in([]), "IsIn", "c_mktsegment IS NOT NULL"),
        text_case("str_regex", "customer", "c_name", lambda c: c.with_regex("[0-4]$"), "WithRegex", "NOT regexp_matches(c_name, '[0-4]$')"),
        text_case("str_regex_flag", "part", "p_brand", lambda c: c.with_regex("^BRAND#[12]", "i"), "WithRegex", "NOT regexp_matches(p_brand, '^BRAND#[12]', 'i')"),
        text_case("str_alpha", "lineitem", "l_returnflag", lambda c: c.is_alpha(), "IsAlpha", "NOT regexp_matches(l_returnflag, '^[a-zA-Z]+$')"),
        text_case("str_alphanumeric", "part", "p_type", lambda c: c.is_alphanumeric(), "IsAlphaNumeric", "NOT regexp_matches(p_type, '^[a-zA-Z0-9]+$')"),
        text_case("str_lowercase", "events", "event_type", lambda c: c.is_lowercase(), "IsLowerCase", "NOT regexp_matches(event_type, '^[a-z0-9\\s-]+$')"),
        text_case("str_uppercase", "orders", "o_orderpriority", lambda c: c.is_uppercase(), "IsUpperCase", "NOT regexp_matches(o_orderpriority, '^[A-Z0-9\\s-]+$')"),
        text_case("str_url", "pages", "url", lambda c: c.is_url(), "IsUrl", "NOT regexp_matches(url, '^https?://[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')"),
        _prefix_case("str_numeric", lambda c: c.is_numeric(), "IsNumeric", "^[0-9]+$", "substring(o_orderpriority, 1, cast(1 + o_orderkey % 2 AS int))", "substring(o_orderpriority, 1, 1 + (o_orderkey % 2)::INTEGER)", "orders"),
        _prefix_case("str_email", lambda c: c.is_email(), "IsEmail", "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$", "concat(source, '@', CASE WHEN doc_id % 3 = 0 THEN lang ELSE concat(source, '.', lang) END)", "source || '@' || CASE WHEN doc_id % 3 = 0 THEN lang ELSE source || '.' || lang END"),
        _prefix_case("str_uuid", lambda c: c.is_uuid(), "IsUuid", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "concat(lpad(cast(doc_id AS string), 8, '0'), '-abcd-12EF-0000-', CASE WHEN doc_id % 5 = 0 THEN 'g' ELSE 'a' END, '00000000000')", "lpad(doc_id::VARCHAR, 8, '0') || '-abcd-12EF-0000-' || CASE WHEN doc_id % 5 = 0 THEN 'g' ELSE 'a' END || '00000000000'"),
        date_case("date_before", lambda c: c.is_before(1996, 6, 15), "IsBefore", "d >= DATE '1996-06-15'"),
        date_case("date_after", lambda c: c.is_after(1994), "IsAfter", "d <= DATE '1994-01-01'"),
        date_case("date_weekday", lambda c: c.is_weekday(), "IsWeekday", "isodow(d) >= 6"),
        date_case("date_weekend", lambda c: c.is_weekend(), "IsWeekend", "isodow(d) < 6"),
        date_case("date_not_futur", lambda c: c.is_not_futur(), "IsNotFutur", "d >= current_date"),
        date_case("date_not_past", lambda c: c.is_not_past(), "IsNotPast", "d <= current_date"),
    ]
) | _date_relations()

CASES |= {
    "gen_not_null": Case("lineitem", lambda: [string_column("x").is_not_null(30)], [Count("x", "NullCheck", when("x IS NULL"), 30.0)], select={"x": "nullif(l_returnflag, 'R')"}, source="SELECT nullif(l_returnflag, 'R') AS x FROM lineitem"),
    "gen_unique": Case(
        "orders", lambda: [integer_column("o_orderkey").is_unique(), float_column("o_totalprice").is_unique(0.5), integer_column("o_custkey").is_unique()],
        [Count("o_orderkey", "Unicity", "count(o_orderkey) - count(DISTINCT o_orderkey)"), Count("o_totalprice", "Unicity", "count(o_totalprice) - count(DISTINCT o_totalprice)", 0.5), Count("o_custkey", "Unicity", "count(o_custkey) - count(DISTINCT o_custkey)")],
    ),
    "gen_unique_text": Case("documents", lambda: [string_column("text").is_unique()], [Count("text", "Unicity", "count(text) - count(DISTINCT text)")]),
    "gen_type_check_int": Case(
        "events", lambda: [integer_column("x").with_type_threshold(60).min(30)],
        [Count("x", "TypeCheck", when("x IS NOT NULL AND NOT regexp_matches(x, '^[+-]?[0-9]+$')"), 60.0), Count("x", "Min", when("regexp_matches(x, '^[+-]?[0-9]+$') AND try_cast(x AS BIGINT) < 30"))],
        select={"x": "CASE WHEN event_id % 4 = 0 THEN concat(' ', user_id) WHEN event_id % 4 = 1 THEN concat(user_id, '.5') WHEN event_id % 4 = 2 THEN NULL ELSE concat('+', user_id) END"},
        source="SELECT CASE WHEN event_id % 4 = 0 THEN ' ' || user_id WHEN event_id % 4 = 1 THEN user_id || '.5' WHEN event_id % 4 = 2 THEN NULL ELSE '+' || user_id END AS x FROM events", text=True,
    ),
    "gen_type_check_float": Case(
        "events", lambda: [float_column("x").with_type_threshold(50)],
        [Count("x", "TypeCheck", when("x IS NOT NULL AND NOT regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"), 50.0)],
        select={"x": "CASE WHEN event_id % 3 = 0 THEN concat(user_id, '.5d') WHEN event_id % 3 = 1 THEN concat(user_id, 'e2') ELSE concat('-.', user_id) END"},
        source="SELECT CASE WHEN event_id % 3 = 0 THEN user_id || '.5d' WHEN event_id % 3 = 1 THEN user_id || 'e2' ELSE '-.' || user_id END AS x FROM events", text=True,
    ),
    "gen_type_check_date": Case(
        "orders", lambda: [date_column("x", "%Y-%m-%d").with_type_threshold(50).is_weekday()],
        [Count("x", "TypeCheck", when("x IS NOT NULL AND try_strptime(x, '%Y-%m-%d') IS NULL"), 50.0), Count("x", "IsWeekday", when("isodow(try_strptime(x, '%Y-%m-%d')) >= 6"))],
        select={"x": "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"},
        source="SELECT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS x FROM orders", text=True,
    ),
    "cast_failure": Case(
        "orders", lambda: [integer_column("x").min(3).is_unique().is_not_null()],
        [Count("x", "TypeCheck", "count(x)", message=CAST_FAILURE), Count("x", "NullCheck", when("x IS NULL"))],
        select={"x": "nullif(o_orderpriority, '5-LOW')"}, source="SELECT nullif(o_orderpriority, '5-LOW') AS x FROM orders", text=True,
    ),
    "downcast_failure": Case("part", lambda: [integer_column("p_size").min(3).is_not_null()], [Count("p_size", "DowncastFailure", "count(*)", message=CAST_FAILURE), Count("p_size", "NullCheck", when("p_size IS NULL"))], compat=True),
    "num_increasing": Case(
        "events", lambda: [float_column("value").is_monotonically_increasing(60)], [Count("value", "IsIncreasing", when("value < before"), 60.0)],
        order_by=["event_id"], source="SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events",
    ),
    "num_decreasing": Case(
        "orders", lambda: [float_column("o_totalprice").is_monotonically_decreasing(), integer_column("o_custkey").is_monotonically_increasing()],
        [Count("o_totalprice", "IsDecreasing", when("o_totalprice > before")), Count("o_custkey", "IsIncreasing", when("o_custkey < came"))],
        order_by=["o_orderkey"], source="SELECT o_totalprice, o_custkey, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before, lag(o_custkey) OVER (ORDER BY o_orderkey) AS came FROM orders",
    ),
    "num_increasing_nulls": Case(
        "events", lambda: [float_column("x").is_monotonically_increasing()], [Count("x", "IsIncreasing", when("x < before"))],
        select={"x": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END", "event_id": "event_id"}, order_by=["event_id"],
        source="SELECT x, lag(x) OVER (ORDER BY event_id) AS before FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x FROM events)",
    ),
    "num_std_dev": Case(
        "lineitem", lambda: [float_column("l_quantity").std_dev_check(1.5)], [Count("l_quantity", "StdDevCheck", when("abs(l_quantity - mu) / sd >= 1.5"))],
        source="SELECT l_quantity, (SELECT avg(l_quantity) FROM lineitem) AS mu, (SELECT stddev_samp(l_quantity) FROM lineitem) AS sd FROM lineitem",
    ),
    "num_mean_variance": Case(
        "lineitem", lambda: [float_column("l_quantity").mean_variance(50, 60)], [Count("l_quantity", "MeanVariance", when("abs(mu - l_quantity) > mu * 50 / 100"), 60.0)],
        source="SELECT l_quantity, (SELECT avg(l_quantity) FROM lineitem) AS mu FROM lineitem",
    ),
    "thresholds": Case(
        "lineitem", lambda: [float_column("l_quantity").between(5, 45, 100).min(25, 40).max(45, 0), string_column("l_returnflag").is_in(["A", "N"], 33.4).is_not_null()],
        [Count("l_quantity", "Between", when("l_quantity < 5 OR l_quantity > 45"), 100.0), Count("l_quantity", "Min", when("l_quantity < 25"), 40.0), Count("l_quantity", "Max", when("l_quantity > 45")), Count("l_returnflag", "IsIn", when("l_returnflag NOT IN ('A', 'N')"), 33.4), Count("l_returnflag", "NullCheck", when("l_returnflag IS NULL"))],
    ),
    "whole_table": Case(
        "lineitem",
        lambda: [float_column("l_quantity").between(1, 50).std_dev_check(3).mean_variance(99).is_not_null(), string_column("l_returnflag").is_in(["A", "N", "R"]), integer_column("l_orderkey").is_not_null().is_unique(80), float_column("l_extendedprice").is_positive()],
        [
            Count("l_quantity", "Between", when("l_quantity < 1 OR l_quantity > 50")), Count("l_quantity", "StdDevCheck", when("abs(l_quantity - mu) / sd >= 3")), Count("l_quantity", "MeanVariance", when("abs(mu - l_quantity) > mu * 99 / 100")), Count("l_quantity", "NullCheck", when("l_quantity IS NULL")),
            Count("l_returnflag", "IsIn", when("l_returnflag NOT IN ('A', 'N', 'R')")), Count("l_orderkey", "NullCheck", when("l_orderkey IS NULL")), Count("l_orderkey", "Unicity", "count(l_orderkey) - count(DISTINCT l_orderkey)", 80.0), Count("l_extendedprice", "IsPositive", when(f"l_extendedprice < {EPS}")),
            Count("l_quantity | l_extendedprice", "DateCompare LesserThan", when("NOT coalesce(l_quantity < l_extendedprice, false) AND NOT (l_quantity IS NULL AND l_extendedprice IS NULL)"), 1.0, "relation"),
        ],
        lambda: [relation("l_quantity", "l_extendedprice").numeric_comparaison("<", 1)],
        source="SELECT *, (SELECT avg(l_quantity) FROM lineitem) AS mu, (SELECT stddev_samp(l_quantity) FROM lineitem) AS sd FROM lineitem",
    ),
    "custom_rule": Case("documents", lambda: [string_column("text").custom("TooManyLines", lambda c: F.size(F.split(c, "\n")) > 20)], [Count("text", "TooManyLines", when("len(string_split(text, chr(10))) > 20"))]),
}

CASES |= {
    "csv_scan": Case(
        "customer", lambda: [integer_column("c_custkey").is_positive().is_unique(), string_column("c_name").with_length_between(5, 18), float_column("c_acctbal").between(-500, 9000), string_column("c_mktsegment").is_in(["BUILDING", "MACHINERY"]).is_not_null()],
        [
            Count("c_custkey", "TypeCheck", "0"), Count("c_custkey", "IsPositive", when("c_custkey < 1")), Count("c_custkey", "Unicity", "count(c_custkey) - count(DISTINCT c_custkey)"), Count("c_name", "TypeCheck", "0"),
            Count("c_name", "WithLengthBetween", when("strlen(c_name) < 5 OR strlen(c_name) > 18")), Count("c_acctbal", "TypeCheck", "0"), Count("c_acctbal", "Between", when("c_acctbal < -500 OR c_acctbal > 9000")),
            Count("c_mktsegment", "TypeCheck", "0"), Count("c_mktsegment", "IsIn", when("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")), Count("c_mktsegment", "NullCheck", when("c_mktsegment IS NULL")),
        ],
        select={c: c for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")}, files="csv",
    ),
    "csv_projection": Case("lineitem", lambda: [float_column("l_quantity").max(40)], [Count("l_quantity", "TypeCheck", "0"), Count("l_quantity", "Max", when("l_quantity > 40"))], select={c: c for c in ("l_orderkey", "l_linenumber", "l_quantity")}, files="csv"),
    "csv_type_check": Case(
        "orders", lambda: [integer_column("a").with_type_threshold(60).min(500), float_column("b").with_type_threshold(50), date_column("d", "%d.%m.%Y").is_weekday(40)],
        [
            Count("a", "TypeCheck", when("a IS NOT NULL AND NOT regexp_matches(a, '^[0-9]+$')"), 60.0), Count("a", "Min", when("try_cast(a AS BIGINT) < 500")), Count("b", "TypeCheck", when("b LIKE '%d'"), 50.0),
            Count("d", "TypeCheck", "0"), Count("d", "IsWeekday", when("isodow(d) >= 6"), 40.0),
        ],
        select={"a": "CASE WHEN o_orderkey % 4 = 0 THEN concat(o_custkey, 'x') WHEN o_orderkey % 4 = 1 THEN NULL ELSE cast(o_custkey AS string) END", "b": "concat(o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '.5d' ELSE '.5' END)", "d": "date_format(o_orderdate, 'dd.MM.yyyy')"},
        source="SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_custkey || 'x' WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_custkey::VARCHAR END AS a, o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '.5d' ELSE '.5' END AS b, o_orderdate::DATE AS d FROM orders", files="csv",
    ),
    "csv_increasing": Case(
        "events", lambda: [float_column("value").is_monotonically_increasing(60).is_monotonically_decreasing(60)], [Count("value", "TypeCheck", "0"), Count("value", "IsIncreasing", when("value < before"), 60.0), Count("value", "IsDecreasing", when("value > before"), 60.0)],
        select={"value": "value"}, files="csv", written_by=["event_id"], source="SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events",
    ),
    "parquet_increasing_file_order": Case(
        "orders", lambda: [integer_column("o_custkey").is_monotonically_increasing(), float_column("o_totalprice").is_monotonically_decreasing()],
        [Count("o_custkey", "IsIncreasing", when("o_custkey < came")), Count("o_totalprice", "IsDecreasing", when("o_totalprice > before"))],
        select={"o_custkey": "o_custkey", "o_totalprice": "o_totalprice"}, files="parquet", written_by=["o_orderkey"],
        source="SELECT o_totalprice, o_custkey, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before, lag(o_custkey) OVER (ORDER BY o_orderkey) AS came FROM orders",
    ),
    "gen_type_check_date_yy": Case(
        "orders", lambda: [date_column("x", "%d/%m/%y").is_after(1994, 6, 15)], [Count("x", "TypeCheck", "0"), Count("x", "IsAfter", when("x <= DATE '1994-06-15'"))],
        select={"x": "date_format(o_orderdate, 'dd/MM/yy')"}, source="SELECT o_orderdate::DATE AS x FROM orders", text=True,
    ),
    "gen_type_check_date_weekday": Case(
        "orders", lambda: [date_column("x", "%a, %d %b %Y").with_type_threshold(40).is_weekday()],
        [Count("x", "TypeCheck", when("wrong"), 40.0), Count("x", "IsWeekday", when("NOT wrong AND isodow(x) >= 6"))],
        select={"x": "concat(CASE WHEN o_orderkey % 3 = 0 THEN date_format(date_add(o_orderdate, 1), 'EEE') ELSE date_format(o_orderdate, 'EEE') END, date_format(o_orderdate, ', dd MMM yyyy'))"},
        source="SELECT o_orderdate::DATE AS x, o_orderkey % 3 = 0 AS wrong FROM orders", text=True,
    ),
}


def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the JSON document on lineitem and orders, a row for each."""
    report = JsonReporter()
    for name, column in (("lineitem", "l_quantity"), ("orders", "o_totalprice")):
        table = ParquetTable(f"{sf_dir}/{name}.parquet", name, spark).prepare([float_column(column).between(5, 45, 20).is_not_null()])
        report.tell("result", result=table.validate())
    rows = [(t["name"], t["n_rows"], t["pass"], c["name"], r["name"], r["errors"], r["error_percent"], float(r["threshold"]), r["pass"]) for t in json.loads(report.to_json())["tables"] for c in t["columns"] for r in c["rules"]]
    return spark.createDataFrame(rows, "table_name string, n_rows long, table_pass boolean, target string, rule_name string, errors long, error_percent double, threshold double, pass boolean")


def tables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that passed and that failed, of a run over several."""
    run = Validator()
    for name, column, bound in (("orders", "o_totalprice", 0), ("customer", "c_acctbal", 0), ("part", "p_size", 1)):
        run.add_table(ParquetTable(f"{sf_dir}/{name}.parquet", name, spark).prepare([(integer_column if name == "part" else float_column)(column).min(bound)]))
    results = run.validate_all()
    return spark.createDataFrame([(sum(r.passed for r in results), sum(not r.passed for r in results))], "passed long, failed long")


def _json_sql() -> str:
    parts = []
    for name, column in (("lineitem", "l_quantity"), ("orders", "o_totalprice")):
        counted = f"SELECT count(*) AS n, {when(f'{column} < 5 OR {column} > 45')} AS e0, {when(f'{column} IS NULL')} AS e1 FROM {name}"
        for i, (rule, threshold) in enumerate((("Between", 20), ("NullCheck", 0))):
            parts.append(
                f"SELECT '{name}' AS table_name, n AS n_rows, 100.0::DOUBLE * e0 / n <= 20 AND e1 = 0 AS table_pass, '{column}' AS target, '{rule}' AS rule_name, e{i}::BIGINT AS errors, "
                f"100.0::DOUBLE * e{i} / n AS error_percent, {threshold}::DOUBLE AS threshold, 100.0::DOUBLE * e{i} / n <= {threshold} AS pass FROM ({counted})"
            )
    return " UNION ALL ".join(parts)


SUMMARY_SQL = """
WITH t AS (SELECT min(o_totalprice) >= 0 AS good FROM orders UNION ALL SELECT min(c_acctbal) >= 0 FROM customer UNION ALL SELECT min(p_size) >= 1 FROM part)
SELECT count(*) FILTER (WHERE good) AS passed, count(*) FILTER (WHERE NOT good) AS failed FROM t
"""


def profile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_linenumber"])


def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules passed and rules in all, and whether the table passed: relations don't count."""
    rows = CASES["whole_table"].run(spark, sf_dir)
    own = F.col("kind") == "column"
    return rows.groupBy("table_name").agg(F.count_if(own & F.col("passed")).alias("passed_rules"), F.count_if(own).alias("rules"), (F.count_if(own & ~F.col("passed")) == 0).alias("passed"))


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std_dev, var_samp({c}::DOUBLE) AS variance, var_pop({c}::DOUBLE) AS population_variance, min({c}::DOUBLE) AS min, max({c}::DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_linenumber")
)
STATUS_SQL = f"SELECT table_name, count(*) FILTER (WHERE kind = 'column' AND passed) AS passed_rules, count(*) FILTER (WHERE kind = 'column') AS rules, count(*) FILTER (WHERE kind = 'column' AND NOT passed) = 0 AS passed FROM ({CASES['whole_table'].sql()}) GROUP BY table_name"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: c.run for n, c in CASES.items()} | {"profile_moments": profile_moments, "table_status": table_status, "json_result": json_result, "tables_summary": tables_summary}
SQL: dict[str, str] = {n: c.sql() for n, c in CASES.items()} | {"profile_moments": PROFILE_SQL, "table_status": STATUS_SQL, "json_result": _json_sql(), "tables_summary": SUMMARY_SQL}
