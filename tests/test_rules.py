"""Exact violation counts of every rule on small columns."""

import datetime as dt

import pytest

from assayer import FrameTable, date_column, float_column, integer_column, string_column
from assayer.errors import IncorrectDate, PatternError, RuleTypeError

KIND = {string_column: "string", integer_column: "bigint", float_column: "double", date_column: "date"}


def errors(spark, make, add, values, order_by=None, **options):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i long, x {KIND[make]}")
    result = FrameTable(df, "t", order_by, **options).prepare([add(make("x"))]).validate()
    assert result.total_rows == len(values)
    return [r.error_count for r in result.columns["x"]]


D = dt.date
STRINGS = [
    (lambda c: c.with_length_between(3, 5), ["a", "abc", "abcde", "abcdef", ""], 3),
    (lambda c: c.with_length_between(5, 3), ["abcd"], 2),
    (lambda c: c.with_min_length(3), ["a", "ab", "abc", "abcd"], 2),
    (lambda c: c.with_max_length(3), ["a", "ab", "abc", "abcd", "abcde"], 2),
    (lambda c: c.with_max_length(3), ["éé", "aé", None], 1),  # bytes
    (lambda c: c.is_exact_length(5), ["hello", "world", "hi", "toolong"], 2),
    (lambda c: c.with_regex(r"^\d{3}$"), ["123", "abc", "12", "1234", None, "456", "123\n", "١٢٣"], 4),
    (lambda c: c.with_regex("abc", "i"), ["ABC", "def", "aBc"], 1),
    (lambda c: c.is_email(), ["test@example.com", "invalid-email", "another@test.co.uk", "@invalid.com", None], 2),
    (lambda c: c.is_url(), ["https://example.com", "http://test.org", "ftp://invalid.com", "not-a-url", "https://valid.co.uk", "http://127.0.0.1:8080/x"], 3),
    (lambda c: c.is_in(["apple", "banana"]), ["apple", "banana", "orange", None, ""], 2),
    (lambda c: c.is_in(["apple"]), ["apple", "Apple"], 1),
    (lambda c: c.is_in([]), ["apple", "banana", None], 2),
    (lambda c: c.is_uuid(), ["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000", "123e4567", "g23e4567-e89b-12d3-a456-426614174000"], 2),
    (lambda c: c.is_lowercase(), ["abc", "xyz", "aBc", "ab c", "ab-c", "123", None], 1),
    (lambda c: c.is_uppercase(), ["ABC", "Abc", "A-1", None], 1),
    (lambda c: c.is_numeric(), ["12", "1a", "", None], 2),
    (lambda c: c.is_alpha(), ["ab", "a1", "é", None], 2),
    (lambda c: c.is_alphanumeric(), ["ab1", "a-1", None], 1),
    (lambda c: c.is_not_null(), ["a", None, None, "b"], 2),
    (lambda c: c.is_unique(), ["apple", None, "banana", None, "apple"], 1),
    (lambda c: c.custom("Shout", lambda x: x.endswith("!")), ["a!", "b", None], 1),
]


@pytest.mark.parametrize("add, values, want", STRINGS)
def test_strings(spark, add, values, want):
    assert errors(spark, string_column, add, values) == [want]


NUMBERS = [
    (lambda c: c.min(5), [1, 6, 3, 2, None], 3),
    (lambda c: c.max(5), [7, 6, 5, 2, 4], 2),
    (lambda c: c.between(2, 4), [1, 4, 6, 3, 2, None], 2),
    (lambda c: c.is_positive(), [1, 0, 5, -2, None], 2),
    (lambda c: c.is_negative(), [-1, 0, -5, 2, None], 2),
    (lambda c: c.is_non_positive(), [-1, 0, 5, -2, None], 1),
    (lambda c: c.is_non_negative(), [1, 0, 5, -2, None], 1),
]


@pytest.mark.parametrize("make", [integer_column, float_column])
@pytest.mark.parametrize("add, values, want", NUMBERS)
def test_numbers(spark, make, add, values, want):
    values = [float(v) if v is not None and make is float_column else v for v in values]
    assert errors(spark, make, add, values) == [want]


NAN = float("nan")


def test_floats(spark):
    assert errors(spark, float_column, lambda c: c.between(1.5, 10.5), [1.5, 5.0, None, 10.5, 11.0, 1.0, NAN]) == [2]
    assert errors(spark, float_column, lambda c: c.is_negative().is_non_positive().max(3), [NAN, None]) == [0, 0, 0]
    assert errors(spark, float_column, lambda c: c.is_positive(), [1e-17, 1e-15]) == [1]
    assert errors(spark, integer_column, lambda c: c.min(2**53 + 1), [2**53, 2**53 + 1]) == [1]


ORDERS = [
    ("up", [1, 5, 5, 10], 0), ("up", [1, 5, 4, 3, 10], 2), ("down", [10, 3, 4, 5, 1], 2),
    ("up", [1, None, 2, None, 3], 0), ("up", [5, None, 3], 0), ("down", [1], 0), ("up", [], 0),
]


@pytest.mark.parametrize("way, values, want", ORDERS)
def test_monotone(spark, way, values, want):
    add = (lambda c: c.is_monotonically_increasing()) if way == "up" else (lambda c: c.is_monotonically_decreasing())
    assert errors(spark, integer_column, add, values, ["i"]) == [want]


def test_monotone_over_many_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 5000, 1, 7).select("id", ((F.col("id") * 7919) % 1013).alias("x"))
    want = sum((i * 7919) % 1013 < ((i - 1) * 7919) % 1013 for i in range(1, 5000))
    result = FrameTable(df, "t", ["id"]).prepare([integer_column("x").is_monotonically_increasing()]).validate()
    assert result.columns["x"][0].error_count == want
    with pytest.raises(RuleTypeError):
        FrameTable(df, "t").prepare([integer_column("x").is_monotonically_increasing()]).validate()


def test_statistics(spark):
    assert errors(spark, float_column, lambda c: c.std_dev_check(1.2), [1.0, 2.0, 3.0, 4.0, 5.0, None]) == [2]
    assert errors(spark, float_column, lambda c: c.std_dev_check(1), [3.0, 3.0, 3.0]) == [0]
    assert errors(spark, integer_column, lambda c: c.std_dev_check(1), [3]) == [0]
    assert errors(spark, integer_column, lambda c: c.mean_variance(20), [80, 100, 120, 79, 121, None]) == [2]
    assert errors(spark, integer_column, lambda c: c.mean_variance(20), [-1, -1]) == [2]
    # Nulls as zeros, as the compatible mode counts them.
    assert errors(spark, float_column, lambda c: c.mean_variance(60), [10.0, 10.0, None, None]) == [0]
    assert errors(spark, float_column, lambda c: c.mean_variance(60), [10.0, 10.0, None, None], compat=True) == [2]


DATES = [
    (lambda c: c.is_after(2020), [D(2020, 1, 1)], 1),
    (lambda c: c.is_after(2020), [D(2019, 12, 31), None, D(2020, 1, 2), None, D(2019, 6, 15)], 2),
    (lambda c: c.is_before(2020, 12, 31), [D(2021, 1, 1), None, D(2020, 6, 15), None, D(2021, 6, 15)], 2),
    (lambda c: c.is_after(1970), [D(1969, 12, 31), D(1970, 1, 1), D(1970, 1, 2)], 2),
    (lambda c: c.is_weekday(), [D(2025, 1, d) for d in (6, 11, 8, 12, 10)], 2),
    (lambda c: c.is_weekend(), [D(2025, 1, d) for d in (4, 6, 5, 8, 11)], 2),
    (lambda c: c.is_not_futur(), [dt.date.today(), dt.date.today() - dt.timedelta(1), None], 1),
    (lambda c: c.is_not_past(), [dt.date.today(), dt.date.today() + dt.timedelta(1), None], 1),
]


@pytest.mark.parametrize("add, values, want", DATES)
def test_dates(spark, add, values, want):
    assert errors(spark, date_column, add, values) == [want]


@pytest.mark.parametrize("args", [(2021, 2, 29), (2020, 13, 1), (2020, 0, 1), (2020, 1, 0)])
def test_impossible_dates(args):
    with pytest.raises(IncorrectDate):
        date_column("d").is_before(*args)


@pytest.mark.parametrize("pattern", ["(?=a)", r"(a)\1", "a++", "[a", "(", "(?<!x)y", "(?>a)"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(PatternError):
        string_column("x").with_regex(pattern)


def test_rules_need_their_type(spark):
    from assayer import spec
    from assayer.plans.compiler import check

    wrong = spec.TableSpec("t", (spec.ColumnSpec("x", "string", (spec.RuleSpec("min", args=(("min", 1),)),)),))
    with pytest.raises(RuleTypeError):
        check(wrong)
    with pytest.raises(RuleTypeError):
        integer_column("x").min(1.5)
