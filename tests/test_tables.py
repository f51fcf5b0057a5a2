"""Sources, casts, relations, thresholds and results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer import CsvTable, FrameTable, ParquetTable, Validator, date_column, float_column, integer_column, relation, string_column
from assayer.errors import ColumnNotFound, PatternError, RuleTypeError, SourceError, TableNotFound, UnknownFormat
from assayer.functions.dates import date_pattern, parse_date
from assayer.operators.moments import profile
from assayer.operators.order import count_breaks, ordered_by
from assayer.sources.formats import format_of


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def counts(result):
    return {(c, r.rule_name): r.error_count for c, rs in result.columns.items() for r in rs}


def test_csv_types_and_rules(spark, tmp_path):
    path = write(tmp_path, "name, age,price,day\nab,25,1.5,2024-01-06\nabc, 25,1.5d,2024-2-3\nabcd,-1,nan,06/01/2024\n,,,\nabcde,25.7,-.5e1,2024-01-09\n")
    table = CsvTable(path, "t", spark).prepare([
        string_column("name").with_min_length(3).is_not_null(), integer_column("age").between(0, 120).with_type_threshold(50),
        float_column("price").min(0), date_column("day", "%Y-%m-%d").is_weekday(), integer_column("missing").is_unique(),
    ])
    result = table.validate()
    assert result.total_rows == 5 and result.warnings
    assert counts(result) == {
        ("name", "TypeCheck"): 0, ("name", "WithMinLength"): 1, ("name", "NullCheck"): 1, ("age", "TypeCheck"): 2, ("age", "Between"): 1,
        ("price", "TypeCheck"): 1, ("price", "Min"): 1, ("day", "TypeCheck"): 1, ("day", "IsWeekday"): 2,
    }
    assert result.columns["age"][0].passed and not result.passed
    assert table.get_rules() == {"name": ["TypeCheck", "WithMinLength"], "age": ["TypeCheck", "Between"], "price": ["TypeCheck", "Min"], "day": ["TypeCheck", "IsWeekday"], "missing": ["TypeCheck"]}
    assert result.as_dict() == {"table_name": "t", "total_rows": 5, "passed": result.is_passed()}


def test_csv_order_quotes_and_edges(spark, tmp_path):
    path = write(tmp_path, "price,note\n1.0,\"a,b\"\n2.0,\"\"\n1.5,x\n3.0,y\n")
    result = CsvTable(path, "t", spark).prepare([float_column("price").is_monotonically_increasing(), string_column("note").is_not_null()]).validate()
    assert counts(result)[("price", "IsIncreasing")] == 1 and counts(result)[("note", "NullCheck")] == 1
    empty = CsvTable(write(tmp_path, "price,note\n", "e.csv"), "t", spark).prepare([float_column("price").is_unique().std_dev_check(1).is_monotonically_increasing()]).validate()
    assert empty.total_rows == 0 and empty.passed
    with pytest.raises(SourceError):
        CsvTable(write(tmp_path, "", "z.csv"), "t", spark).prepare([float_column("price")]).validate()
    with pytest.raises(Exception):
        CsvTable(write(tmp_path, "a,b\n1,2\n3\n", "r.csv"), "t", spark).prepare([integer_column("a").min(0)]).validate()
    with pytest.raises(PatternError):
        CsvTable(path, "t", spark).prepare([date_column("d")])


def test_cast_failure_skips_the_rest(spark, tmp_path):
    path = write(tmp_path, "a,b,c\nx,1,\ny,2,\nx,3,\n")
    table = CsvTable(path, "t", spark).prepare([integer_column("a").min(1).is_unique().is_not_null(), integer_column("b").min(2), integer_column("c").min(1).is_unique()], [relation("a", "b").numeric_comparaison("<")])
    result = table.validate()
    assert counts(result) == {("a", "TypeCheck"): 3, ("a", "NullCheck"): 0, ("b", "TypeCheck"): 0, ("b", "Min"): 1, ("c", "TypeCheck"): 0, ("c", "Min"): 0, ("c", "Unicity"): 0}
    assert result.columns["a"][0].error_message and not result.columns["b"][0].error_message and not result.relations


def test_parquet_types_and_file_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, i % 7, float(i), "s") for i in range(1000)], "id long, small int, f float, s string").coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    columns = lambda: [integer_column("small").max(5).is_monotonically_increasing(), float_column("f").mean_variance(1000), integer_column("s").min(1).is_not_null(), integer_column("id").is_unique()]
    result = ParquetTable(path, "t", spark).prepare(columns()).validate()
    assert counts(result) == {("small", "Max"): 142, ("small", "IsIncreasing"): 142, ("f", "MeanVariance"): 0, ("s", "DowncastFailure"): 1000, ("s", "NullCheck"): 0, ("id", "Unicity"): 0}
    strict = ParquetTable(path, "t", spark, compat=True).prepare(columns()).validate()
    assert counts(strict)[("small", "DowncastFailure")] == 1000 and ("f", "DowncastFailure") in counts(strict)


def test_relations(spark):
    d = dt.date
    dates = spark.createDataFrame([(d(2024, 1, 1), d(2024, 12, 31)), (d(2024, 6, 1), d(2024, 3, 1)), (None, None), (None, d(2024, 1, 1))], "a date, b date")
    result = FrameTable(dates, "t").prepare([date_column("a"), date_column("b")], [relation("a", "b").date_comparaison("<=")]).validate()
    assert [(r.rule_name, r.error_count) for r in result.relations["a | b"]] == [("DateCompare LesserThanEqual", 2)]
    assert result.passed and result.relations_passed() == (0, 1)
    nan = float("nan")
    floats = spark.createDataFrame([(98.6, 98.0), (100.5, 101.0), (nan, 1.0), (nan, nan), (nan, None), (2.0, 1.0)], "a double, b double")
    columns = [float_column("a"), float_column("b")]
    for op, want in ((">", 4), ("=", 6), ("lesser than", 5)):
        result = FrameTable(floats, "t").prepare(columns, [relation("a", "b").numeric_comparaison(op)]).validate()
        assert result.relations["a | b"][0].error_count == want
    with pytest.raises(RuleTypeError):
        FrameTable(floats, "t").prepare([float_column("a"), integer_column("b")], [relation("a", "b").numeric_comparaison("<")])
    with pytest.raises(ColumnNotFound):
        FrameTable(floats, "t").prepare(columns, [relation("a", "z").numeric_comparaison("<")])
    with pytest.raises(ValueError):
        relation("a", "b").numeric_comparaison("eq")


def test_thresholds_names_and_frames(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "x long")
    table = FrameTable(df, "t").prepare([integer_column("x").max(149, 25).max(148, 25).is_not_null(1).is_not_null(2)])
    result = table.validate()
    assert [(r.rule_name, r.error_count, r.error_percentage, r.passed, r.threshold) for r in result.columns["x"]] == [("Max", 50, 25.0, True, 25.0), ("Max#2", 51, 25.5, False, 25.0), ("NullCheck", 0, 0.0, True, 2.0)]
    rows = table.results().collect()
    assert [r.rule_name for r in rows] == ["Max", "Max#2", "NullCheck"] and table.results().schema["error_count"].dataType.simpleString() == "bigint"
    merged = FrameTable(df, "t", compat=True).prepare([integer_column("x").max(149, 25).max(148, 30)]).validate()
    assert [(r.rule_name, r.error_count, r.threshold) for r in merged.columns["x"]] == [("Max", 101, 25.0)]
    both = Validator().add_table(table).add_table(FrameTable(df, "u").prepare([integer_column("x").min(0)]))
    assert [r.table_name for r in both.validate_all()] == ["t", "u"] and both.validate_table("u").passed
    with pytest.raises(TableNotFound):
        both.validate_table("v")


def test_profile(spark):
    df = spark.createDataFrame([(float(i), 3) for i in range(1, 6)], "x double, y int")
    x, y = sorted(profile(df, ["x", "y"]).collect(), key=lambda r: r.column)
    assert (x.n, x.mean, x.variance, x.population_variance, x.min, x.max) == (5, 3.0, 2.5, 2.0, 1.0, 5.0) and y.variance == 0.0
    one = profile(df.limit(1), ["x"]).first()
    assert (one.variance, one.population_variance) == (0.0, 0.0)


def test_formats():
    assert [format_of(p) for p in ("./a.csv", "a.b.csv", "/x.y/z.PARQUET", "s3a://b/t.parquet/")] == ["csv", "csv", "parquet", "parquet"]
    with pytest.raises(UnknownFormat):
        format_of("a.txt")
    assert date_pattern("%d.%m.%Y at %H:%M") == "d.M.yyyy' at 'H:m"
    with pytest.raises(PatternError):
        date_pattern("%Q")


def test_pieces_of_files(spark, tmp_path):
    from assayer.sources.sizing import MB, SETTING, SplitSize

    assert date_column("b", "%Y").get_format() == "%Y"
    assert [SplitSize().bytes_for(n * MB, 8) for n in (1, 400, 10_000)] == [MB, 10 * MB, 100 * MB]
    with pytest.raises(ValueError):
        SplitSize(least=2, most=1)
    path = tmp_path / "a.csv"
    path.write_text("x\n" + "".join(f"{i}\n" for i in range(20_000)))
    before = spark.conf.get(SETTING)
    table = CsvTable(str(path), "t", spark, split=SplitSize(least=1000, per_core=9)).prepare([integer_column("x").is_monotonically_increasing().max(19_998)])
    result = table.validate()
    assert [(r.rule_name, r.error_count) for r in result.columns["x"]] == [("TypeCheck", 0), ("IsIncreasing", 0), ("Max", 1)]
    assert spark.conf.get(SETTING) == before


def test_dates(spark):
    rows = [("31/12/99", "%d/%m/%y", "1999-12-31"), ("31/12/69", "%d/%m/%y", "2069-12-31"), ("29/02/72", "%d/%m/%y", "1972-02-29"), ("Fri, 01 Mar 2024", "%a, %d %b %Y", "2024-03-01"), ("FRI, 01 Mar 2024", "%a, %d %b %Y", "2024-03-01"),
            ("Mon, 01 Mar 2024", "%a, %d %b %Y", None), ("Friday 1 March 2024", "%A %d %B %Y", "2024-03-01"), ("Fri 1 March 2024", "%A %d %B %Y", "2024-03-01"), ("Friday, 01 Mar 2024", "%a, %d %b %Y", None), ("x", "%a %d/%m/%y", None), (None, "%A %F", None)]
    for text, form, want in rows:
        got = spark.createDataFrame([(text,)], "x string").select(parse_date(F.col("x"), form).cast("string")).first()[0]
        assert got == want, (text, form)


def test_a_quoted_name_with_a_comma(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a, b",c\n1,2\n')
    result = CsvTable(str(tmp_path / "q.csv"), "q", spark).prepare([integer_column("a, b").min(1)]).validate()
    assert [r.error_count for r in result.columns["a, b"]] == [0, 0]


def test_unique_text_of_any_length(spark):
    long = "x" * 100
    df = spark.createDataFrame([(v,) for v in (long, long, long + "y", "a", "a", "", "", None, "é" * 16, "é" * 16)], "s string")
    assert FrameTable(df, "t").prepare([string_column("s").is_unique()]).validate().columns["s"][0].error_count == 4


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_order_over_many_stretches(spark, pieces):
    values = [1.0, 2.0, None, 1.0, float("nan"), 5.0, float("inf"), float("nan"), float("nan"), None, None, 3.0, 3.0, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    up = lambda a, b: a is not None and b is not None and ((b < a) or (a != a and b == b))
    down = lambda a, b: a is not None and b is not None and ((b > a) or (b != b and a == a))
    plan, block = ordered_by(df, ["i"], [F.col("v")], pieces)
    row = count_breaks(plan, [("is_increasing", F.col("value_0")), ("is_decreasing", F.col("value_0"))], block).first()
    pairs = [*zip(values, values[1:])]
    assert (row.errors_0, row.errors_1) == (sum(up(*p) for p in pairs), sum(down(*p) for p in pairs))
