"""Configuration, command line, reports, watching and arriving files."""

import io
import json
import os

import pytest

from assayer import ConsoleReporter, cli
from assayer.config import load_tables
from assayer.errors import ConfigError
from assayer.report import short_number, target_path
from assayer.watch import watch

DOCUMENT = """
[[table]]
name = "products"
path = "{path}"
rule_threshold = 10.0
type_checking_threshold = 20.0

[[table.column]]
name = "id"
datatype = "integer"
rule_threshold = 30.0
  [[table.column.rule]]
  name = "is_unique"
  threshold = 40.0
  [[table.column.rule]]
  name = "between"
  min = 1
  max = 3

[[table.column]]
name = "name"
datatype = "string"
type_checking_threshold = 5.0
  [[table.column.rule]]
  name = "with_regex"
  pattern = "^A"
  flag = "i"

[[table.column]]
name = "start"
datatype = "date"
format = "%Y-%m-%d"
rule = []

[[table.column]]
name = "end"
datatype = "date"
format = "%Y-%m-%d"
  [[table.column.rule]]
  name = "is_after"
  year = 2020

[[table.relations]]
column_one = "start"
column_two = "end"
  [[table.relations.rule]]
  name = "date_comparaison"
  operator = "<="
"""


@pytest.fixture
def files(tmp_path):
    data = tmp_path / "p.data.csv"
    data.write_text("id,name,start,end\n1,Ab,2024-01-01,2024-02-01\n2,ac,2024-01-01,2023-02-01\n4,a,2024-01-01,2024-02-01\n")
    config = tmp_path / "c.toml"
    config.write_text(DOCUMENT.format(path=data))
    return config, data


def test_thresholds_are_inherited(spark, files):
    result = load_tables(str(files[0]), spark)[0].validate()
    got = {(c, r.rule_name): (r.error_count, r.threshold) for c, rs in result.columns.items() for r in rs}
    assert got == {
        ("id", "TypeCheck"): (0, 20.0), ("id", "Unicity"): (0, 40.0), ("id", "Between"): (1, 30.0), ("name", "TypeCheck"): (0, 5.0),
        ("name", "WithRegex"): (0, 10.0), ("start", "TypeCheck"): (0, 20.0), ("end", "TypeCheck"): (0, 20.0), ("end", "IsAfter"): (0, 10.0),
    }
    assert [(r.error_count, r.threshold) for r in result.relations["start | end"]] == [(1, 10.0)]


@pytest.mark.parametrize(
    "old, new",
    [("min = 1", "min = 5"), ("min = 1", "min = 3"), ("min = 1", "min = 1.0"), ('name = "between"', 'name = "no_rule"'), ('datatype = "string"', 'datatype = "blob"'), ("^A", "(?=A)"), ("year = 2020", "year = 2020\nmonth = 13"),
     ('column_two = "end"', 'column_two = "other"'), ('operator = "<="', 'operator = "eq"'), ('name = "is_unique"', 'name = "with_regex"\npattern = "x"'), ('format = "%Y-%m-%d"', ""), ('name = "products"', ""), ("p.data.csv", "gone.csv"), ("[[table]]", "[[table]")],
)
def test_bad_documents(files, old, new):
    config, _ = files
    config.write_text(config.read_text().replace(old, new, 1))
    with pytest.raises(ConfigError):
        load_tables(str(config))


def test_command_line(spark, files, tmp_path, capsys):
    config, data = files
    assert cli.main(["-c", str(config)], spark) == 1
    said = capsys.readouterr().out
    assert "== products: not ok, " in said and " of 8 rules hold on 3 rows" in said and "- Between: 1 errors, 33.33 % (allowed 30 %)" in said and "Tables: 0 ok, 1 not ok" in said
    assert cli.main(["-c", str(config), "-o", "json", "-p", str(tmp_path / "out" / "r.json")], spark) == 1
    document = json.loads((tmp_path / "out" / "r.json").read_text())
    table = document["tables"][0]
    assert (table["name"], table["n_rows"], table["pass"]) == ("products", 3, False) and table["relations"][0]["rules"][0]["errors"] == 1
    data.write_text("id,name,start,end\n1,Ab,2024-01-01,2024-02-01\n")
    assert cli.main(["-c", str(config), "-b", "-o", "json", "-p", f"{tmp_path}/new/"], spark) == 0
    brief = json.loads(next((tmp_path / "new").iterdir()).read_text())["tables"][0]
    assert brief == {"name": "products", "n_rows": 1, "pass": True}
    assert cli.main(["-c", str(tmp_path / "none.toml")], spark) == 2
    assert cli.main(["-c", str(config), "-w", "-o", "json"], spark) == 2


def test_reports(tmp_path):
    assert [short_number(n) for n in (999, 1000, 1001, 2_500_000, 10**9, 3 * 10**9)] == ["999", "1000", "1.0K", "2.5M", "1000.0M", "3.0B"]
    assert target_path(str(tmp_path), "v.json") == tmp_path / "v.json"
    assert target_path(str(tmp_path / "a" / "b.json"), "v.json") == tmp_path / "a" / "b.json" and (tmp_path / "a").is_dir()
    out = io.StringIO()
    reporter = ConsoleReporter(out=out)
    reporter.tell("end", passed=2, failed=1)
    reporter.tell("a step that it doesn't know")
    assert out.getvalue() == "Tables: 2 ok, 1 not ok\n"


def test_watch(tmp_path):
    path, runs, looks = tmp_path / "f.csv", [], []
    path.write_text("a")

    def stop():
        looks.append(1)
        if len(looks) == 3:
            path.write_text("abc")
            os.utime(path, (1, 1))
        return len(looks) > 8

    watch(str(path), lambda: runs.append(path.read_text()), every=0.01, stop=stop)
    assert runs == ["a", "abc"]


def test_arriving_files(spark, tmp_path):
    from assayer import integer_column, string_column
    from assayer.spec import TableSpec
    from assayer.streaming.directory import ArrivingFiles

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("id,s\n1,a\nx,\n")
    table = TableSpec("arriving", (integer_column("id").min(2).is_unique().build(), string_column("s").is_not_null().build()))
    files = ArrivingFiles(table, str(folder), str(tmp_path / "state"), text=True)
    files.start(spark).awaitTermination()
    (folder / "2.csv").write_text("id,s\n1,b\n5,c\n")
    files.start(spark).awaitTermination()
    result = files.result(spark)
    assert result.total_rows == 4
    assert {(c, r.rule_name): r.error_count for c, rs in result.columns.items() for r in rs} == {("id", "TypeCheck"): 1, ("id", "Min"): 2, ("id", "Unicity"): 1, ("s", "TypeCheck"): 0, ("s", "NullCheck"): 1}
