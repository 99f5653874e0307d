import datetime as dt

import pytest
from pyspark.sql import types as T

from careerspark.plans import inputs
from careerspark.sources import delimited, stages

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("born", T.DateType()), T.StructField("season", T.DateType()),
                       T.StructField("x", T.DoubleType()), T.StructField("flag", T.BooleanType())])
FORMATS = {"born": "M/d/yyyy", "season": delimited.YEAR_ONLY}


def text(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,born,season,x,flag\na,07/04/1985,1990,1.5,TRUE\nb,05/00/1971,1991,,FALSE\nc,7/4/1985,year,abc,TRUE\n")
    return str(path)


def test_typed_reading(spark, tmp_path):
    rows = {r.id: r for r in delimited.read_csv(spark, text(tmp_path), SCHEMA, FORMATS).collect()}
    assert rows["a"][1:] == (dt.date(1985, 7, 4), dt.date(1990, 1, 1), 1.5, True)
    assert rows["b"][1:] == (None, dt.date(1991, 1, 1), None, False)
    assert rows["c"][1:] == (dt.date(1985, 7, 4), None, None, True)


def test_parse_problems(spark, tmp_path):
    raw = delimited.read_text(spark, text(tmp_path), SCHEMA.names)
    got = sorted(tuple(r) for r in delimited.parse_problems(raw, SCHEMA, FORMATS, ["id"]).collect())
    assert got == [("b", "born", "05/00/1971", "date M/d/yyyy"), ("c", "season", "year", "date %Y"), ("c", "x", "abc", "double")]


def test_export_and_stages(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for fmt in ("csv", "parquet"):
        delimited.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.parquet(str(tmp_path / "parquet")).schema == df.schema
    with pytest.raises(ValueError):
        delimited.write_table(df, str(tmp_path / "x"), "xml")
    saved = stages.save_stage(df, "pairs")   # in the folder that the session names
    assert sorted(saved.collect()) == sorted(stages.load_stage(spark, "pairs").collect()) == sorted(df.collect())


def test_people_with_more_columns_than_used(spark, tmp_path):
    path = tmp_path / "bio.csv"
    columns = [f.name for f in inputs.PEOPLE] + ["EXTRA"]
    values = {"PLAYERID": "aa001", "NICKNAME": "Al", "LAST": "Able", "BIRTHDATE": "01/02/1970", "PLAY.DEBUT": "04/09/1991", "EXTRA": "z"}
    path.write_text(",".join(columns) + "\n" + ",".join(values.get(c, "") for c in columns) + "\n")
    people = inputs.read_people(spark, str(path))
    assert "EXTRA" not in people.columns
    row = inputs.current_people(people).first()
    assert (row.NAME, row.PLAY_DEBUT, row.PLAY_LASTGAME) == ("Al Able", dt.date(1991, 4, 9), dt.date(2020, 10, 5))


def test_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "weights.csv"
    path.write_text("Season,wOBA,wBB,wHBP,w1B,w2B,w3B,wHR,extra\n2001,.33,.7,.72,.88,1.2,1.6,2.0,x\n2002,.34,.71\n2003,.3,.7,.72,.88,1.2,1.6,2.1,x,y\n")
    rows = {r.Season.year: r for r in inputs.read_weights(spark, str(path)).collect()}
    assert (rows[2001].wBB, rows[2001].wHR) == (0.7, 2.0) and (rows[2002].wBB, rows[2002].wHR) == (0.71, None)
    assert sorted(r.record for r in delimited.record_problems(spark, str(path)).collect()) == ["2002,.34,.71", "2003,.3,.7,.72,.88,1.2,1.6,2.1,x,y"]
    with pytest.raises(ValueError, match="IP"):
        inputs.read_leaderboard(spark, str(path))


def test_tables_of_a_scope_are_reused_and_removed(spark, tmp_path):
    source = tmp_path / "source"
    spark.range(50).write.parquet(str(source))

    def doubled():
        return spark.read.parquet(str(source)).selectExpr("id", "id * 2 as twice")

    with stages.Stages(spark, str(tmp_path / "base")) as scope:
        first = scope.keep(doubled(), "doubled")
        assert scope.keep(doubled(), "doubled") is first and len(scope.paths) == 1
        other = scope.keep(doubled().filter("id > 3"), "doubled")
        assert len(scope.paths) == 2 and (first.count(), other.count()) == (50, 46)
        spark.range(50, 60).write.mode("append").parquet(str(source))
        assert scope.keep(doubled(), "doubled").count() == 60 and len(scope.paths) == 3
        chance = [scope.keep(doubled().selectExpr("id", "rand() as r")) for _ in range(2)]
        assert chance[0] is not chance[1]
    assert not [f for f in (tmp_path / "base").rglob("*") if f.is_file()] and scope.paths == []


def test_tables_of_the_session_go_with_it(spark):
    scope = stages.session_stages(spark)
    assert stages.session_stages(spark) is scope
    scope.keep(spark.range(3))
    system, place = scope._system(scope.paths[-1])
    assert system.exists(place)


def test_a_program_leaves_no_files(tmp_path):
    import subprocess
    import sys
    program = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from careerspark.sources.stages import session_stages
assert session_stages(spark).keep(spark.range(5)).count() == 5
"""
    subprocess.run([sys.executable, "-c", program], check=True, timeout=120, cwd=entry_folder())
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def entry_folder():
    from pathlib import Path
    return Path(__file__).resolve().parent.parent


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,x,born\na,1.5,7/4/1985\nb,2\n")
    (tmp_path / "in" / "b.csv").write_text("born,extra,x,id\n7/5/1985,z,2.5,c\n1/1/1990,z,3,d,more\n")
    (tmp_path / "in" / "c.csv").write_text("x,id\n9,e\n")
    schema = T.StructType([SCHEMA["id"], SCHEMA["born"], SCHEMA["x"]])
    path = str(tmp_path / "in")
    rows = sorted(tuple(r) for r in delimited.read_csv(spark, path, schema, FORMATS, absent="null").collect())
    assert rows == [("a", dt.date(1985, 7, 4), 1.5), ("b", None, 2.0), ("c", dt.date(1985, 7, 5), 2.5), ("d", dt.date(1990, 1, 1), 3.0), ("e", None, 9.0)]
    assert sorted(r.record for r in delimited.record_problems(spark, path).collect()) == ["1/1/1990,z,3,d,more", "b,2"]
    with pytest.raises(ValueError, match="born"):
        delimited.read_csv(spark, path, schema, FORMATS)
    with pytest.raises(ValueError, match="nowhere"):
        delimited.read_text(spark, path, ["id", "nowhere"], absent="null")
