import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortloom import session, sources
from cohortloom.sources import files


def test_entities_are_named_and_typed(hospital):
    assert hospital["patients"].dtypes == [
        ("SUBJECT_ID", "string"),
        ("GENDER", "string"),
        ("DOB", "timestamp_ntz"),
        ("DOD", "timestamp_ntz"),
        ("DOD_HOSP", "timestamp_ntz"),
    ]
    assert hospital["admissions"].columns == [
        "SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", "DEATHTIME", "ADMISSION_TYPE", "INSURANCE", "DIAGNOSIS",
    ]
    assert len(hospital["microbiology"].columns) == 15


def test_values_read_from_their_positions(hospital):
    row = hospital["admissions"].where("HADM_ID = 'h3'").first()
    assert row["DEATHTIME"] == dt.datetime(2150, 6, 1, 9)
    assert (row["ADMISSION_TYPE"], row["INSURANCE"]) == ("EMERGENCY", "Private")
    assert row["DIAGNOSIS"] == "HYPOTENSION, RENAL FAILURE"


def test_texts_keep_blanks_backslashes_and_leading_zeros(hospital):
    texts = {r[0]: r[1] for r in hospital["admissions"].select("HADM_ID", "DIAGNOSIS").collect()}
    assert texts["h4"] == "PULMONARY EDEMA\\CATH"
    assert texts["h6"] == "VF ARREST "
    assert texts["h5"] is None
    assert hospital["diagnoses"].where("ICD9_CODE = '00845'").count() == 2


def test_values_of_the_wrong_type_become_null(hospital):
    labs = hospital["lab_events"]
    assert labs.where("ROW_ID = 9").first()["CHARTTIME"] is None
    assert labs.where("ROW_ID = 8").first()["VALUENUM"] is None
    assert labs.count() == 12


def test_header_read_as_data_is_dropped(spark, hospital):
    raw = sources.read_csv(spark, hospital["paths"]["patients"], header=False)
    assert raw.columns[0] == "_c0" and raw.count() == 5
    named = sources.by_position(raw, {1: "SUBJECT_ID", 2: "GENDER"})
    kept = sources.drop_header_rows(named, "SUBJECT_ID")
    assert sorted(r[0] for r in kept.collect()) == ["p1", "p2", "p3"]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    for write in (sources.write_csv, sources.write_parquet):
        path = str(tmp_path / write.__name__)
        write(df, path)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            write(df, path)
        write(df, path, mode="overwrite")


def test_round_trips(spark, tmp_path, hospital):
    admissions = hospital["admissions"]
    sources.write_csv(admissions, str(tmp_path / "csv"))
    again = sources.read_csv(spark, str(tmp_path / "csv"), admissions.schema)
    assert again.exceptAll(admissions).isEmpty() and admissions.exceptAll(again).isEmpty()
    sources.write_parquet(admissions, str(tmp_path / "pq"), compression="uncompressed")
    again = sources.read_parquet(spark, str(tmp_path / "pq"))
    assert again.exceptAll(admissions).isEmpty() and again.count() == 6


def test_scratch_lies_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_path(spark, "x")
    assert path != session.scratch_path(spark, "x")
    if named:
        assert path.startswith(named)


def test_materialize_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    cut = session.materialize(df)
    assert cut.dtypes == df.dtypes
    assert cut.exceptAll(df).isEmpty() and cut.count() == 7
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


TEXTS = ['12" scar, left', 'a "quoted" word', '"', '""', "line\nbreak", "tail\\", " blanks ", "", None, "\\N x", ",", "é"]


def test_texts_come_back_exactly(spark, tmp_path, rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    files.write_csv(df, str(tmp_path / "t"), null="\\N")
    assert rows(files.read_csv(spark, str(tmp_path / "t"), df.schema, multi_line=True, null="\\N")) == rows(df)


def test_doubled_quotes_and_broken_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,text,n\n1,"12"" scar, left",7\n2,b,seven\n3,c\n4,"",8\n')
    schema = "id int, text string, n int"
    schema = spark.createDataFrame([], schema).schema
    got = [tuple(r) for r in files.read_csv(spark, str(path), schema).collect()]
    assert got == [(1, '12" scar, left', 7), (2, "b", None), (3, "c", None), (4, None, 8)]
    marked = files.read_csv(spark, str(path), schema, corrupt="line").cache()
    assert {r["id"]: r["line"] for r in marked.where("line IS NOT NULL").collect()} == {2: "2,b,seven", 3: "3,c"}
    assert [r["id"] for r in files.read_csv(spark, str(path), schema, mode="DROPMALFORMED").collect()] == [1, 4]
    with pytest.raises(ValueError, match="schema"):
        files.read_csv(spark, str(path), corrupt="line")


def test_scratch_is_removed(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.remove_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_scratch_follows_a_folder_set_by_the_program():
    context = SimpleNamespace(getCheckpointDir=lambda: "file:/shared/x", master="spark://somewhere")
    program = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    assert session.shared_dir(program) == "file:/shared/x"
    context.getCheckpointDir = lambda: None
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(program)
