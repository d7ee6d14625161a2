from rollcall.__main__ import main
from rollcall.plans import batch
from rollcall.sources.tables import WORDS
from test_convert import report
from test_layout import word


def folder_of_reports(spark):
    first = report()
    again = [("dir/e.pdf",) + w[1:] for w in first]
    return spark.createDataFrame(first + again + [word(1, 1, 0, 0, "text", 10, 10, source="plain")], WORDS)


def test_one_file_a_class_and_failures_by_document(spark, tmp_path):
    words = folder_of_reports(spark)
    items, rows = batch.plan(words)
    got = {r.source: (r.status, r.file_name, r.n_rows, r.issues) for r in items.collect()}
    assert got["plain"] == ("ERROR", None, 0, ["no_signature", "no_students"])
    assert got["d"] == ("OK", "1A_export", 2, [])
    assert got["dir/e.pdf"] == ("REVIEW", "1A_export__2", 2, ["repeated_group"])
    assert rows.count() == 4
    done = batch.export(words, f"file://{tmp_path}/out", cased=True)
    assert (done.documents, done.files, done.failures, done.exit_code) == (3, 2, 1, 2)
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/out/classes")
    assert {(r.Apellidos, r.NIA, r.file_name) for r in back.collect()} == {(s, n, f) for s, n in (("Mas Pi", "0071"), ("Gil", "0072")) for f in ("1A_export", "1A_export__2")}
    assert spark.read.text(f"file://{tmp_path}/out/manifest").count() == 3


def test_commands_and_no_documents(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/words"
    folder_of_reports(spark).where("source <> 'plain'").write.parquet(path)
    assert main(["check", path]) == 0 and "repeated_group" in capsys.readouterr().out
    assert main(["batch", path, f"file://{tmp_path}/done"]) == 0 and "files=2 failures=0" in capsys.readouterr().out
    assert batch.summary(batch.plan(folder_of_reports(spark).limit(0))[0]).first().exit_code == 1
