"""That linkage's costly rows are spread over tasks."""

import glob

from rollcall.sources.shared import spread, stash


def test_few_bytes_stay_in_all_tasks(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 7 as string) as roster")
    out = stash(spread(rows.groupBy("id").agg({"roster": "max"}), "id"))
    assert out.count() == 400 and len(glob.glob(out._stash_path.removeprefix("file://") + "/part-*")) == 4
