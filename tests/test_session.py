import os

from surecal.session import release, scratch_path


def test_release_deletes_what_was_handed_out(spark):
    release(spark)
    path = scratch_path(spark, "thing")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    assert release(spark) == 1 and not os.path.exists(local)
    assert release(spark) == 0
