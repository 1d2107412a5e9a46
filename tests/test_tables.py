"""Tables in the shared folder: who deletes them, and the setting that two writers share."""

import os
import threading

from filingscope import tables as T


def folders(spark):
    root = T.shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(root) if os.path.isdir(f"{root}/{x}")}


def test_only_the_result_stays(spark):
    before = folders(spark)

    def make():
        step = T.write_table(spark.range(10), "step")
        inner = T.write_alone(lambda: T.write_table(step, "deep").filter("id > 2"), "inner", spark)
        return inner.union(step)

    out = T.write_alone(make, "whole", spark)
    assert out.count() == 17 and {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"whole"}
    T.drop_table(out)
    assert folders(spark) == before


def test_writers_in_threads_restore_the_setting(spark):
    spark.conf.set(T.CLEANUP, "false")
    threads = [threading.Thread(target=lambda: T.drop_table(T.write_table(spark.range(100), "t"))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(T.CLEANUP) == "false"
