import os
import re
import sys

import pytest

from roadloom.llm.scratch import Scratch


def anonymous(pid):
    """MB"""
    with open(f"/proc/{pid}/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_free_memory_of_the_driver_goes_back_to_the_system(spark):
    jvm, scratch = spark.sparkContext._jvm, Scratch(spark, "memory")
    java, own = jvm.java.lang.ProcessHandle.current().pid(), os.getpid()
    # The last of each stays, so that what is free lies below it and isn't given back at once.
    native = [jvm.java.util.zip.Inflater() for _ in range(6000)]
    for x in native[:-1]:
        x.end()
    texts = [bytes(1000) for _ in range(100_000)]
    last = texts[-1]
    del texts
    for _ in range(3):
        jvm.System.gc()
    before = anonymous(java), anonymous(own)
    scratch.settle()
    after = anonymous(java), anonymous(own)
    native[-1].end()
    assert len(last) == 1000
    assert before[0] - after[0] > 25 and before[1] - after[1] > 50, (before, after)
    scratch.close()
