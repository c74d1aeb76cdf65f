import gc
import os
import re
import subprocess
import time
from pathlib import Path

import pytest

from millrace.plans import scratch


def held(pid):
    """MB of a process without mapped files."""
    parts = re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())
    return int(parts[0]) / 1024


def test_driver_is_relieved_every_few_tables(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "relieve", calls.append)
    for i in range(2 * scratch.TABLES):
        kept = scratch.stored(spark.range(i), "few")
        assert kept.count() == i
        scratch.discard(kept)
    assert calls == [spark, spark]


def test_relieve_returns_freed_native_memory(spark):
    """150 MB of small native buffers, of which a few stay in use among the freed ones."""
    jvm = spark.sparkContext._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    if not os.path.exists(f"/proc/{pid}/smaps_rollup") or "trim_native_heap" not in subprocess.run(["jcmd", str(pid), "help"], capture_output=True, text=True).stdout:
        pytest.skip("memory can't be read here, or this JVM can't return it")
    buffers = spark.sparkContext._gateway.new_array(jvm.Object, 1500)
    for i in range(1500):
        buffers[i] = jvm.java.nio.ByteBuffer.allocateDirect(100_000)
    for i in range(1500):
        if i % 15:
            buffers[i] = None
    gc.collect()
    jvm.System.gc()
    time.sleep(1)  # buffers are freed by a thread of the JVM
    before = held(pid)
    assert scratch.relieve(spark)
    assert held(pid) < before - 50
    assert buffers[0].capacity() == 100_000
