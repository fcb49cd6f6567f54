"""What the pipeline's stages hold in an executor besides their tables."""

import os
import stat
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose

from gridloom.llm import quality
from gridloom.llm.store import discard, materialise


@pytest.mark.skipif(not Path("/proc/self/stat").exists(), reason="reads /proc")
def test_intermediate_tables_start_no_processes(spark):
    """A child that still shares the JVM's memory counts as much as the JVM. Page faults of children that ended are zero only if there were none."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    faults = lambda: int(Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[8])
    discard(materialise(spark.range(1), "first"))  # what is made once for a session
    before = faults()
    table = materialise(spark.range(0, 1000, 1, 8), "quiet")
    assert faults() == before
    assert table.count() == 1000
    # As Hadoop's own: checksums beside the files, and its permissions.
    folder = Path(table._gridloom_path.removeprefix("file:").replace("//", "/"))
    files = [p for p in folder.iterdir() if p.suffix == ".parquet"]
    assert len(files) == 8 and all((folder / f".{p.name}.crc").exists() for p in files)
    umask = int(spark._jsc.hadoopConfiguration().get("fs.permissions.umask-mode", "022"), 8)
    assert {stat.S_IMODE(os.stat(p).st_mode) for p in files} == {0o666 & ~umask}
    assert stat.S_IMODE(os.stat(folder).st_mode) == 0o777 & ~umask
    discard(table)


def test_quality_encodes_in_little_memory():
    texts = [prose(3000, i) for i in range(200)]
    batch = pa.record_batch([pa.array(range(200)), pa.array(texts), pa.array([i % 2 for i in range(200)])], names=["doc_id", "text", "_gl_fold"])
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        parts = list(quality._encoded(batch))
        held = tracemalloc.get_traced_memory()[0]
        code, count = quality._merged([(grams, np.bincount(place, minlength=len(grams))) for _, _, place, grams in parts])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 6 * size and peak < 22 * size  # before: 8 and 29
    want: dict[int, int] = {}
    for t in texts[:3]:
        for i in range(len(t)):
            gram = int.from_bytes(t[max(0, i - 4) : i + 1].encode(), "big")
            want[gram] = want.get(gram, 0) + 1
    three = [(grams, np.bincount(place[row < 3], minlength=len(grams))) for _, row, place, grams in parts]
    got = dict(zip(*(x.tolist() for x in quality._merged(three)), strict=True))
    assert {k: v for k, v in got.items() if v} == want and int(count.sum()) == size and np.all(np.diff(code) > 0)
