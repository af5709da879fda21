"""What a worker holds between tasks."""

import subprocess
import sys

PACKS = """
import random, re
import pyarrow as pa
import pyspark
from millrace.llm import packing, tokens

pyspark.TaskContext.get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())
private = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
batches = (pa.record_batch({"doc_id": pa.array(range(1000)), "text": [" ".join(rng.choices(words, k=1200)) for _ in range(1000)]}) for _ in range(4))
rows = sum(b.num_rows for b in packing._pack(2048, 1, tokens.VOCABULARY, 2_000_000)(batches))
held = private()
pa.default_memory_pool().release_unused()
print(rows, held - private())
"""


def test_packing_leaves_arrow_no_freed_memory():
    rows, held = subprocess.run([sys.executable, "-c", PACKS], capture_output=True, text=True, check=True).stdout.split()
    assert int(rows) >= 4000 and float(held) < 40


def test_released_batches_are_the_batches():
    import pyarrow as pa

    from millrace.llm.common import released

    batches = [pa.record_batch({"x": pa.array(range(k, k + n), pa.int64())}) for k, n in ((0, 5), (5, 0), (5, 3))]
    assert [b.column(0).to_pylist() for b in released(batches)] == [[0, 1, 2, 3, 4], [5, 6, 7]]
    assert [b.column(0).to_pylist() for b in released(batches, 2)] == [[0, 1], [2, 3], [4], [5, 6], [7]]
