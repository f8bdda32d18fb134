import gc
import time

from wavemark.shared import written


def test_a_written_table_gives_what_the_driver_has_freed_back_to_the_machine(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def megabytes():
        with open(f"/proc/{pid}/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) / 1024

    for _ in range(3):
        written(spark.range(10), "some")
    # Pieces too small to be mapped alone, some of which stay between those that are freed.
    pieces = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(2_000)]
    for i, x in enumerate(pieces):
        if i % 20:
            gateway.detach(x)
    pieces = pieces[::20]
    gc.collect()
    for _ in range(3):
        jvm.java.lang.System.gc()
        time.sleep(0.3)
    before = megabytes()
    assert written(spark.range(10), "some").count() == 10
    assert megabytes() < before - 100
