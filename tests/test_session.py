"""Session helpers: shared folder and partition sizing."""

import pytest

from navframe.session import cluster_settings, local_settings, shared_dir


def test_shared_dir_uses_session_checkpoint_dir(spark):
    # the session's setting wins; the context's dir is the fallback
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert base
    p = shared_dir(spark, "landing", "x", unique=True)
    assert p.startswith(base) and p != shared_dir(spark, "landing", "x", unique=True)


def test_cluster_settings_size_by_bytes():
    tb = 1024**4
    s = cluster_settings(shuffle_bytes=20 * tb, total_cores=8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 81920
    assert s["spark.sql.adaptive.coalescePartitions.parallelismFirst"] == "false"
    assert int(cluster_settings(1024, 100)["spark.sql.shuffle.partitions"]) == 300
    # no ceiling: partitions keep their size however large the shuffle
    assert int(cluster_settings(10**18, 10)["spark.sql.shuffle.partitions"]) == -(-(10**18) // (256 * 1024 * 1024))


def test_local_settings():
    assert local_settings(8)["spark.sql.shuffle.partitions"] == "16"


def test_size_estimate_and_broadcast_check(spark):
    from conftest import SF01

    from navframe.operators.joins import broadcast_if_small, estimated_size_bytes

    sup = spark.read.parquet(SF01 + "/supplier.parquet")
    size = estimated_size_bytes(sup)
    assert size is not None and 0 < size < 1024 * 1024
    small = broadcast_if_small(sup)
    assert small is not sup  # hinted
    assert broadcast_if_small(sup, max_bytes=10) is sup  # beyond the bound: unchanged


def test_parse_bytes_and_threshold(spark):
    from navframe.operators.joins import broadcast_threshold, parse_bytes

    assert parse_bytes("10485760b") == 10485760
    assert parse_bytes("64MB") == 64 * 1024**2
    assert parse_bytes("1g") == 1024**3
    assert parse_bytes("-1") == -1
    df = spark.range(1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
        assert broadcast_threshold(df) == 64 * 1024**2
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert broadcast_threshold(df) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shared_dir_refuses_local_folder_off_local_masters():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")
