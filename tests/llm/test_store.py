"""The shared folder and what workers get at once."""

import pytest

from ledgerspark.llm import store


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    """Stands for a session with a master and settings."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master, "getConf": lambda _: Conf()})()


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session("local-cluster[3,2,1024]"))
    assert store.shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert store.shared_dir(Session("local[8]")) == store.shared_dir(Session("local[8]"))


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "repeat('abcdefgh ', 500) text")
    source = store.texts(docs)
    sizes = source.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 0) if b.nbytes < 3 * store.BATCH_BYTES else b.select(["doc_id"]) for b in batches), "doc_id long")
    assert sizes.count() == 0
