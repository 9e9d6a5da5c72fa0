"""The session of streams that keep state."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: State on disk, so that it may exceed memory; files aren't allocated ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def state_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep their state in RocksDB; ``spark`` itself stays as it is."""
    session = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if session.conf.isModifiable(k):
            session.conf.set(k, v)
    # not asked whether these are modifiable: the store's own settings are no registered ones
    for k, v in STATE.items():
        session.conf.set(k, v)
    return session
