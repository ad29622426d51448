"""Message-broker source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Login module of each SASL mechanism.
_LOGIN = {
    "SCRAM-SHA-256": "org.apache.kafka.common.security.scram.ScramLoginModule",
    "SCRAM-SHA-512": "org.apache.kafka.common.security.scram.ScramLoginModule",
    "PLAIN": "org.apache.kafka.common.security.plain.PlainLoginModule",
}


def kafka_options(
    servers: str, topic: str, username: str | None = None, password: str | None = None,
    mechanism: str = "SCRAM-SHA-256", starting_offsets: str = "earliest", **extra: str,
) -> dict[str, str]:
    """Reader options; credentials switch SASL over TLS on."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting_offsets}
    if username is not None:
        login = _LOGIN[mechanism]
        options |= {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": mechanism,
            "kafka.sasl.jaas.config": f'{login} required username="{username}" password="{password}";',
        }
    return options | extra


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Streaming messages; needs the Kafka connector on the classpath."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()
