"""There is no broker here; these check what would be asked of the connector."""

from unittest.mock import MagicMock

import pytest
from pyspark.errors import AnalysisException

from tillstream.sources.topics import KafkaTopic


def recorder():
    """A reader whose calls all return itself, so a chain of them can be looked at."""
    fake = MagicMock()
    for name in ("format", "option", "options", "select"):
        getattr(fake, name).return_value = fake
    return fake


def options_of(fake):
    return {call.args[0]: call.args[1] for call in fake.option.call_args_list}


TOPIC = KafkaTopic("broker:9092", "ecommerce", options={"kafka.security.protocol": "SSL"})


def test_stream_options():
    reader = recorder()
    TOPIC.stream(MagicMock(readStream=reader), limit=100)
    reader.format.assert_called_once_with("kafka")
    assert options_of(reader) == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "ecommerce",
        "startingOffsets": "latest", "maxOffsetsPerTrigger": 100}
    reader.options.assert_called_once_with(**{"kafka.security.protocol": "SSL"})


def test_replay_reads_all_there_is():
    reader = recorder()
    TOPIC.replay(MagicMock(read=reader))
    assert options_of(reader) == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "ecommerce",
        "startingOffsets": "earliest", "endingOffsets": "latest"}


def test_without_the_connector_spark_says_so(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        TOPIC.replay(spark)
