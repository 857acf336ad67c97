import json

import pytest

from millrace.sources import paged

CHANNEL: list[int] = []
AT = "tests.test_messages:newest"


def newest(before, size):
    """The provider of these tests."""
    return [{"id": str(i)} for i in sorted((i for i in CHANNEL if before is None or i < int(before)), reverse=True)[:size]]


@pytest.fixture
def channel():
    CHANNEL[:] = range(1, 8)
    yield CHANNEL
    CHANNEL.clear()


def cycle(stream, at, crash=False):
    """Ids until nothing new comes, and the offset; with crash each page is read again by a new reader between its offsets."""
    out = []
    while True:
        rows, then = stream.read(at)
        rows = list(rows)
        if then == at:
            return out, at
        if crash:
            # Messages that came since belong to a later page.
            CHANNEL.append(max(CHANNEL) + 1)
            again = paged.MessageStream({"provider": AT, "page_size": str(stream.size)})
            assert list(again.readBetweenOffsets(json.loads(json.dumps(at)), json.loads(json.dumps(then)))) == rows
            CHANNEL.pop()
        out += [int(i) for i, _ in rows]
        at = then


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
@pytest.mark.parametrize("crash", [False, True])
def test_cycles_lose_and_repeat_nothing(channel, size, crash):
    stream = paged.MessageStream({"provider": AT, "page_size": str(size)})
    got, at = cycle(stream, stream.initialOffset(), crash)
    assert sorted(got) == list(range(1, 8)) and at["floor"] == "7" and at["mode"] == "catchup"
    channel += [8, 9, 12, 13, 14]
    got, at = cycle(stream, at, crash)
    assert sorted(got) == [8, 9, 12, 13, 14] and at["floor"] == "14"
    assert cycle(stream, at)[0] == []


def test_messages_that_come_during_a_cycle_belong_to_the_next(channel):
    stream = paged.MessageStream({"provider": AT, "page_size": "3"})
    rows, at = stream.read(stream.initialOffset())
    assert [i for i, _ in rows] == ["5", "6", "7"] and at | {"page": 0} == {"mode": "backfill", "before": "5", "floor": "0", "high": "7", "page": 0}
    channel += [8, 9]
    got, at = cycle(stream, at)
    assert sorted(got) == [1, 2, 3, 4, 8, 9] and at["floor"] == "9"


def test_floor_empty_channel_and_faults(channel):
    stream = paged.MessageStream({"provider": AT, "page_size": "2", "floor": "4"})
    assert stream.initialOffset()["mode"] == "catchup" and sorted(cycle(stream, stream.initialOffset())[0]) == [5, 6, 7]
    stream.fetch = lambda before, size: [{"id": "9"}, {"id": "8"}]
    with pytest.raises(ValueError, match="holds 9"):
        stream.read({"mode": "backfill", "before": "5", "floor": "0", "high": "9", "page": 1})
    channel.clear()
    empty = paged.MessageStream({"provider": AT})
    assert cycle(empty, empty.initialOffset()) == ([], empty.initialOffset())


def ten(before, size):
    return [{"id": str(i)} for i in range(10, 0, -1) if before is None or i < int(before)][:size]


def test_a_query_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(paged.MessageSource)
    for _ in range(2):
        rows = spark.readStream.format("messages").option("provider", "tests.test_messages:ten").option("page_size", "4").load()
        writer = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds")
        query = writer.start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
    assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, 11))
