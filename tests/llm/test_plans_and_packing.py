"""Packing step by step against its rule, and joins on hot keys that adaptive execution splits."""

import random

import pytest
from inkfold.llm import components, packing


def plain_choice(length, later, rooms, capacities):
    """The size that a new bin should have: least cost per word that it can expect to hold."""

    def unit_cost(c):
        beside = c - length
        # Of pieces as long as this one only those still to come count, and only if one fits.
        fill = sum(x for x in later if x <= beside)
        return packing.sequence_cost(c) / (length + min(beside, max(0, fill - sum(rooms))))

    return min((c for c in capacities if c >= length), key=lambda c: (unit_cost(c), -c))


def test_every_piece_goes_where_the_rule_says():
    draw = random.Random(21)
    for _ in range(300):
        capacities = tuple(sorted(draw.sample(range(6, 60), draw.randint(1, 4))))
        lengths = sorted((draw.randint(1, capacities[-1]) for _ in range(draw.randint(0, 60))), reverse=True)
        owner, offset, final, used = packing.best_fit(lengths, capacities)
        sizes, held = [], []
        for k, length in enumerate(lengths):
            rooms = [c - u for c, u in zip(sizes, held, strict=True)]
            fitting = [room for room in rooms if room >= length]
            if fitting:
                assert rooms[owner[k]] == min(fitting)
            else:
                assert owner[k] == len(sizes)
                sizes.append(plain_choice(length, lengths[k + 1 :], rooms, capacities))
                held.append(0)
            assert offset[k] == held[owner[k]]
            held[owner[k]] += length
        assert held == list(used)
        assert list(final) == [min(c for c in capacities if c >= u) for u in held]


@pytest.fixture
def low_thresholds(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_the_hub_of_a_component_is_split(spark, monkeypatch, low_thresholds):
    """A node with nearly all links: its join is one that adaptive execution splits."""
    edges = [(f"{i:06d}", "000001") for i in range(2, 20_000)] + [(f"{i:06d}", f"{i + 1:06d}") for i in range(5, 200)]
    frame = spark.createDataFrame(edges, "a STRING, b STRING").repartition(8)
    plans, plain = [], components.written

    def noted(df, label):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(components, "written", noted)
    found = components.connected_components(frame)
    assert {r["label"] for r in found.collect()} == {"000001"} and found.count() == 19_999
    assert any("skew=true" in plan for plan in plans)
