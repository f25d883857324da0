"""Plans on a stream of changes against the batch operator, request by request."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilspan.operators import review as R
from veilspan.schemas import BBOX
from veilspan.streaming.review import EVENTS, revise_stream

REGIONS = f"plan_id string, revision long, region_id string, bbox {BBOX}, provenance string, action string, detection_type string, confidence double, geometry_modified boolean"
SEED = 16
PLANS = "plan_id string, revision long, image_width int, image_height int"


def region(n):
    return (f"auto-{n:04d}", (n, n, n + 10, n + 10), "automatic", "retain", "face", 0.5, False)


def event(plan, arrival, kind, regions=None, expected=None, decisions=None, moves=None, additions=None):
    size = (100, 80) if kind == "plan" else (None, None)
    return (plan, arrival, kind, *size, regions, expected, decisions, moves, additions)


def change_log(seed, rounds=3):
    """Three plans, then rounds of one request for each of them and for an unknown plan."""
    rng = random.Random(seed)
    log = [event(p, i, "plan", [region(n) for n in range(3)]) for i, p in enumerate("abc")]
    revision = dict.fromkeys("abcx", 0)
    for arrival in range(3, 3 + 4 * rounds):
        plan = "abcx"[(arrival - 3) % 4]
        expected = revision[plan] - (rng.random() < 0.2)
        names = [rng.choice(["auto-0000", "auto-0001", "auto-0002", "nobody"]) for _ in range(rng.randint(0, 2))]
        decisions = [(n, rng.choice(["retain", "remove"])) for n in names]
        moves = [(n, (1, 2, rng.choice([20, 30, 101]), 40)) for n in names[:1]]
        additions = [(k, (5, 5, 9, 9), rng.choice(["face", None])) for k in range(2 - len(names))]
        log.append(event(plan, arrival, "change", None, expected, decisions, moves, additions))
        wrong = plan == "x" or expected != revision[plan] or len(set(names)) < len(names) or "nobody" in names or any(b[2] > 100 for _, b in moves)
        revision[plan] += not wrong
    return log


def by_rounds(spark, log):
    """Last regions and accepted arrivals when the batch operator gets the rounds one after the other."""
    first = [e for e in log if e[2] == "plan"]
    accepted = [e[1] for e in first]
    plans = {e[0]: (e[0], 0, 100, 80) for e in first}
    regions = {e[0]: [(e[0], 0, *r) for r in e[5]] for e in first}
    changes = [e for e in log if e[2] == "change"]
    for start in range(0, len(changes), 4):
        asked = {e[0]: e for e in changes[start : start + 4]}

        def rows(column, schema):
            found = [(p, e[6], *x) for p, e in asked.items() for x in e[column]]  # noqa: B023
            return spark.createDataFrame(found, f"plan_id string, expected_revision long, {schema}")

        new_plans, new_regions = R.revise_plans(
            spark.createDataFrame(list(plans.values()), PLANS),
            spark.createDataFrame([r for rs in regions.values() for r in rs], REGIONS),
            rows(7, "region_id string, action string"),
            rows(8, f"region_id string, bbox {BBOX}"),
            rows(9, f"request_no long, bbox {BBOX}, detection_type string"),
        )
        made = [tuple(r) for r in new_regions.collect()]
        for plan in {r[0] for r in made}:
            regions[plan] = [r for r in made if r[0] == plan]
            plans[plan] = (plan, regions[plan][0][1], 100, 80)
            accepted.append(asked[plan][1])
    return sorted(accepted), {r for rs in regions.values() for r in rs}


@pytest.fixture(autouse=True)
def ends(spark):
    """Without batches for timers alone, a run ends once it has read what is there."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(spark, tmp_path, parts, keep="1 day", pause=0.0):
    """One start of the stream per part, each from where the last one stopped."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        time.sleep(pause)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = revise_stream(stream, keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("cuts", [[], [5, 6]])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    log = change_log(SEED)
    accepted, want = by_rounds(spark, log)
    bounds = [0, *cuts, len(log)]
    parts = [random.Random(1).sample(log[a:b], b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    decided = run(spark, tmp_path, parts)
    assert sorted(r.arrival for r in decided.filter("accepted").collect()) == accepted
    assert 5 < len(accepted) < len(log) - 5  # some requests are refused, some plans revised
    assert all(r.reasons for r in decided.filter("NOT accepted").collect())
    last = decided.filter("regions IS NOT NULL").groupBy("plan_id").agg(F.max_by(F.struct("revision", "regions"), "arrival").alias("m"))
    got = last.select("plan_id", "m.revision", F.inline("m.regions"))
    assert {tuple(r) for r in got.collect()} == want


def test_exports_and_timers(spark, tmp_path):
    change = event("p", 3, "change", None, 0, [("auto-0001", "remove")])
    parts = [
        [event("p", 1, "plan", [region(1)]), event("q", 1, "plan", []), event("p", 2, "export")],
        [change, event("p", 4, "export"), event("x", 4, "export"), event("q", 4, "other")],
        [event("q", 5, "change", None, 0, additions=[(1, (1, 1, 5, 5), "cat")])],
        [event("p", 6, "change", None, 1, [("auto-0001", "retain")]), event("q", 6, "plan", [])],
    ]
    rows = run(spark, tmp_path, parts[:2]).collect()
    got = {(r.plan_id, r.arrival): (r.accepted, r.revision, r.state) for r in rows}
    assert got["p", 2] == (True, 0, "exported")
    assert got["p", 3] == (True, 1, "analyzed")  # a change voids the export
    assert got["p", 4] == (True, 1, "exported")
    assert got["x", 4] == (False, None, None)
    assert got["q", 4] == (False, 0, "analyzed")
    (tmp_path / "timed").mkdir()
    rows = run(spark, tmp_path / "timed", parts, keep="1 millisecond", pause=0.2).collect()
    reasons = {(r.plan_id, r.arrival): r.reasons for r in rows}
    assert reasons["p", 6] == ["unknown_plan"]  # finished and dropped
    assert reasons["q", 5] == ["unknown_type"] and reasons["q", 6] == ["known_plan"]  # never exported, so kept
