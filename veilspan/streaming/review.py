"""Review plans on a stream of change requests, with one keyed state per plan.

An event is a row ``plan_id, arrival, kind`` with what its kind needs:

* ``plan``: ``image_width, image_height, regions`` of revision 0;
* ``change``: ``expected_revision`` with ``decisions``, ``moves`` and ``additions``,
  which are accepted or refused together;
* ``export``: the current revision was exported.

Requests of a plan are decided in order of ``arrival``, so of two that expect the same
revision the first wins.  A change after an export voids it.  What can be told from the
request alone is judged in column expressions; the state only adds what depends on the
plan.  An exported plan that gets no further event is dropped after a time, and requests
that come later are refused as ``unknown_plan``.  Spark makes batches for timers alone as
long as a query runs; a query that is to end when its input is read (``availableNow``)
needs ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false, and its timers are
looked at with its next data.

Rows: null lists are empty lists, an event of another kind is refused.  A repeated event
is decided again, so a repeated change is stale.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspan import schemas as S
from veilspan.functions.boxes import bbox_is_valid

REGION = (
    f"struct<region_id:string,bbox:{S.BBOX},provenance:string,action:string,"
    "detection_type:string,confidence:double,geometry_modified:boolean>"
)
EVENTS = (
    "plan_id string, arrival long, kind string, image_width int, image_height int,"
    f" regions array<{REGION}>, expected_revision long,"
    " decisions array<struct<region_id:string,action:string>>,"
    f" moves array<struct<region_id:string,bbox:{S.BBOX}>>,"
    f" additions array<struct<request_no:long,bbox:{S.BBOX},detection_type:string>>"
)
_DECIDED = "plan_id string, arrival long, kind string, accepted boolean, reasons string, revision long, state string, regions string"
_STATE = "plan string"


def request_reasons() -> Column:
    """What is wrong with a request whatever its plan is, as sorted distinct reasons."""

    def repeated(requests: str) -> Column:
        ids = F.transform(requests, lambda r: r["region_id"])
        return F.size(F.array_distinct(ids)) < F.size(ids)

    wrong_type = F.exists(
        "additions",
        lambda r: r["detection_type"].isNotNull() & ~r["detection_type"].isin(*S.DETECTION_TYPES),
    )
    bad_box = [F.exists(c, lambda r: ~bbox_is_valid(r["bbox"])) for c in ("moves", "additions")]
    rules = {
        "duplicate_decision": repeated("decisions"),
        "duplicate_geometry_update": repeated("moves"),
        "invalid_box": bad_box[0] | bad_box[1],
        "unknown_action": F.exists("decisions", lambda r: ~F.coalesce(r["action"].isin(*S.ACTIONS), F.lit(False))),
        "unknown_kind": ~F.coalesce(F.col("kind").isin("plan", "change", "export"), F.lit(False)),
        "unknown_type": wrong_type,
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def _json_events(events: DataFrame) -> DataFrame:
    """Events with null lists as empty ones; what the state needs travels as one JSON text."""
    lists = {c: F.coalesce(c, F.array()) for c in ("regions", "decisions", "moves", "additions")}
    return events.withColumns(lists).select(
        "plan_id",
        "arrival",
        "kind",
        F.to_json(
            F.struct("expected_revision", "image_width", "image_height", *lists, request_reasons().alias("reasons")),
            {"ignoreNullFields": "false"},
        ).alias("event"),
    )


def _plan_reasons(plan: dict, event: dict) -> set[str]:
    """What is wrong with a change of this plan."""
    known = [r["region_id"] for r in plan["regions"]]
    wrong = set()
    if event["expected_revision"] != plan["revision"]:
        wrong.add("stale_revision")
    for kind, requests in (("decision", event["decisions"]), ("geometry_update", event["moves"])):
        named = {r["region_id"] for r in requests}
        if not named <= set(known):
            wrong.add(f"unknown_{kind}_region")
        if any(known.count(n) > 1 for n in named):
            wrong.add("ambiguous_region")
    for box in (r["bbox"] for r in event["moves"] + event["additions"]):
        if box and (box["x2"] or 0) > plan["image_width"] or box and (box["y2"] or 0) > plan["image_height"]:
            wrong.add("outside_image")
    return wrong


def _revised(plan_id: str, plan: dict, event: dict) -> list[dict]:
    """The regions of the next revision."""
    actions = {r["region_id"]: r["action"] for r in event["decisions"]}
    boxes = {r["region_id"]: r["bbox"] for r in event["moves"]}
    regions = []
    for old in plan["regions"]:
        box = boxes.get(old["region_id"], old["bbox"])
        moved = old["provenance"] == "automatic" and box != old["bbox"]
        regions.append(
            old
            | {
                "bbox": box,
                "action": actions.get(old["region_id"], old["action"]),
                "geometry_modified": old["geometry_modified"] or moved,
            }
        )
    for new in event["additions"]:
        name = hashlib.sha256(f"{plan_id}|{event['expected_revision']}|{new['request_no']}".encode()).hexdigest()
        regions.append(
            {
                "region_id": f"manual-{name[:32]}",
                "bbox": new["bbox"],
                "provenance": "manual",
                "action": "retain",
                "detection_type": new["detection_type"],
                "confidence": None,
                "geometry_modified": False,
            }
        )
    return regions


def _decide(plan_id: str, plan: dict | None, kind: str, event: dict) -> tuple[dict | None, list[str], bool]:
    """The plan after an event, why the event was refused, and whether regions are new."""
    wrong = set(event["reasons"])
    if kind == "plan":
        if plan is not None:
            wrong.add("known_plan")
        if wrong:
            return plan, sorted(wrong), False
        kept = {k: event[k] for k in ("image_width", "image_height", "regions")}
        return kept | {"revision": 0, "state": "analyzed"}, [], True
    if plan is None:
        return None, sorted(wrong | {"unknown_plan"}), False
    if kind == "export":
        return (plan, sorted(wrong), False) if wrong else (plan | {"state": "exported"}, [], False)
    wrong |= _plan_reasons(plan, event)
    if wrong:
        return plan, sorted(wrong), False
    regions = _revised(plan_id, plan, event)
    return plan | {"regions": regions, "revision": plan["revision"] + 1, "state": "analyzed"}, [], True


def revise_stream(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """Decide a stream of ``EVENTS``: one row per event.

    Columns ``plan_id, arrival, kind, accepted, reasons, revision, state, regions``;
    ``revision`` and ``state`` are the plan's after the event, ``regions`` those of a
    revision that the event made.  State is one plan per key.  The timer of an exported
    plan runs for ``keep`` of processing time and starts anew with each event.
    """
    wait = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        plan_id = key[0]
        plan = json.loads(state.get[0]) if state.exists else None
        rows = []
        for event in pd.concat(list(batches)).sort_values("arrival", kind="stable").itertuples(index=False):
            plan, wrong, made = _decide(plan_id, plan, event.kind, json.loads(event.event))
            there = plan or {"revision": None, "state": None}
            regions = json.dumps(plan["regions"]) if made else None
            rows.append((plan_id, event.arrival, event.kind, not wrong, json.dumps(wrong), there["revision"], there["state"], regions))
        if plan is not None:
            state.update((json.dumps(plan),))
            if plan["state"] == "exported":
                state.setTimeoutDuration(max(wait, 1))
        names = [part.split()[0] for part in _DECIDED.split(", ")]
        yield pd.DataFrame(rows, columns=names).astype({"revision": "Int64"})

    decided = (
        _json_events(events)
        .groupBy("plan_id")
        .applyInPandasWithState(step, _DECIDED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
    return decided.withColumns(
        {
            "reasons": F.from_json("reasons", "array<string>"),
            "regions": F.from_json("regions", f"array<{REGION}>"),
        }
    )
