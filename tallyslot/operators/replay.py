"""Requests that depend on each other, answered as if they came one by one in request order.

A request reads and writes the values of a few keys: the row that it changes, the
slots it wants, the slots it frees. Requests that share no key with another one
do not depend on the batch and are answered by plain expressions elsewhere. What
is left falls into components linked by shared keys. Each component is replayed
in order by one streaming pass. A component that is too large for that is first
worn down in rounds: a request that is the earliest on all of its keys depends on
no open request, so all such requests are answered at once, wherever they are,
and the values that they wrote are handed to the open ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyslot.operators.components import components
from tallyslot.settings import Scale
from tallyslot.sources.workdir import materialise

#: Rounds go on while each answers at least this share of the open requests of large components.
LEAST_GAIN = 1 / 16
ROUNDS_BETWEEN = 4

#: Values are text or numbers; on the way between tasks they are text.
State = dict[str, str | int | None]


class Machine(Protocol):
    """What one request does. Pickled to the tasks, so it holds nothing but constants."""

    #: The answer's columns, as DDL.
    answer: str

    def held(self, ask: dict) -> list[tuple[str, str | None]]:
        """The keys that the request names or that its row holds in the stored tables, with their stored values."""

    def step(self, state: State, ask: dict) -> tuple:
        """Answer ``ask`` from the state and write what it changes."""

    def leads_to(self, key: str, value: str | None) -> list[str]:
        """Keys that a request on ``key`` may also free, given its value."""


def sharing(requests: DataFrame) -> DataFrame:
    """``request_id`` of the requests that share a key with another request; ``requests`` has ``request_id, keys``.

    Each key keeps only its least and largest request, so a key that very many
    requests share is combined before the shuffle. Keys may be hashes: two keys
    of one hash only add requests to the result.
    """
    touched = requests.select("request_id", F.explode("keys").alias("key"))
    shared = touched.groupBy("key").agg(F.min("request_id").alias("_a"), F.max("request_id").alias("_b")).where("_a <> _b")
    return touched.join(shared.select("key"), "key", "left_semi").select("request_id").distinct()


def _text(value: str | int | None) -> str | None:
    return None if value is None else str(value)


def _dicts(structs: pa.StructArray) -> Iterator[dict]:
    """The rows of a struct column, made from whole columns."""
    names = [field.name for field in structs.type]
    return (dict(zip(names, row)) for row in zip(*(c.to_pylist() for c in structs.flatten()), strict=True))


def _with_keys(requests: DataFrame, machine: Machine) -> DataFrame:
    """``request_id, keys, values``."""
    schema = T._parse_datatype_string("request_id long, keys array<string>, values array<string>")
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for batch in batches:
            held = [dict(machine.held(ask)) for ask in _dicts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(h) for h in held], kinds[1]), pa.array([[_text(v) for v in h.values()] for h in held], kinds[2])],
                names=schema.names,
            )

    return requests.select("request_id", "ask").mapInArrow(run, schema)


def _hashed(requests: DataFrame) -> DataFrame:
    """``request_id, keys`` with a hash for each key: two keys of one hash only add links."""
    return requests.select("request_id", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys"))


def _links(requests: DataFrame) -> DataFrame:
    """Each request with the earliest one on each of its keys."""
    touched = requests.select("request_id", F.explode("keys").alias("key"))
    first = materialise(touched.groupBy("key").agg(F.min("request_id").alias("_first")), "first-on-key")
    return touched.join(first, "key").select("request_id", "_first")


def _in_order(requests: DataFrame, machine: Machine) -> DataFrame:
    """Replay components (``component, request_id, ask``, and ``keys, values`` where they are known), each in one streaming pass.

    A task holds the values of the keys of one component at a time.
    """
    answer = T._parse_datatype_string(machine.answer)
    schema = T.StructType([T.StructField("request_id", T.LongType()), *answer.fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = {}, None
        for batch in batches:
            out = []
            component_of, request_of, asked, *rest = batch.columns
            known_of = [c.to_pylist() for c in rest]
            for component, request, ask, *known in zip(component_of.to_pylist(), request_of.to_pylist(), _dicts(asked), *known_of, strict=True):
                if component != current:
                    state, current = {}, component
                for key, value in zip(*known, strict=True) if known else machine.held(ask):
                    state.setdefault(key, value)
                out.append((request, *machine.step(state, ask)))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    placed = requests.select("component", "request_id", "ask", *[c for c in ("keys", "values") if c in requests.columns])
    placed = placed.repartition("component").sortWithinPartitions("component", "request_id")
    return placed.mapInArrow(run, schema)


def _ready(requests: DataFrame) -> DataFrame:
    """The requests that are the earliest on all of their keys."""
    first = requests.select("request_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("request_id").alias("request_id"))
    led = first.groupBy("request_id").agg(F.count(F.lit(1)).alias("_led"))
    return requests.join(led, "request_id").where(F.col("_led") == F.size("keys")).drop("_led")


def _round(ready: DataFrame, machine: Machine) -> DataFrame:
    """Answer requests that share no key: ``request_id, _answer, _wrote`` with the values that they leave behind."""
    answer = T._parse_datatype_string(machine.answer)
    wrote = "array<struct<key:string,value:string,more:array<struct<key:string,value:string>>>>"
    schema = T.StructType(
        [T.StructField("request_id", T.LongType()), T.StructField("_answer", answer), T.StructField("_wrote", T._parse_datatype_string(wrote))]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    fields = answer.names

    def run(batches):
        for batch in batches:
            out = []
            *plain, asked = batch.columns
            for request, keys, values, ask in zip(*(c.to_pylist() for c in plain), _dicts(asked), strict=True):
                before = dict(zip(keys, values, strict=True))
                state = dict(before)
                said = dict(zip(fields, machine.step(state, ask), strict=True))
                changed = {k for k, v in state.items() if v != before.get(k)}
                more = {k: machine.leads_to(k, state[k]) for k in changed}
                changed |= {m for ms in more.values() for m in ms}
                now = {k: _text(state.get(k)) for k in changed}
                held = [{"key": k, "value": now[k], "more": [{"key": m, "value": now[m]} for m in more.get(k, ())]} for k in changed]
                out.append((request, said, held))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return ready.select("request_id", "keys", "values", "ask").mapInArrow(run, schema)


def _after(requests: DataFrame, done: DataFrame) -> DataFrame:
    """The open requests with the values that ``done`` wrote, and with the keys that those values lead to."""
    wrote = materialise(done.select(F.explode("_wrote").alias("w")).select("w.*"), "replay-wrote")
    held = requests.join(done, "request_id", "left_anti").select("request_id", F.explode(F.arrays_zip("keys", "values")).alias("e"))
    held = held.select("request_id", F.col("e.keys").alias("key"), F.col("e.values").alias("value"))
    news = wrote.select("key", F.struct("value").alias("_new"), "more")
    met = held.join(news, "key", "left").select(
        "request_id", "key", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value")).alias("value"), "more"
    )
    own = F.array(F.struct("key", "value"))
    entries = met.select("request_id", F.explode(F.concat(own, F.coalesce("more", F.array().cast("array<struct<key:string,value:string>>")))).alias("e"))
    rows = entries.select("request_id", "e.*").groupBy("request_id", "key").agg(F.max("value").alias("value"))
    grouped = rows.groupBy("request_id").agg(F.collect_list(F.struct("key", "value")).alias("_held"))
    return grouped.select("request_id", F.col("_held.key").alias("keys"), F.col("_held.value").alias("values"))


def replay(requests: DataFrame, machine: Machine, scale: Scale = Scale(), within: str | None = None) -> DataFrame:
    """``request_id`` and the machine's answer for every request of ``request_id, ask``.

    A batch of up to ``scale.ordered_rows`` requests is one ordered pass, and so is
    each component of that size. Where requests of different values of the field
    ``within`` of ``ask`` never share a key, the requests of a value that has up to
    so many are one ordered pass as they are; only those of larger ones are taken
    apart into components.
    """
    requests = materialise(requests, "replay")
    n_open = requests.count()
    if n_open <= scale.ordered_rows:
        return _in_order(requests.withColumn("component", F.lit(0).cast("long")), machine)
    answered, gain = [], 1.0
    if within:
        small, requests = _by_value(requests, within, scale.ordered_rows)
        answered.append(_in_order(small, machine))
        if requests is None:
            return answered[0]
        n_open = requests.count()
    # Before the first round the keys and values of a request follow from itself, so only hashes of its keys are kept.
    asks, opened = requests, None
    while n_open > scale.ordered_rows:
        touched = materialise(_hashed(_with_keys(asks, machine)), "replay-keys") if opened is None else _hashed(opened)
        labels = materialise(
            components(_links(touched), "request_id", "_first").select(F.col("node").alias("request_id"), "component"), "replay-components"
        )
        rows = asks if opened is None else opened
        named = rows.join(labels, "request_id", "left").withColumn("component", F.coalesce("component", "request_id"))
        large = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > scale.ordered_rows)
        large = materialise(large.select("component"), "replay-large")
        if gain < LEAST_GAIN or large.isEmpty():
            answered.append(_in_order(_asked(named, asks), machine))
            return _union(answered)
        answered.append(_in_order(_asked(named.join(large, "component", "left_anti"), asks), machine))
        left = named.join(large, "component", "left_semi")
        opened = materialise(_with_keys(left, machine) if opened is None else left.select("request_id", "keys", "values"), "replay-open")
        n_open = opened.count()
        for _ in range(ROUNDS_BETWEEN):
            if n_open <= scale.ordered_rows or gain < LEAST_GAIN:
                break
            done = materialise(_round(_ready(opened).join(asks, "request_id"), machine), "replay-done")
            answered.append(done.select("request_id", "_answer.*"))
            opened = materialise(_after(opened, done), "replay-open")
            left = opened.count()
            gain, n_open = (n_open - left) / n_open, left
    last = (asks if opened is None else opened).withColumn("component", F.lit(0).cast("long"))
    answered.append(_in_order(_asked(last, asks), machine))
    return _union(answered)


def _asked(rows: DataFrame, asks: DataFrame) -> DataFrame:
    return rows if "ask" in rows.columns else rows.join(asks, "request_id")


def _by_value(requests: DataFrame, within: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The requests of values with up to ``most`` requests, each value a component, and the others if there are any."""
    named = requests.withColumn("component", F.xxhash64(f"ask.{within}"))
    large = named.groupBy("component").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    large = materialise(large.select("component"), "replay-large")
    if large.isEmpty():
        return named, None
    rest = named.join(large, "component", "left_semi").select("request_id", "ask")
    return named.join(large, "component", "left_anti"), materialise(rest, "replay")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
