"""Linked samples as mergeable forests: what a task has joined is passed on as a spanning forest, which others join again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Samples of open forests in a task, beyond which these are passed on as they are.
OPEN = 1 << 20


def _root(up: dict[int, int], a: int) -> int:
    while up.setdefault(a, a) != a:
        up[a] = up.setdefault(up[a], up[a])
        a = up[a]
    return a


def _join(up: dict[int, int], linked: list[int]) -> None:
    first = _root(up, linked[0])
    for b in linked[1:]:
        other = _root(up, b)
        if other != first:
            first, other = min(first, other), max(first, other)
            up[other] = first


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, set) with any sets of samples to sets that link the same: a root and one sample, or a root alone."""
    trees: dict = {}
    held, schema = 0, None

    def rows():
        found = [(entity, sorted({_root(up, a), a})) for entity, up in trees.items() for a in list(up)]
        return pa.record_batch([pa.array([f[0] for f in found], schema.field(0).type), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["entity", "set"])

    for batch in batches:
        schema = batch.schema
        for entity, linked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up = trees.setdefault(entity, {})
            before = len(up)
            _join(up, linked)
            held += len(up) - before
            if held > OPEN:
                yield rows()
                trees, held = {}, 0
    if trees:
        yield rows()


def labels(width: int):
    """Sorted (entity, set) to the component of each of `width` samples, numbered from 0 by its first sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, up, schema, started = None, {}, None, False

        def rows():
            number: dict[int, int] = {}
            own = [number.setdefault(_root(up, s), len(number)) for s in range(width)]
            return pa.record_batch([pa.array([entity] * width, schema.field(0).type), pa.array(range(width), pa.int32()), pa.array(own, pa.int32())], ["entity", "at", "component"])

        for batch in batches:
            schema = batch.schema
            for name, linked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and name != entity:
                    yield rows()
                    up = {}
                entity, started = name, True
                _join(up, linked)
        if started:
            yield rows()

    return run
