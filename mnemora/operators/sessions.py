"""Sessions from a Cartesian tree over the gaps between an entity's consecutive events.

The tree of one entity has a leaf for each distinct time and, for each gap value, the widest stretch
of events whose inner gaps are no larger. A node keeps the largest gap inside it (`gap_us`, 0 for a
leaf) and the smaller of the two gaps around it (`parent_gap_us`, null at the root). Cutting at a
threshold T is then the filter `gap_us <= T and (parent_gap_us is null or parent_gap_us > T)`: one
stored tree serves any number of thresholds. Equal gaps share one node, so the tree is n-ary.

The events are range-partitioned by (entity, time): a chunk is a contiguous stretch, and an entity of
any size spreads over as many chunks as it needs (CHUNK_EVENTS each). In a chunk, each gap's nearest larger gap on either
side bounds its node. Only gaps larger than all before them, or all behind them, in their chunk can
reach beyond it; these few records per chunk-edge entity are merged level by level, at most
FAN_IN chunks in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import materialize, shuffle_partitions

#: Chunks merged by one task.
FAN_IN = 64
#: Events of a chunk, about; a task holds some 100 bytes of each.
CHUNK_EVENTS = 2_000_000

NODE_COLUMNS = ("start_us", "end_us", "n_rows", "weight", "gap_us", "parent_gap_us")
_INF = np.iinfo(np.int64).max
_RECORD = ("gap", "before", "after", "pos", "wpos")
_SCHEMA = (
    "entity string, chunk bigint, start_us bigint, end_us bigint, n_rows bigint, weight bigint, gap_us bigint, "
    "parent_gap_us bigint, gap array<bigint>, before array<bigint>, after array<bigint>, pos array<bigint>, wpos array<bigint>"
)
_ARROW = pa.schema(
    [("entity", pa.string()), *((c, pa.int64()) for c in ("chunk", *NODE_COLUMNS)), *((c, pa.list_(pa.int64())) for c in _RECORD)]
)


def epoch_micros(t: str | Column, day: str | Column | None = None) -> Column:
    """Microseconds since the epoch from a double in seconds or milliseconds.

    `day`, the epoch day, decides the unit where it is set and fits one of them; otherwise values of
    1e11 and more are milliseconds (as seconds they would lie beyond the year 5000). Null, NaN and
    infinite times give null, and so do those of 1e15 and more, which lie beyond any date (3e4 years in milliseconds).
    """
    t = F.col(t) if isinstance(t, str) else t
    millis = F.abs(t) >= 1e11
    if day is not None:
        day = F.col(day) if isinstance(day, str) else day
        millis = F.when(F.floor(t / 86400) == day, F.lit(False)).when(F.floor(t / 86400000) == day, F.lit(True)).otherwise(millis)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 1e15)
    return F.when(finite, F.round(F.when(millis, t * 1e3).otherwise(t * 1e6)).cast("bigint"))


def nearest_larger(g: np.ndarray, strict: bool = True) -> np.ndarray:
    """For each position the nearest earlier one with a larger (or, not strict, no smaller) value; -1 if none.

    Pointer jumping over whole arrays; what is unresolved after a fixed number of rounds goes through one stack pass.
    """
    n = len(g)
    left = np.arange(n, dtype=np.int64) - 1
    active = left[1:] + 1 if n > 1 else np.empty(0, np.int64)
    for _ in range(48):
        c = left[active]
        ok = c >= 0
        seen = g[np.where(ok, c, 0)]
        low = seen <= g[active] if strict else seen < g[active]
        active = active[ok & low]
        if not active.size:
            return left
        left[active] = left[left[active]]
    values, stack = g.tolist(), []
    out = np.empty(n, np.int64)
    for i, v in enumerate(values):
        while stack and (values[stack[-1]] <= v if strict else values[stack[-1]] < v):
            stack.pop()
        out[i] = stack[-1] if stack else -1
        stack.append(i)
    return out


def _nodes_of(rec: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sequence of gap records: left and right bounds, and which record speaks for its node (the first of equal ones)."""
    g = rec["gap"]
    left = nearest_larger(g)
    right = len(g) - 1 - nearest_larger(g[::-1])[::-1]
    first = nearest_larger(g, strict=False) == left
    return left, right, first


def _emit(rec: dict[str, np.ndarray], l: np.ndarray, r: np.ndarray, gap: np.ndarray) -> dict[str, np.ndarray]:  # noqa: E741
    parent = np.minimum(rec["gap"][l], rec["gap"][r])
    return {
        "start_us": rec["after"][l], "end_us": rec["before"][r], "n_rows": rec["pos"][r] - rec["pos"][l],
        "weight": rec["wpos"][r] - rec["wpos"][l], "gap_us": gap, "parent_gap_us": parent,
    }


def _kept(gap: np.ndarray, parent: np.ndarray, cuts: np.ndarray | None) -> np.ndarray:
    """Nodes that some cut returns; all without cuts."""
    if cuts is None:
        return np.ones(len(gap), bool)
    i = np.searchsorted(cuts, gap)  # the least cut that is no smaller
    return (i < len(cuts)) & (np.append(cuts, _INF)[i] < parent)


def _node_batch(entity: pa.Array, nodes: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(nodes["gap_us"])
    parent = nodes["parent_gap_us"]
    columns = {c: pa.array(nodes[c], pa.int64()) for c in NODE_COLUMNS}
    columns["parent_gap_us"] = pa.array(parent, pa.int64(), mask=parent == _INF)
    return pa.RecordBatch.from_arrays(
        [entity, pa.nulls(n, pa.int64()), *(columns[c] for c in NODE_COLUMNS), *(pa.nulls(n, pa.list_(pa.int64())) for _ in _RECORD)], schema=_ARROW
    )


def _edge_row(entity: str, chunk: int, first: int, last: int, n: int, w: int, rec: dict[str, np.ndarray]) -> dict:
    """Summary of a stretch: only the gaps larger than all before them or all behind them."""
    g = rec["gap"]
    keep = np.zeros(len(g), bool)
    if len(g):
        keep[0] = keep[-1] = True
        keep[1:] |= g[1:] > np.maximum.accumulate(g)[:-1]
        keep[:-1] |= g[:-1] > np.maximum.accumulate(g[::-1])[::-1][1:]
    return {"entity": entity, "chunk": chunk, "start_us": first, "end_us": last, "n_rows": n, "weight": w, "gap_us": None, "parent_gap_us": None} | {
        c: rec[c][keep].tolist() for c in _RECORD
    }


def _chunk_trees(cuts: np.ndarray | None):
    """Trees of one sorted chunk. Entities at the chunk's ends stay open and go on as summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        names: list[str] = []
        parts: list[tuple[np.ndarray, ...]] = []
        last_name, last_us = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ent, us = b.column(0).cast(pa.string()), b.column(1).to_numpy(zero_copy_only=False)
            w = b.column(2).to_numpy(zero_copy_only=False)
            new = np.ones(len(us), bool)
            new[1:] = pc.not_equal(ent.slice(1), ent.slice(0, len(ent) - 1)).to_numpy(zero_copy_only=False)
            new[0] = ent[0].as_py() != last_name
            diff = new.copy()
            diff[1:] |= us[1:] != us[:-1]
            diff[0] |= us[0] != last_us
            if not diff[0]:  # goes on with the last batch's last point
                end = int(np.argmax(diff)) if diff.any() else len(us)
                parts[-1][2][-1] += end
                parts[-1][3][-1] += w[:end].sum()
            at = np.flatnonzero(diff)
            if len(at):
                names += ent.take(pa.array(np.flatnonzero(new))).to_pylist()
                tail = np.append(at[1:], len(us))
                sums = np.add.reduceat(w, at)
                parts.append((us[at], new[at], tail - at, sums))
            last_name, last_us = ent[len(ent) - 1].as_py(), us[-1]
        if not parts:
            return
        us, new, cnt, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        n = len(us)
        run_of = np.cumsum(new) - 1
        gap = np.full(n + 1, _INF, np.int64)
        gap[1:n] = np.where(new[1:], _INF, us[1:] - us[:-1])
        rec = {
            "gap": gap, "before": np.concatenate((us[:1], us)), "after": np.concatenate((us, us[-1:])),
            "pos": np.concatenate(([0], np.cumsum(cnt))), "wpos": np.concatenate(([0], np.cumsum(w))),
        }
        starts = np.flatnonzero(new)
        last_run = len(starts) - 1
        # summaries of the first and the last entity
        edges = []
        for k in {0, last_run}:
            lo, hi = starts[k], (starts[k + 1] if k < last_run else n)
            inner = {c: v[lo + 1 : hi] for c, v in rec.items()}
            inner = inner | {"pos": inner["pos"] - rec["pos"][lo], "wpos": inner["wpos"] - rec["wpos"][lo]}
            edges.append(_edge_row(names[k], chunk, int(us[lo]), int(us[hi - 1]), int(rec["pos"][hi] - rec["pos"][lo]), int(rec["wpos"][hi] - rec["wpos"][lo]), inner))
        yield pa.RecordBatch.from_pylist(edges, schema=_ARROW)
        # nodes; in open entities only those with both bounds inside the chunk
        edge_lo, edge_hi = starts[1] if last_run else n, starts[last_run]
        left, right, first = _nodes_of(rec)

        def closed(l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
            inside = (gap[l] != _INF) & (gap[r] != _INF)
            whole = (l >= edge_lo) & (r <= edge_hi) if last_run else np.zeros(len(l), bool)
            return inside | whole

        inner = np.flatnonzero(first & (gap != _INF))
        inner = inner[closed(left[inner], right[inner])]
        leaf = np.arange(n)
        leaf = leaf[closed(leaf, leaf + 1)]
        ent_names = pa.array(names, pa.string())
        for l, r, value in ((left[inner], right[inner], gap[inner]), (leaf, leaf + 1, np.zeros(len(leaf), np.int64))):  # noqa: E741
            for lo in range(0, len(l), 65536):
                s = slice(lo, lo + 65536)
                nodes = _emit(rec, l[s], r[s], value[s])
                k = _kept(nodes["gap_us"], nodes["parent_gap_us"], cuts)
                if k.any():
                    yield _node_batch(ent_names.take(pa.array(run_of[l[s]][k])), {c: v[k] for c, v in nodes.items()})

    return run


def _merge(cuts: np.ndarray | None, final: bool):
    """Join the summaries of neighbouring chunks of one entity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        entity = pdf["entity"].iloc[0]
        seq: dict[str, list[np.ndarray]] = {c: [] for c in _RECORD}
        bridge: list[np.ndarray] = []
        pos = wpos = 0
        last = None

        def put(new: bool, **cols: np.ndarray) -> None:
            for c in _RECORD:
                seq[c].append(np.asarray(cols[c], np.int64))
            bridge.append(np.full(len(cols["gap"]), new))

        rows = list(pdf.itertuples(index=False))
        one = lambda x: np.array([x], np.int64)
        first = int(rows[0].start_us)
        if final:
            put(True, gap=one(_INF), before=one(first), after=one(first), pos=one(0), wpos=one(0))
        for row in rows:
            if last is not None:
                put(True, gap=one(row.start_us - last), before=one(last), after=one(row.start_us), pos=one(pos), wpos=one(wpos))
            put(False, gap=row.gap, before=row.before, after=row.after, pos=np.asarray(row.pos, np.int64) + pos, wpos=np.asarray(row.wpos, np.int64) + wpos)
            pos, wpos, last = pos + int(row.n_rows), wpos + int(row.weight), int(row.end_us)
        if final:
            put(True, gap=one(_INF), before=one(last), after=one(last), pos=one(pos), wpos=one(wpos))
        rec = {c: np.concatenate(v) for c, v in seq.items()}
        at_bridge = np.concatenate(bridge)
        left, right, speaks = _nodes_of(rec)
        n = len(rec["gap"])
        inner = np.flatnonzero(speaks & (left >= 0) & (right < n) & (rec["gap"] != _INF))
        leaf = np.flatnonzero(at_bridge[:-1] | at_bridge[1:]) if n > 1 else np.empty(0, np.int64)
        out = []
        for l, r, value in ((left[inner], right[inner], rec["gap"][inner]), (leaf, leaf + 1, np.zeros(len(leaf), np.int64))):  # noqa: E741
            nodes = pd.DataFrame(_emit(rec, l, r, value))
            nodes = nodes[_kept(nodes["gap_us"].to_numpy(), nodes["parent_gap_us"].to_numpy(), cuts)]
            nodes["parent_gap_us"] = nodes["parent_gap_us"].astype("Int64").mask(nodes["parent_gap_us"] == _INF)
            out.append(nodes)
        frame = pd.concat(out, ignore_index=True)
        for c in ("chunk", *_RECORD):
            frame[c] = None
        frame["entity"] = entity
        if not final:
            edge = _edge_row(entity, int(rows[0].chunk), first, last, pos, wpos, rec)
            frame = pd.concat([frame.astype(object), pd.DataFrame([edge], dtype=object)], ignore_index=True)
        for c in NODE_COLUMNS + ("chunk",):
            frame[c] = frame[c].astype("Int64")
        return frame[["entity", "chunk", *NODE_COLUMNS, *_RECORD]]

    return run


def _build(events: DataFrame, entity: str, micros: str, weight: str | None, cuts: Sequence[int] | None) -> DataFrame:
    spark = events.sparkSession
    limit = np.array(sorted(set(cuts)), np.int64) if cuts is not None else None
    kind = dict(events.dtypes)[entity]
    rows = events.select(
        F.col(entity).cast("string").alias("entity"), F.col(micros).cast("bigint").alias("us"),
        (F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)).cast("bigint").alias("w"),
    ).where("entity is not null and us is not null")
    rows = materialize(rows, "events")  # the ranges are found by sampling, which would run all before it twice
    chunks = max(shuffle_partitions(spark), -(-rows.count() // CHUNK_EVENTS))
    ordered = rows.repartitionByRange(chunks, "entity", "us").sortWithinPartitions("entity", "us")
    level = materialize(ordered.mapInArrow(_chunk_trees(limit), _SCHEMA), "gap-tree")
    nodes = [level.where("chunk is null")]
    width = 1
    while True:
        width *= FAN_IN
        final = width >= chunks
        merged = level.where("chunk is not null").groupBy("entity", F.expr(f"chunk div {width}")).applyInPandas(_merge(limit, final), _SCHEMA)
        if final:
            nodes.append(merged)
            break
        level = materialize(merged, "gap-tree-level")
        nodes.append(level.where("chunk is null"))
    tree = nodes[0]
    for part in nodes[1:]:
        tree = tree.unionByName(part)
    return tree.select(F.col("entity").cast(kind).alias(entity), *NODE_COLUMNS)


def gap_tree(events: DataFrame, entity: str, micros: str, weight: str | None = None) -> DataFrame:
    """The whole tree of every entity, at most two rows per event.

    Columns: the entity, `start_us`, `end_us`, `n_rows`, `weight` (sum of `weight`, null counting 0; without
    a weight column the same as n_rows), `gap_us`, `parent_gap_us`.

    Rows with a null entity or time are left out. Events at one time form one leaf that counts them all, so
    repeated rows count; take duplicates out first if they must not. An empty table gives an empty tree.
    Other columns of `events` are not read, whatever their names.
    """
    return _build(events, entity, micros, weight, None)


def cut(tree: DataFrame, gap_us: int | Sequence[int]) -> DataFrame:
    """Sessions of a stored tree at one threshold, or at several (then with the column `gap_limit_us`).

    A new session begins where the time since the previous event is more than the threshold.
    """
    if isinstance(gap_us, int):
        return tree.where((F.col("gap_us") <= gap_us) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > gap_us))).drop("gap_us", "parent_gap_us")
    limits = F.array(*(F.lit(int(g)).cast("bigint") for g in sorted(set(gap_us))))
    hit = F.filter(limits, lambda g: (F.col("gap_us") <= g) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > g)))
    return tree.withColumn("gap_limit_us", F.explode(hit)).drop("gap_us", "parent_gap_us")


def sessions(events: DataFrame, entity: str, micros: str, gap_us: int | Sequence[int], weight: str | None = None) -> DataFrame:
    """Sessions of every entity: its tree cut at the threshold(s) while it is built, so that only session rows are written.

    Columns: the entity, `start_us`, `end_us`, `n_rows`, `weight`, and `gap_limit_us` for several thresholds.
    Null, tie, repetition and empty-table rules are those of `gap_tree`; a threshold below 0 is refused.
    """
    limits = [gap_us] if isinstance(gap_us, int) else list(gap_us)
    if not limits or min(limits) < 0:
        raise ValueError("a gap threshold must be 0 or more")
    return cut(_build(events, entity, micros, weight, limits), gap_us)
