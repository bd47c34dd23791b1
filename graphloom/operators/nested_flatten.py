"""Problem 3: deeply nested records as flat child rows, by kernels over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text_json import instant, variant

#: Child arrays of each record table by name; under "[]" those of the root array's elements.
Spec = Mapping[str, "Spec"]
PROJECT_RUNS: Spec = {"modules": {"types": {"methods": {}}}, "findings": {"trace": {"evidence": {}}}}
ANALYSIS_RUNS: Spec = {"[]": {"scopes": {}}}
CONVERSATION_TURNS: Spec = {"[]": {"subjects": {}}}

_OUT = "record_table string, record_id bigint, record_position int, item_path string, parent_path string"
_QUOTE, _BACKSLASH, _COLON, _COMMA, _OBJECT, _ARRAY = (ord(c) for c in '"\\:,{[')
_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in "{["]] = 1
_KIND[[ord(c) for c in "}]"]] = -1
_KIND[[_COLON, _COMMA]] = 2


class Structure:
    """List offsets, parent indices and keys of all containers in a column of compact JSON texts.

    The texts are never parsed row by row: quotes, brackets, commas and colons of the whole buffer are located at
    once, and every relation between them comes from sorted searches over their positions.
    """

    def __init__(self, texts: pa.Array) -> None:
        buffers = texts.buffers()
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.quotes = self._quotes()
        inside = np.zeros(len(self.data), np.uint8)
        inside[self.quotes] = 1
        outside = (np.cumsum(inside, dtype=np.uint8) & 1) == 0
        self.marks = np.flatnonzero((_KIND[self.data] != 0) & outside)
        kind = _KIND[self.data[self.marks]]
        depth = np.cumsum(np.where(kind == 2, 0, kind))
        self.open = np.flatnonzero(kind == 1)
        self.byte = self.data[self.marks[self.open]]
        self.depth = depth[self.open]
        self.row = np.searchsorted(self.offsets, self.marks[self.open], "right") - 1
        comma = np.flatnonzero(self.data[self.marks] == _COMMA)
        self.commas = {d: comma[depth[comma] == d] for d in np.unique(depth[comma])}
        self.parent = np.full(len(self.open), -1)
        levels = {d: np.flatnonzero(self.depth == d) for d in np.unique(self.depth)}
        for d, own in levels.items():
            if d > 1:
                above = levels[d - 1]
                self.parent[own] = above[np.searchsorted(self.open[above], self.open[own]) - 1]
        self.in_array = (self.parent >= 0) & (self.byte[self.parent] == _ARRAY)
        self.is_object = self.byte == _OBJECT

    def _quotes(self) -> np.ndarray:
        quotes = np.flatnonzero(self.data == _QUOTE)
        if not len(quotes):
            return quotes
        run = np.zeros(len(quotes), np.int64)
        active = np.flatnonzero((quotes > 0) & (self.data[quotes - 1] == _BACKSLASH))
        while len(active):
            run[active] += 1
            back = quotes[active] - run[active] - 1
            active = active[(back >= 0) & (self.data[np.maximum(back, 0)] == _BACKSLASH)]
        return quotes[run % 2 == 0]

    def keyed(self, name: str) -> np.ndarray:
        """Containers that are the value of a member called ``name``."""
        held = np.flatnonzero((self.parent >= 0) & ~self.in_array)
        end = np.searchsorted(self.quotes, self.marks[self.open[held] - 1]) - 1
        first, last = self.quotes[end - 1] + 1, self.quotes[end]
        wanted = np.frombuffer(name.encode(), np.uint8)
        fits = last - first == len(wanted)
        held, first = held[fits], first[fits]
        return held[(self.data[first[:, None] + np.arange(len(wanted))] == wanted).all(axis=1)] if len(held) else held

    def places(self, at: np.ndarray, container: np.ndarray) -> np.ndarray:
        """The index of what begins at mark ``at`` within its array: the array's commas before it."""
        found = np.zeros(len(at), np.int64)
        for d in np.unique(self.depth[container]):
            own = self.depth[container] == d
            commas = self.commas.get(d, np.zeros(0, np.int64))
            found[own] = np.searchsorted(commas, at[own]) - np.searchsorted(commas, self.open[container[own]])
        return found

    def elements(self, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Object elements of ``containers`` (a lone object is its own element): element, slot in ``containers``, index."""
        slot = np.full(len(self.open) + 1, -1)
        slot[containers] = np.arange(len(containers))
        lone = containers[self.is_object[containers]]
        inner = np.flatnonzero(self.is_object & self.in_array)
        inner = inner[slot[self.parent[inner]] >= 0]
        found = np.concatenate([lone, inner])
        holder = np.concatenate([lone, self.parent[inner]])
        index = np.concatenate([np.zeros(len(lone), np.int64), self.places(self.open[inner], self.parent[inner])])
        return found, slot[holder], index

    def strings(self, arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String elements of root ``arrays``: array and index."""
        comma = self.commas.get(1, np.zeros(0, np.int64))
        roots = np.flatnonzero(self.depth == 1)
        owner = roots[np.searchsorted(self.open[roots], comma) - 1] if len(comma) else comma
        at, holder = np.concatenate([self.open[arrays], comma]), np.concatenate([arrays, owner])
        after = self.marks[at] + 1
        keep = np.isin(holder, arrays) & (self.data[np.minimum(after, len(self.data) - 1)] == _QUOTE)
        at, holder = at[keep], holder[keep]
        return holder, self.places(at + 1, holder)


def _paths(stem: pa.Array, name: str, index: np.ndarray) -> pa.Array:
    number = pc.cast(pa.array(index), pa.string())
    lead = pc.if_else(pc.equal(stem, ""), name, f".{name}") if name else pa.scalar("")
    return pc.binary_join_element_wise(stem, lead, "[", number, "]", "")


def flatten_texts(texts: pa.Array, spec: Spec) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows of all child arrays that ``spec`` names: row number in ``texts``, own path, parent's path.

    ``texts`` holds compact JSON without nulls. Only object elements of named arrays come out, and for a root array
    its string elements too; nulls and other elements keep their places.
    """
    structure = Structure(texts)
    rows: list[np.ndarray] = []
    paths: list[pa.Array] = []
    parents: list[pa.Array] = []

    def emit(row: np.ndarray, path: pa.Array, parent: pa.Array) -> None:
        rows.append(row)
        paths.append(path)
        parents.append(parent)

    def descend(objects: np.ndarray, path: pa.Array, below: Spec) -> None:
        slot = np.full(len(structure.open) + 1, -1)
        slot[objects] = np.arange(len(objects))
        for name, deeper in below.items():
            values = structure.keyed(name)
            values = values[slot[structure.parent[values]] >= 0]
            found, holder, index = structure.elements(values)
            stem = path.take(pa.array(slot[structure.parent[values[holder]]]))
            own = _paths(stem, name, index)
            emit(structure.row[found], own, stem)
            if deeper and len(found):
                descend(found, own, deeper)

    roots = np.flatnonzero(structure.depth == 1)
    if "[]" in spec:
        found, holder, index = structure.elements(roots)
        empty = pa.array([""] * len(found), pa.string())
        own = _paths(empty, "", index)
        emit(structure.row[found], own, empty)
        if len(found):
            descend(found, own, spec["[]"])
        holder, index = structure.strings(roots[~structure.is_object[roots]])
        empty = pa.array([""] * len(holder), pa.string())
        emit(structure.row[holder], _paths(empty, "", index), empty)
    else:
        objects = roots[structure.is_object[roots]]
        descend(objects, pa.array([""] * len(objects), pa.string()), spec)
    return np.concatenate(rows), pa.concat_arrays(paths), pa.concat_arrays(parents)


#: Bytes of text whose structure is held at once; a longer text is taken alone.
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (start, length) of ``texts`` of about ``size`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop - start
        start, before = stop, int(ends[stop - 1])


def _batches(spec: Spec):
    names = [part.split()[0] for part in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("text")))
            for start, length in slices(batch.column("text")):
                part = batch.slice(start, length)
                row, path, parent = flatten_texts(part.column("text"), spec)
                keys = [part.column(n).take(pa.array(row)) for n in names[:3]]
                yield pa.RecordBatch.from_arrays([*keys, path, parent], names)

    return run


def flatten(records: DataFrame, spec: Spec) -> DataFrame:
    """Child rows of ``records(record_table, record_id, record_position, value)``, ``value`` a JSON text.

    Columns ``record_table, record_id, record_position, item_path, parent_path``. The JVM checks each text and
    rewrites it compactly; unreadable and null texts give no rows.
    """
    compact = records.select("record_table", "record_id", "record_position", F.to_json(variant(F.col("value"))).alias("text"))
    return compact.mapInArrow(_batches(spec), _OUT)  # nulls are left out there: a filter here would have each text read twice


def _held(df: DataFrame, name: str, key: list, position, order, value: str) -> DataFrame:
    held = df.groupBy(*key).agg(F.max(F.struct(order.alias("order"), F.col(value).alias("value"))).alias("row"))
    return held.select(F.lit(name).alias("record_table"), F.col(key[0]).alias("record_id"), position.cast("int").alias("record_position"), F.col("row.value").alias("value"))


def nested_items(project_runs: DataFrame, analysis_runs: DataFrame, conversation_turns: DataFrame) -> DataFrame:
    """All child rows of the three tables, from the rows that hold.

    Of ``project_runs`` the latest ``received_at`` per (analysis_run_id, position) holds, of ``conversation_turns``
    the latest ``updated_at`` per id, of ``analysis_runs`` the latest ``received_at`` per id; at a tie the greatest text.
    """
    parts = (
        (_held(project_runs, "project_runs", ["analysis_run_id", "position"], F.col("position"), F.col("received_at"), "value_json"), PROJECT_RUNS),
        (_held(analysis_runs, "analysis_runs", ["id"], F.lit(-1), F.col("received_at"), "requested_json"), ANALYSIS_RUNS),
        (_held(conversation_turns, "conversation_turns", ["id"], F.lit(-1), instant(F.col("updated_at")), "limitations_json"), CONVERSATION_TURNS),
    )
    flat = [flatten(records, spec) for records, spec in parts]
    return flat[0].unionByName(flat[1]).unionByName(flat[2])
