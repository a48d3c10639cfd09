"""Several values packed in one text field: split into one value per row, position kept.

Arrow string buffers are scanned as bytes with numpy: quote parity by a running count, delimiter masks, child offsets from
the mask, list arrays from the offsets; flattening repeats the parent's ordinal. No Python loop runs per row or value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

import termloom.session  # noqa: F401

#: Field contents that stand for "nothing listed", compared in lower case without surrounding white space.
PLACEHOLDERS = ["nan", "null", "-", "[]"]
HARD = np.frombuffer(b";|\t\n\r", dtype=np.uint8)
QUOTE, COMMA, SPACE, DOT = 34, 44, 32, 46
_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE, _ODD_SPACE = f"[{_SPACES}]+", f"  |[{_SPACES.replace(' ', '')}]"


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and row offsets (from 0) of a string array without nulls."""
    arr = arr.cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def _strings(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(raw)))


def _term_delimiters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mask of the separating bytes: outside quotes ``;``, ``|``, tab and line break, and a comma after a closing quote or
    before anything but a space. A last quote without partner is an ordinary character."""
    quote = raw == QUOTE
    running = np.concatenate([[0], np.cumsum(quote)])
    rows = off[:-1]
    odd = np.flatnonzero((running[off[1:]] - running[rows]) % 2)
    if len(odd):
        where = np.flatnonzero(quote)
        quote = quote.copy()
        quote[where[running[off[1:]][odd] - 1]] = False
        running = np.concatenate([[0], np.cumsum(quote)])
    row_base = np.repeat(running[rows], np.diff(off))
    outside = (running[:-1] - row_base) % 2 == 0
    after_quote = np.concatenate([[False], quote[:-1]])
    followed = np.concatenate([raw[1:] == SPACE, [False]])
    starts, ends = rows[rows < len(raw)], off[1:][off[1:] > 0]
    after_quote[starts] = False
    followed[ends - 1] = False
    comma = (raw == COMMA) & (after_quote | ~followed)
    return outside & ~quote & (np.isin(raw, HARD) | comma)


def _unquoted(values: pa.Array) -> pa.Array:
    values = pc.utf8_trim_whitespace(values)
    mask = pc.and_(pc.and_(pc.starts_with(values, '"'), pc.ends_with(values, '"')), pc.greater(pc.binary_length(values), 1))
    if not pc.any(mask).as_py():
        return values
    inner = pc.replace_substring_regex(values, r'(?s)^"(.*)"$', r"\1")
    whole = pc.invert(pc.match_substring(pc.replace_substring(inner, '""', ""), '"'))
    inner = pc.utf8_trim_whitespace(pc.replace_substring(inner, '""', '"'))
    return pc.if_else(pc.and_(mask, whole), inner, values)


def _split_terms(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    raw, off = _bytes(arr)
    at = np.flatnonzero(_term_delimiters(raw, off))
    counts = np.searchsorted(at, off[1:]) - np.searchsorted(at, off[:-1]) + 1
    starts = np.sort(np.concatenate([off[:-1], at + 1]))
    shift = np.searchsorted(at, starts)
    kept = np.ones(len(raw), bool)
    kept[at] = False
    child = np.concatenate([starts - shift, [len(raw) - len(at)]])
    return np.repeat(np.arange(len(arr)), counts), _unquoted(_strings(raw[kept], child))


def _split_numbers(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of digits, whatever stands between them; a fraction (digits, dot, digits) belongs to the number before it."""
    raw, off = _bytes(arr)
    digit = (raw >= 48) & (raw <= 57)
    first = digit & ~np.concatenate([[False], digit[:-1]])
    edge = off[:-1][np.diff(off) > 0]
    first[edge] = digit[edge]
    starts = np.flatnonzero(first)
    last = digit & ~np.concatenate([digit[1:], [False]])
    tail = off[1:][np.diff(off) > 0] - 1
    last[tail] = digit[tail]
    ends = np.flatnonzero(last) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    before = starts - 1
    fraction = (before > off[row]) & (raw[np.maximum(before, 0)] == DOT) & digit[np.maximum(before - 1, 0)]
    starts, ends, row = starts[~fraction], ends[~fraction], row[~fraction]
    lengths = ends - starts
    child = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(starts - child[:-1], lengths) + np.arange(child[-1])
    return row, _strings(raw[index], child)


def headings(values: pa.Array) -> pa.Array:
    """The headings of tokens, as ``functions.terms.heading_of`` has them, for whole arrays; tokens without one give ''."""
    before = pc.replace_substring_regex(values, r"(?s)/.*$", "")
    if pc.any(odd := pc.match_substring_regex(before, _ODD_SPACE)).as_py():
        before = pc.if_else(odd, pc.replace_substring_regex(before, _SPACE, " "), before)
    bare = pc.utf8_trim(pc.utf8_ltrim(pc.utf8_trim(before, " "), "*"), " ")
    return pc.utf8_lower(bare)


def _split_headings(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    parent, values = _split_terms(arr)
    return parent, headings(values)


SPLITTERS = {"terms": _split_terms, "headings": _split_headings, "numbers": _split_numbers}


def split_array(arr: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent row, position from 1, value) of every value in a string array; null fields give none."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    alone = pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(arr)), value_set=pa.array(PLACEHOLDERS, arr.type))
    rows = np.flatnonzero(pc.and_(pc.is_valid(arr), pc.invert(alone)).to_numpy(zero_copy_only=False))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int32), pa.array([], pa.large_string())
    parent, values = SPLITTERS[kind](arr.take(pa.array(rows)))
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    parent, values = rows[parent[full]], values.filter(pa.array(full))
    begins = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.empty(0, bool)
    at = np.arange(len(parent))
    pos = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
    return parent, pos.astype(np.int32), values


def explode_packed(df: DataFrame, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per packed value: the ``keys``, ``field_name``, ``pos`` (int from 1) and ``val``.

    ``fields`` maps column names to ``"terms"`` (quoted headings), ``"headings"`` (the same, brought to their plain form) or
    ``"numbers"`` (citation lists). Null, empty and
    placeholder fields give no row; repeated rows and repeated values stay. Other columns are not read, so extra columns
    never clash. The keys must not be named ``field_name``, ``pos`` or ``val``. Map-only: no shuffle, no state.
    """
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField("field_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind in fields.items():
                parent, pos, values = split_array(batch.column(batch.schema.get_field_index(name)), kind)
                if not len(parent):
                    continue
                index = pa.array(parent)
                cols = [batch.column(i).take(index) for i in range(len(keys))]
                cols += [pa.repeat(pa.scalar(name), len(parent)), pa.array(pos), values.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "field_name", "pos", "val"])

    return df.select(*keys, *[f for f in fields if f not in keys]).mapInArrow(run, out)


def packed_lists(df: DataFrame, field: str, kind: str, keys: list[str], name: str = "vals") -> DataFrame:
    """The ``keys`` and one ``array<string>`` of the values of ``field`` per row, rows kept one to one.

    A null field gives null, a field without value an empty list.
    """
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = batch.column(batch.schema.get_field_index(field))
            parent, _, values = split_array(arr, kind)
            counts = np.bincount(parent, minlength=len(arr)).astype(np.int64) if len(parent) else np.zeros(len(arr), np.int64)
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), values.cast(pa.string()))
            lists = pc.if_else(pc.is_valid(arr), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [lists], names=[*keys, name])

    return df.select(*keys, *([] if field in keys else [field])).mapInArrow(run, out)
