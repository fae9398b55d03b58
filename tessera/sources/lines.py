"""Problem 4: load raw ``SQL<TAB>db_id`` lines, keeping the rows that fail apart with their reason.

A block of lines is parsed as a whole on a columnar path: one regular expression over the Arrow column marks the lines that
are plainly sound, one Arrow CSV parse splits these into two columns, one membership test checks the databases.  A block
without a mark against it is loaded at once, a block with one is bisected until the bad records stand alone.  Only these go
to the strict scanner, which either loads the line (the columnar path is stricter than the format) or names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # lines parsed at once
MOST_NAMES = 100_000  # databases that a line may name

QUOTED = r"""'[^']*'|"[^"]*"|`[^`]*`"""
CLOSED = re.compile(rf"""(?:[^'"`]|{QUOTED})*""", re.S)
FIELD = re.compile(rf"""(?:[^\t'"`]|{QUOTED})*""", re.S)
FIRST_WORD = re.compile(r"(?:select|with)(?![A-Za-z0-9_])", re.I)
CONTROL = re.compile("[\x00-\x08\x0a-\x0c\x0e-\x1f�]")
TRIM = " \r"

#: What the columnar path accepts: no control characters, closed quotes of all three kinds, the first word in place, one tab.
_BAD = r"\x00-\x1f\x{FFFD}"
_CLOSED = rf"""'[^'{_BAD}]*'|"[^"{_BAD}]*"|`[^`{_BAD}]*`"""
CLEAN_LINE = rf"""^ *(?i:select|with)(?:[^A-Za-z0-9_'"`{_BAD}]|{_CLOSED})(?:[^'"`{_BAD}]|{_CLOSED})*\t[^'"`{_BAD}]+\r?$"""


def diagnose(line: str | None, allowed: frozenset[str]) -> tuple[str | None, str | None, str | None]:
    """(reason, sql, db_id) of one line by the strict rules; reason is None for a sound line.  A null line has no columns."""
    if line is None:
        return "column_count", None, None
    if CLOSED.fullmatch(line) is None:
        return "broken_quoting", None, None
    fields, at = [], 0
    while True:
        m = FIELD.match(line, at)
        fields.append(m.group())
        if m.end() >= len(line):
            break
        at = m.end() + 1
    if len(fields) != 2:
        return "column_count", None, None
    sql, db = fields[0].strip(TRIM), fields[1].strip(TRIM)
    if not FIRST_WORD.match(sql) or db not in allowed or CONTROL.search(line):
        return "invalid_value", None, None
    return None, sql, db


def _columns(lines: pa.Array) -> tuple[pa.Array, pa.Array] | None:
    """Both columns of lines that are plainly sound, by one CSV parse; None if it does not keep to one row a line."""
    listed = pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines.cast(pa.large_string()))
    text = pc.binary_join(listed, pa.scalar("\n", pa.large_string()))[0].as_buffer()
    try:
        got = pcsv.read_csv(
            pa.BufferReader(text),
            read_options=pcsv.ReadOptions(column_names=["sql", "db"], use_threads=False, block_size=text.size + 1),
            parse_options=pcsv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={"sql": pa.string(), "db": pa.string()}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows != len(lines):
        return None
    sql, db = (pc.utf8_trim(got.column(i).combine_chunks(), characters=TRIM) for i in range(2))
    return sql, db


def bisect(sound: pa.Array) -> tuple[list[tuple[int, int]], list[int]]:
    """The runs of a block without a mark against them, and the records that stand alone with one."""
    runs, bad, todo = [], [], [(0, len(sound))] if len(sound) else []
    while todo:
        lo, hi = todo.pop()
        if pc.all(sound.slice(lo, hi - lo)).as_py():
            runs.append((lo, hi))
        elif hi - lo == 1:
            bad.append(lo)
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return runs, bad


def parse_block(ids: pa.Array, lines: pa.Array, allowed: frozenset[str], column: pa.Array, tally: list[int] | None = None) -> list[pa.RecordBatch]:
    """(line_id, sql, db_id, reason) batches: the lines of the columnar path, then those that bisection left alone.

    ``tally`` gets the number of lines loaded by the columnar path and of those given to the scanner added to it.
    """
    names = ["line_id", "sql", "db_id", "reason"]
    runs, odd = bisect(pc.fill_null(pc.match_substring_regex(lines, CLEAN_LINE), False))
    done = []
    if runs:
        at = pa.chunked_array([pa.array(range(lo, hi), pa.int64()) for lo, hi in runs]).combine_chunks()
        got = _columns(lines.take(at))
        if got is None:
            odd += at.to_pylist()
        else:
            known, unknown = bisect(pc.is_in(got[1], value_set=column))
            if unknown:
                odd += at.take(pa.array(unknown)).to_pylist()
                keep = pa.chunked_array([pa.array(range(lo, hi), pa.int64()) for lo, hi in known], pa.int64()).combine_chunks()
                at, got = at.take(keep), (got[0].take(keep), got[1].take(keep))
            if len(at):
                done.append(pa.RecordBatch.from_arrays([ids.take(at), *got, pa.nulls(len(at), pa.string())], names))
    if odd:
        found = [diagnose(lines[i].as_py(), allowed) for i in odd]
        columns = [pa.array([f[j] for f in found], pa.string()) for j in (1, 2, 0)]
        done.append(pa.RecordBatch.from_arrays([ids.take(pa.array(odd)), *columns], names))
    if tally is not None:
        tally[0] += len(lines) - len(odd)
        tally[1] += len(odd)
    return done


def parse_lines(df: DataFrame, databases: DataFrame, id_col: str = "line_id", text_col: str = "line_text", db_col: str = "db_id") -> DataFrame:
    """(line_id, sql, db_id, reason) for every line; reason is null for the loaded rows.

    ``databases`` is the fixed list of names a line may have (its size is checked).  A null line fails with column_count,
    an empty line too; repeated lines and ids are all kept; no lines give no rows.
    """
    names = [r[0] for r in databases.select(db_col).where(F.col(db_col).isNotNull()).distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError("the list of databases is meant to be a short fixed list; join a longer one after loading")
    allowed = frozenset(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = pa.array(names, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                yield from parse_block(part.column(0), part.column(1).cast(pa.string()), allowed, column)

    return df.select(F.col(id_col).cast("long").alias("line_id"), F.col(text_col).alias("t")).mapInArrow(run, "line_id long, sql string, db_id string, reason string")
