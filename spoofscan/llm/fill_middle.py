"""Fill-in-the-middle transformation with a sparse checkpoint index.

While the units of a text (lines, or characters) are counted, the byte and character offsets of every EVERY-th unit's
start are recorded. A cut before unit u then needs a binary search of the checkpoints and a scan of less than EVERY units
from the one found, so memory is a few numbers for each EVERY units, whatever the length of a text.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints; bytes that the count looks at together.
EVERY, BLOCK = 64, 1 << 18
UNITS = ("line", "char")
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


class Checkpoints(NamedTuple):
    """Of one text: its number of units, and the unit number, byte and character offset of each checkpoint."""

    data: bytes
    unit: str
    n: int
    units: array
    offsets: array
    points: array

    def cut(self, u: int) -> tuple[int, int]:
        """(byte, character) offset where unit `u` starts; `u` may be n, the end."""
        i = bisect_right(self.units, u) - 1
        at, point, data = self.offsets[i], self.points[i], self.data
        if self.unit == "char":
            to = at
            for _ in range(u - self.units[i]):
                lead = data[to]
                to += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return to, point + u - self.units[i]
        to = at
        for _ in range(u - self.units[i]):
            to = data.find(b"\n", to) + 1 or len(data)
        return to, point + len(data[at:to].decode())


def checkpoints(data: bytes, unit: str = "line", every: int = EVERY) -> Checkpoints:
    """The index of a text in UTF-8, taken in blocks while its units are counted."""
    units, offsets, points = array("q", [0]), array("q", [0]), array("q", [0])
    n = seen = 0  # unit starts behind the first one (of lines), or characters, so far; characters so far
    for base in range(0, len(data), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - base), base)
        leads = (block & 0xC0) != 0x80
        if unit == "line":
            starts = np.flatnonzero(block == 10) + 1
            numbers = n + 1 + np.arange(len(starts))
            n += len(starts)
        else:
            starts = np.flatnonzero(leads)
            numbers = n + np.arange(len(starts))
            n += len(starts)
        kept = (numbers % every == 0) & (numbers > 0)
        if kept.any():
            at = starts[kept]
            units.extend(numbers[kept].tolist())
            offsets.extend((base + at).tolist())
            points.extend((seen + np.concatenate([[0], np.cumsum(leads)])[at]).tolist())
        seen += int(np.count_nonzero(leads))
    if unit == "line":
        n += bool(data) and not data.endswith(b"\n")  # what follows the last line feed is a line, unless it is empty
    return Checkpoints(data, unit, n, units, offsets, points)


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex SHA-256 of `seed:key`; an empty key for null."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(text: str, key: object, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> tuple:
    """(n, form, characters and bytes of prefix and middle (None if plain), output) of one text."""
    data = text.encode()
    index = checkpoints(data, unit)
    h1, h2, h3, h4 = draws(seed, key)
    if not data or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return index.n, "plain", None, None, None, None, text
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_points), (b, b_points) = index.cut(first), index.cut(second)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    spm = h4 % 100 < spm_rate
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return index.n, "spm" if spm else "psm", a_points, b_points - a_points, a, b - a, "".join(parts)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row per row of `docs`: key, n (units), form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output.

    The middle is cut out at two units drawn by a hash of seed and key, for `rate` of 100 texts; of those, `spm_rate` of 100
    put the suffix first. Texts that are empty, null (as empty) or hold a sentinel stay plain, with null offsets and their
    own text as output. Units are lines with their line feed, or characters. A null key draws as an empty one; repeated
    rows give equal rows; an empty table gives none. No row is shuffled, and other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")

    def run(batches):
        for batch in small_batches(batches):
            keys = batch.column("key")
            found = [transformed(x, k, unit, seed, rate, spm_rate) for x, k in zip(arrow_texts(batch), keys.to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *(x.split()[0] for x in _SCHEMA.split(", "))])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"`{key}` {given.schema['key'].dataType.simpleString()}, {_SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form alone; sentinels stand in no text that was cut."""

    def between(start: str, end: str) -> Column:
        """What stands between the first `start`, at the beginning, and the first `end`."""
        return F.substring(output, F.lit(len(start) + 1), F.locate(end, output) - 1 - len(start))

    def after(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + len(mark), F.length(output))

    def inside(start: str, end: str) -> Column:
        begin = F.locate(start, output) + len(start)
        return F.substring(output, begin, F.locate(end, output) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS z, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s
  FROM units
), cut AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS q
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
