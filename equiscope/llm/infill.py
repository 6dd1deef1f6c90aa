"""Operator 13: fill-in-middle transformation with a sparse exception index between code points and bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


class Exceptions:
    """Where the multibyte characters of a UTF-8 text are, and how many bytes beyond one each has.

    Between two of them code points and bytes run in step, so a cut is found by one search and an addition; a text of ASCII has an
    empty index.
    """

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            self.byte = self.char = lead
            self.after = np.zeros(1, np.int64)
            self.size = len(data)
            return
        first = data[lead]
        extra = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.after = np.concatenate([[0], np.cumsum(extra)])  # excess bytes of the first k exceptions
        self.byte = lead
        self.char = lead - self.after[:-1]
        self.size = len(data) - int(self.after[-1])

    def to_char(self, byte: int) -> int:
        """The code points before a byte cut that is a character's start or the end."""
        return byte - int(self.after[np.searchsorted(self.byte, byte, side="left")])

    def to_byte(self, char: int) -> int:
        """The byte at which the text's code point `char` starts."""
        return char + int(self.after[np.searchsorted(self.char, char, side="left")])


def draws(seed: int, key: object) -> list[int]:
    """h1 to h4 of a row: the first 8-digit groups of the hex sha256 of `seed:key`."""
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def line_ends(text: bytes) -> np.ndarray:
    """Byte cuts 0..n of the n lines `[^\\n]*\\n|[^\\n]+`: a line keeps its line feed, the last may have none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    tail = [] if not text or text[-1] == 10 else [len(text)]
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def transform(text: bytes, h: list[int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    index = None
    if unit == "line":
        cuts = line_ends(text)
        n = len(cuts) - 1
    else:
        index = Exceptions(text)
        n = index.size
    if not text or any(m in text for m in _MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    index = index or Exceptions(text)
    if unit == "line":
        i, j = int(cuts[a]), int(cuts[b])
        a, b = index.to_char(i), index.to_char(j)
    else:
        i, j = index.to_byte(a), index.to_byte(b)
    p, m, s = text[:i], text[i:j], text[j:]
    mp, ms, mm = _MARKS
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, b"".join((ms, s, mp, p, mm, m))
    return n, "psm", a, b - a, b"".join((mp, p, ms, s, mm, m))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Per row: id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points), output.

    A text is cut twice at units ("line" or "char") drawn from a hash of seed and id; `rate` of 100 rows are transformed, `spm` of 100
    of them with the suffix first. A null text counts as empty and is plain with 0 units; so is every text that holds a mark. A
    null id draws as `null`. Repeated rows come out alike, an empty table gives none, other columns are not read. One narrow pass.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"no unit named {unit}")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made, held = 0, [], 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                made.append(transform(text, draws(seed, b.column(0)[i].as_py()), unit, rate, spm))
                held += len(text)
                if held > 1 << 24 or i == b.num_rows - 1:  # a batch of long texts leaves in parts
                    n, form, pre, mid, out = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, len(made)), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string(), safe=False)], names
                    )
                    at, made, held = i + 1, [], 0

    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: marks never occur inside its parts, so the first of each ends a part."""
    after = lambda c, m: F.substr(c, F.locate(m, c) + F.lit(len(m)))
    before = lambda c, m: F.substring_index(c, m, 1)
    first = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(before(first, SUFFIX), after(first, MIDDLE), before(after(first, SUFFIX), MIDDLE))
    spm = F.concat(before(after(first, PREFIX), MIDDLE), after(first, MIDDLE), before(first, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
