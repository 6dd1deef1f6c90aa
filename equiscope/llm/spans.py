"""Removal spans: which repeated pieces are not the first, and texts without them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import maybe_among, staged, utf8

#: stands for a null id while spans are sought
NO_ID = -(1 << 63)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text): a null id becomes the smallest number, and th tells apart rows of one id whose texts differ."""
    text = utf8(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.pmod(F.hash(text), F.lit(1 << 13)).alias("th"), text.alias("text"))


def batch_firsts(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row whether it is the first (smallest doc, then at) of its key within the batch; equal places are firsts together."""
    _, rank = np.unique(doc, return_inverse=True)
    place = (rank.astype(np.int64) << 32) | at.astype(np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    first = np.repeat(np.minimum.reduceat(place[order], starts), np.diff(np.append(starts, len(k)))) if len(k) else place
    out = np.empty(len(k), bool)
    out[order] = place[order] == first
    return out


def by_document(spans: DataFrame) -> DataFrame:
    """(doc, th, s, e) -> (doc, th, cut): merged in the next step, with no more entries than the document has pieces."""
    return spans.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("cut"))


def union_spans(cut: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in cut or ()):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def outside(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, i = [], 0
    for s, e in spans:
        parts.append(text[i:s])
        i = e
    return b"".join([*parts, text[i:]])


def with_cuts(docs: DataFrame, cuts: DataFrame, make: Callable[[bytes, list[tuple[int, int]]], tuple], id_col: str, text_col: str, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Each row's id and what `make` says of its text and its merged spans."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()
    cuts = staged(cuts, "cuts")
    rows = numbered(docs, id_col, text_col)
    test = maybe_among(cuts, "doc", "th")("doc", "th")
    # texts without cuts stay where they are; only the others go to the join
    rows = rows.withColumn("maybe", test)
    whole = rows.filter("not maybe").select("doc", "text", F.lit(None).cast(cuts.schema["cut"].dataType).alias("cut"))
    rows = rows.filter("maybe").join(cuts, ["doc", "th"], "left").select("doc", "text", "cut").unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(t.as_py(), union_spans(c.as_py())) for t, c in zip(b.column(1), b.column(2), strict=True)]
            cols = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc", *names])

    out = rows.mapInArrow(run, f"doc long, {schema}")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).cast(kind).alias(id_col), *names)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
