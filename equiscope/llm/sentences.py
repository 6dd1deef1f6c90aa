"""Operator 4: substring dedup over sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiscope.llm.common import mix
from equiscope.llm.spans import batch_firsts, by_document, numbered, sha256, union_spans, with_cuts
from equiscope.llm.spans import outside as without_spans

_END = re.compile(rb"(?<=[.!?\xbc\x82])[ \t\r\f\v]+|[ \t\r\f\v]*\n[\s]*|(?<=\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)")
#: a character of the scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han, full-width forms)
_ALONE = rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80-\x82]|[\x9e\x9f])[\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xbc-\xbe][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
_WORD = re.compile(rb"%s|(?:(?!%s)\S)+" % (_ALONE, _ALONE))
_BLANKLESS = re.compile(_ALONE)
_CLAUSE = re.compile(rb"(?<=[,;:])[ \t\r\f\v]+|(?<=\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9b)")
#: a long clause is cut before a word whose hash is the only least one among so many words before and after it
_NEAR = 3


def word_places(text: bytes, s: int, e: int) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text, s, e)]


def clause_cuts(words: list[bytes], long_words: int) -> list[int]:
    """Where the parts of a long clause start: at places that the words around them choose, so that copies are cut alike
    wherever they stand; a part of more than long_words words (words that repeat choose none) also every long_words."""
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    n, out = len(h), [0]
    for i in range(_NEAR, n - _NEAR):
        if h[i] < min(h[i - _NEAR : i]) and h[i] < min(h[i + 1 : i + 1 + _NEAR]):
            out.append(i)
    return [k for a, b in zip(out, [*out[1:], n], strict=True) for k in range(a, b, long_words)]


def sentences(text: bytes, long_words: int = 24) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence: cut at blanks after . ! ? and at line ends, long ones also at blanks after , ; : and then
    at places that the words choose (clause_cuts). A character of a script without blanks counts as a word, and its full stops and commas need no blank."""
    out: list[tuple[int, int, int]] = []
    blankless = _BLANKLESS.search(text) is not None

    def add(s: int, e: int, pattern: re.Pattern | None) -> None:
        n = len(word_places(text, s, e)) if blankless else len(text[s:e].split())
        if not n:
            return
        if n <= long_words:
            out.append((s, e, n))
            return
        if pattern is None:
            words = word_places(text, s, e)
            cuts = clause_cuts([text[a:b] for a, b in words], long_words)
            out.extend((words[a][0], words[b - 1][1], b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True))
            return
        i = s
        for m in pattern.finditer(text, s, e):
            add(i, m.start(), None)
            i = m.end()
        add(i, e, None)

    i = 0
    for m in _END.finditer(text):
        add(i, m.start(), _CLAUSE)
        i = m.end()
    add(i, len(text), _CLAUSE)
    return out


def _from_each(sizes: list[int], least: int, words: int) -> Iterator[tuple[int, int]]:
    """From each sentence the shortest run of at least `least` sentences and `words` words, as [first, last + 1)."""
    n = len(sizes)
    j, held = 0, 0
    for i in range(n):
        while j < n and (j - i < least or held < words):
            held += sizes[j]
            j += 1
        if j - i < least or held < words:
            return
        yield i, j
        held -= sizes[i]


def runs(parts: list[tuple[int, int, int]], least: int, words: int) -> Iterator[tuple[int, int]]:
    """The shortest runs of at least `least` sentences and `words` words from each sentence and up to each, in order.

    Those inside a passage that is long enough cover all of it: the ones that start there all but its last sentences, and the one
    that ends at its end those.
    """
    n, sizes = len(parts), [p[2] for p in parts]
    if 0 < n < least and sum(sizes) >= words:
        yield 0, n
        return
    back = ((n - j, n - i) for i, j in _from_each(sizes[::-1], least, words))
    yield from sorted({*_from_each(sizes, least, words), *back})


def span_rows(docs: DataFrame, least: int, words: int) -> DataFrame:
    """(k1, k2, doc, th, s, e, first): every run with a 128-bit hash of its words; those that a batch already holds are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, doc, th, at, to = [], [], [], [], []
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py()
                parts = sentences(text)
                digest = [b" ".join(text[s:e].split()) for s, e, _ in parts]
                for i, j in runs(parts, least, words):
                    keys.append(xxhash.xxh3_128_digest(b"\n".join(digest[i:j])))
                    at.append(parts[i][0])
                    to.append(parts[j - 1][1])
                    doc.append(d)
                    th.append(h)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            doc_a, at_a = np.array(doc, np.int64), np.array(at, np.int64)
            first = batch_firsts(k[:, 0] ^ (k[:, 1] << 1), doc_a, at_a)
            # those that are known not to be first get a key of their own, so that a passage in many documents makes no large group
            own = mix(doc_a.view(np.uint64) ^ (at_a.view(np.uint64) << np.uint64(40)))
            k = np.where(first[:, None], k, np.stack([own, mix(own + np.uint64(1))], 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(doc_a), pa.array(th, pa.int32()), pa.array(at_a.astype(np.int32)), pa.array(to, pa.int32()), pa.array(first)], ["k1", "k2", "doc", "th", "s", "e", "first"])

    return docs.mapInArrow(run, "k1 long, k2 long, doc long, th int, s int, e int, first boolean")


def repeated_spans(docs: DataFrame, least: int, words: int) -> DataFrame:
    """(doc, th, s, e) of every run that also starts earlier (smaller doc, or earlier in the same one)."""
    rank = F.rank().over(Window.partitionBy("k1", "k2").orderBy("doc", "s"))
    return span_rows(docs, least, words).withColumn("r", rank).filter("r > 1 or not first").select("doc", "th", "s", "e")


def sentence_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 2, words: int = 20) -> DataFrame:
    """Per row: id, n_sentences, n_removed (sentences), n_bytes, n_removed_bytes, n_spans, kept_sha256, kept_text.

    From each sentence, and up to each, the shortest run of at least `least` sentences and `words` words is hashed (a shorter document of enough
    words is one run; blanks count as one). A run that occurs in several places stays where it comes first (smallest id, then
    place); everywhere else its sentences are removed, judged on the input. kept_text is the text without the removed stretches.
    A null text is empty; a null id counts as the smallest; repeated rows are one document and each gives the same row; an empty
    table gives none; other columns are not read.
    """
    cuts = by_document(repeated_spans(numbered(docs, id_col, text_col), least, words))

    def make(text: bytes, cut: list[tuple[int, int]]) -> tuple:
        parts = sentences(text)
        removed, k = 0, 0
        for s, _, _ in parts:
            while k < len(cut) and cut[k][1] <= s:
                k += 1
            removed += k < len(cut) and cut[k][0] <= s
        kept = without_spans(text, cut)
        return len(parts), removed, len(text), len(text) - len(kept), len(cut), sha256(kept), kept.decode("utf-8", "replace")

    long_, text_ = pa.int64(), pa.string()
    return with_cuts(docs, cuts, make, id_col, text_col, "n_sentences long, n_removed long, n_bytes long, n_removed_bytes long, n_spans long, kept_sha256 string, kept_text string", [long_] * 5 + [text_] * 2)


__all__ = ["repeated_spans", "runs", "sentence_dedup", "sentences", "union_spans"]
