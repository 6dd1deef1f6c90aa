"""Operator 1: token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import utf8

SPACE_MARK = "▁"


def safe_parts(text: str, limit: int) -> list[str]:
    """Parts whose token counts add up to the text's.

    No vocabulary piece has a space mark after another character, so merges never cross the place between a
    character and a blank. The cut drops one such blank, which the mark put before each part stands for.
    """
    parts, i, n = [], 0, len(text)
    while n - i > limit:
        j = text.find(" ", i + limit)
        while 0 <= j < n - 1 and text[j - 1] in (" ", SPACE_MARK):
            j = text.find(" ", j + 1)
        if j < 0 or j >= n - 1:
            break
        parts.append(text[i:j])
        i = j + 1
    parts.append(text[i:])
    return parts


class PieceCounter:
    """Counts for a sentencepiece model; words met before are taken from a bounded memory."""

    def __init__(self, path: str, batch_bytes: int, part_chars: int, memory: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.batch_bytes, self.part_chars, self.limit = batch_bytes, part_chars, memory
        self.seen: dict[str, int] = {}

    def encode(self, parts: list[str]) -> list[int]:
        out, batch, held = [], [], 0
        for p in parts:
            batch.append(p)
            held += len(p)
            if held >= self.batch_bytes:
                out += map(len, self.sp.encode(batch, num_threads=1))
                batch, held = [], 0
        return out + [len(x) for x in self.sp.encode(batch, num_threads=1)] if batch else out

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts of about batch_bytes together, or of one longer text."""
        out, whole, seen = [0] * len(texts), [], self.seen
        words: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.splits:
                whole.append((i, t))
            elif "  " in t or t[0] == " " or t[-1] == " " or SPACE_MARK in t:
                whole += ((i, p) for p in safe_parts(t, self.part_chars))
            else:
                words.append((i, t.split(" ")))
        if len(seen) > self.limit:
            seen.clear()
        new = list({w for _, ws in words for w in ws if w not in seen})
        seen.update(zip(new, self.encode(new), strict=True))
        for i, ws in words:
            out[i] = sum(map(seen.__getitem__, ws))
        for (i, _), n in zip(whole, self.encode([p for _, p in whole]), strict=True):
            out[i] += n
        return out


class JsonCounter:
    """Counts for a tokenizers file; special strings inside texts are handled as its default."""

    def __init__(self, path: str, batch_bytes: int):
        from tokenizers import Tokenizer

        self.tok, self.batch_bytes = Tokenizer.from_file(path), batch_bytes
        self.tok.no_truncation()
        self.tok.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tok.encode_batch(texts, add_special_tokens=False)]


def resolve(model: str) -> str:
    """A file path as it is; a bare name through the installed vocabulary files, on the machine that asks."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def token_counts(
    docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", *, limit: int = 4096, batch_bytes: int = 1 << 20, part_chars: int = 1 << 14, memory: int = 400_000
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. One narrow pass; no shuffle.

    Texts are gathered into encoding batches of about batch_bytes whatever the size of the Arrow batch, and long texts
    with irregular blanks are cut at safe boundaries. A null or empty text has 0 bytes and 0 tokens; repeated rows each
    give a row; an empty table gives none; other columns are not read. Invalid UTF-8 counts as its replacement characters.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = resolve(model)
        counter = JsonCounter(path, batch_bytes) if path.endswith(".json") else PieceCounter(path, batch_bytes, part_chars, memory)
        for b in batches:
            raw = b.column(1)
            sizes, tokens, held, total = [], [], [], 0
            for i in range(b.num_rows):
                t = raw[i].as_py()
                sizes.append(len(t))
                held.append(t.decode("utf-8", "replace"))
                total += len(t)
                if total >= batch_bytes:
                    tokens += counter.counts(held)
                    held, total = [], 0
            tokens += counter.counts(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col), utf8(text_col).alias("_text")).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
