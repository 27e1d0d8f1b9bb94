"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

LIMIT = 4096
CHUNK = 2048  # characters of a chunk; longer documents are cut
OVERLAP = 64  # characters by which neighbouring chunks overlap at first
GROUP = 512  # chunks encoded in one call
MARK = "▁"  # how the vocabulary writes a blank


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts the tokens of a SentencePiece model.

    Why a splice is exact: merges only ever make pieces of the vocabulary, and in this vocabulary a blank never follows
    another character inside a piece (checked when the model is loaded).  So no merge crosses the border in front of a
    blank that follows a non-blank, and both sides of such a border are encoded as if they stood alone.
    """

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import numpy as np
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bounded = not any(MARK in p.lstrip(MARK) for p in pieces)
        # bytes of text that a token covers: a blank is one byte, a byte token is one
        self.bytes = np.array([1 if self.sp.is_byte(i) else 0 if self.sp.is_control(i) else len(p.replace(MARK, " ").encode())
                               for i, p in enumerate(pieces)], dtype=np.int64)

    def border(self, text: str, start: int) -> int:
        """The first stable border at or after ``start`` (a blank behind a non-blank); -1 without one."""
        at = text.find(" ", max(start, 1))
        while at > 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        return at

    def cuts(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, splice) of overlapping chunks; ``splice`` is a border inside the overlap with the next chunk.

        An overlap without a second border is widened, twice as far each time, and in the end swallows the rest.
        """
        out, start = [], 0
        while True:
            follow = self.border(text, start + self.chunk)
            if follow < 0:
                out.append((start, len(text), len(text)))
                return out
            width, splice = self.overlap, -1
            while True:
                splice = self.border(text, follow + 1)
                if 0 <= splice <= follow + width:
                    break
                if splice < 0 or follow + width >= len(text):
                    splice = -1
                    break
                width *= 2
            if splice < 0:
                out.append((start, len(text), len(text)))
                return out
            out.append((start, min(len(text), follow + width), splice))
            start = follow

    def _encoded(self, texts: list[str]) -> Iterator:
        for at in range(0, len(texts), GROUP):
            yield from self.sp.encode(texts[at:at + GROUP], num_threads=1)

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of every text; null counts as empty."""
        plain, owners, plans = [], [], {}
        for i, t in enumerate(texts):
            t = t or ""
            # a text that holds the vocabulary's own mark for a blank has no clear offsets: it is encoded whole
            cuts = self.cuts(t) if self.bounded and len(t) > self.chunk and MARK not in t else [(0, len(t), len(t))]
            if len(cuts) > 1:
                plans[i] = cuts
            for n, (start, end, _) in enumerate(cuts):
                plain.append(t[start + (n > 0):end])  # the blank in front is the prefix that the encoder adds
                owners.append((i, n))
        totals, spliced = [0] * len(texts), {}
        for (i, n), ids in zip(owners, self._encoded(plain)):
            if i in plans:
                spliced[i] = self._splice(texts[i], plans[i], n, ids, spliced.get(i))
                totals[i] += spliced[i][1]
                if spliced[i][2]:  # the chunks did not meet where they must: no guess, the whole text decides
                    totals[i] = -1
                    plans.pop(i)
                    spliced.pop(i)
            elif totals[i] >= 0:
                totals[i] += len(ids)
        for i, n in enumerate(totals):
            if n < 0:
                totals[i] = len(self.sp.encode(texts[i], num_threads=1))
        return totals

    def _splice(self, text: str, cuts: list[tuple[int, int, int]], n: int, ids: list[int], before) -> tuple:
        """(splice byte, tokens between the last splice and this chunk's, whether they failed to meet)."""
        import numpy as np

        start, _, splice = cuts[n]
        origin = before[3] if before else 0  # bytes in front of this chunk
        covered = np.cumsum(self.bytes[np.asarray(ids, dtype=np.int64)])
        # the added prefix is the blank in front of a later chunk, and no text at the first one
        ends = origin + covered - (n == 0)
        first = int(np.searchsorted(ends, before[0], "right")) if before else 0
        if before and not (first > 0 and ends[first - 1] == before[0]):
            return before[0], 0, True, 0
        if n == len(cuts) - 1:
            return 0, len(ids) - first, False, 0
        here = origin + len(text[start:splice].encode())
        last = int(np.searchsorted(ends, here, "right"))
        if not (last > 0 and ends[last - 1] == here):
            return here, 0, True, 0
        following = origin + len(text[start:cuts[n + 1][0]].encode())
        return here, last - first, False, following


def counted(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    Whole texts are counted; null and empty ones have none.  ``model`` is the path of a SentencePiece model that
    every executor can open.  Repeated rows give repeated results; an empty table gives none; extra columns are ignored.
    """
    arrow_rows(docs.sparkSession, 256)
    path = model or default_model()

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(path, chunk, overlap)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                counter.count(batch.column(2).to_pylist()), pa.int64())], names=["k", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                         F.col(text).alias("text"))
    return narrow.mapInArrow(mapped, "k long, n_bytes long, n_tokens long").select(
        F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
