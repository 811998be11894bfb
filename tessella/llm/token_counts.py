"""Operator 2, token counts: byte-pair merging with a heap and a linked list, counting merges and never emitting ids."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tessella.llm._common import chunks, id_and_text

#: SentencePiece's mark for a space.
MARK = "▁"


class PieceCounter:
    """Counts the tokens of a piece model (BPE with byte fallback, identity normaliser, a mark before the text).

    No piece has a mark after another character, so merges never cross into a mark: a text is cut before each run of marks,
    and after a miss at every place where no piece holds the two neighbours side by side. Counts of short chunks are
    remembered, up to `most` of them."""

    def __init__(self, model_path: str, most: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_unused(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}  # equal scores, equal rank: the leftmost pair goes first
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a mark inside: texts can't be cut before marks")
        self.beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if not any("\n" in p for p in self.rank) else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.most = most
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Tokens of a chunk: pop the lowest-ranked adjacent pair (leftmost of equals) until none is a piece."""
        n = len(chunk)
        rank, piece = self.rank, list(chunk)
        count = sum(1 if c in rank else len(c.encode("utf-8", "replace")) for c in piece)
        if n == 1:
            return count
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(piece[i] + piece[i + 1])
            if r is not None:
                heap.append((r, i, piece[i] + piece[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if piece[i] else n
            if j >= n or piece[i] + piece[j] != whole:
                continue  # one of the two has gone or grown
            for part in (piece[i], piece[j]):  # a symbol outside the vocabulary stood for its bytes; merged, it is part of a piece
                if part not in rank:
                    count -= len(part.encode("utf-8", "replace")) - 1
            count -= 1
            piece[i], piece[j] = whole, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(whole + piece[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, whole + piece[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(piece[h] + whole)
                if r is not None:
                    heapq.heappush(heap, (r, h, piece[h] + whole))
        return count

    def chunk(self, chunk: str) -> int:
        beside, start, total = self.beside, 0, 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in beside:
                part = chunk[start:i]
                found = self.parts.get(part)
                if found is None:
                    found = self.merged(part)
                    if len(part) <= 64:
                        if len(self.parts) >= self.most:
                            self.parts.clear()
                        self.parts[part] = found
                total += found
                start = i
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for chunk in self.cut.findall(MARK + text.replace(" ", MARK)):
            found = known.get(chunk)
            if found is None:
                found = self.chunk(chunk)
                if len(chunk) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[chunk] = found
            total += found
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle: each task counts its own texts, whole. Null and empty texts have 0 tokens, repeated rows are counted again, an
    empty table gives no rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(model)).count
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            n_bytes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
