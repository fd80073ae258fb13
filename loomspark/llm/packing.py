"""Concatenate and cut: documents become fixed windows of tokens.

Two passes give every token a global offset without moving a text: the first
tokenizes, writes the ids and notes each document's offset inside its partition;
a prefix sum over the partitions' totals (one number a partition) then places
the partitions one behind the other.  The second pass cuts at multiples of the
window.  A window that two partitions share gets its pieces from both.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialise, releasing

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker remembers, and how many of the earliest stay when it has to forget.
CACHE_WORDS, CACHE_KEPT = 600_000, 150_000
#: Texts whose new words are learned together.
TEXTS = 64
#: Letters and the ASCII marks behind them, which are pieces of their own; an apostrophe may belong to the letters after it.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class WordTokenizer:
    """Ids of whole texts, with every word's ids remembered.

    The tokenizer file drops white space and encodes the pieces between on
    their own, so the ids of a text are those of its words one behind the other.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that are found in the text as it is written, before anything is lower-cased.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; the words that are new in them are encoded together."""
        split = [self._lowered(text).replace("\n", " ").split(" ") if text else [] for text in texts]
        known = self.known
        if len(known) > CACHE_WORDS:  # between texts, so that no word of these is forgotten
            for word in list(known)[CACHE_KEPT:]:
                del known[word]
        new = set().union(*split).difference(known)
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join([known[w] for w in words]), np.uint32) for words in split]

    def _lowered(self, text: str) -> str:
        """Texts of Latin-1 letters in lower case, which saves words to learn, unless that makes an added token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        found = text.lower()
        return text if any(t in found for t in self.added) else found

    def _learn(self, words: set[str]) -> None:
        """Encode new words; of words of Latin-1 letters only lower-case ones, and marks behind them apart.

        The tokenizer lower-cases anyway, which takes such letters one to one, and
        splits letters from marks.  A word that lower-casing would turn into one of
        its added tokens stays as it is.
        """
        known, parts, plain = self.known, {}, set()
        for word in words:
            base = word.lower() if word.isascii() or max(word) <= "\xff" else None
            if base is not None and base.isalpha():
                found = (base,)
            elif base is not None and (marked := _MARKED.fullmatch(base)):
                found = marked.groups()
            else:
                found = (base,) if word.isascii() and not any(t in base for t in self.added) else (word,)
            if found[0] != word:
                parts[word] = found
            plain.update(found)
        new = list(plain.difference(known))
        self._learn_letters([p for p in new if p.isalpha()])
        rest = [p for p in new if p not in known]
        for part, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            known[part] = np.array(found.ids, np.uint32).tobytes()
        for word, found in parts.items():
            known[word] = b"".join(known[p] for p in found) if len(found) > 1 else known[found[0]]

    def _learn_letters(self, words: list[str]) -> None:
        """Encode words of letters together: each is one piece, whose last id ends a word.

        Should the pieces not be as many as the words (a letter that lower-cases
        to more than letters), the group is left to be encoded word by word.
        """
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for word, end in zip(group, ends.tolist(), strict=True):
                    self.known[word] = raw[4 * start : 4 * end]
                    start = end


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, whose memory of words outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, at, tokenizer = TaskContext.get().partitionId(), 0, _tokenizer(path)
        for batch in batches:
            texts, starts, counts, blobs = batch.column(1), [], [], []
            for k in range(0, len(texts), TEXTS):
                for found in tokenizer.encode_all(texts.slice(k, TEXTS).to_pylist()):
                    ids = np.append(found, np.uint32(end_id))
                    starts.append(at)
                    counts.append(len(ids))
                    blobs.append((ids.astype("<u2") if ids.max() < 65536 else ids.astype("<u4")).tobytes())
                    at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["part", "part_start", "doc", "doc_tokens", "ids"],
            )

    return releasing(run)


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Written once: part, offset in the part, id, token count and ids (little-endian, 2 or 4 bytes each)."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"part int, part_start bigint, doc {kind}, doc_tokens bigint, ids binary"
    return materialise(rows.mapInArrow(_tokenize(tokenizer_path, end_id), schema), "tokens")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, base, counts, blobs = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            rows: list[list] = [[] for _ in range(7)]
            for k in range(batch.num_rows):
                raw, n, first = blobs[k].as_py(), int(counts[k]), int(base[k])
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    to = min(n, at + window - (first + at) % window)
                    piece = ids[at:to].tobytes()
                    for column, value in zip(rows, (k, at, to - at, piece, zlib.crc32(piece), (first + at) // window, (first + at) % window), strict=True):
                        column.append(value)
                    at = to
            take = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [docs.take(take), *[pa.array(x, pa.int64()) for x in rows[1:3]], pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64()), pa.array(counts, pa.int64()).take(take), *[pa.array(x, pa.int64()) for x in rows[5:]]],
                names=["doc", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return releasing(run)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens; only the last may be shorter.

    Returns per piece ``id_col, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset``; ``ids`` are little-endian unsigned 32-bit.  A null or
    empty text has the end id alone, so every row of ``df`` has a piece; null
    ids and repeated rows are packed like any other, an empty table gives no
    rows.  Only the two named columns are read.
    """
    held = tokenize(df, tokenizer_path, id_col, text_col, end_id)
    totals = held.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row a partition of the first pass: bounded by the input's splits, not by its rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = held.join(F.broadcast(offsets), "part").select("doc", (F.col("base") + F.col("part_start")).alias("first"), "doc_tokens", "ids")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(_cut(window), schema).withColumnRenamed("doc", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ids of all pieces in order, and their number (bounded by the window)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
