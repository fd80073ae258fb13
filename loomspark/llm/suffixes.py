"""Removal of repeated passages by a distributed merge sort of suffixes.

Every string of LENGTH bytes names an anchor: of its first REACH positions the one
whose next GRAM bytes have the smallest hash.  Equal strings name the same
anchor, so it is enough to sort the suffixes at anchors, one in about sixty
positions, and nothing is lost.  An anchor's suffix has at least LENGTH - REACH + 1
bytes in common with that of any anchor it shares a string with; suffixes whose
first bytes are unique by hash drop out before any text is exchanged (the
distinguishing-prefix step of distributed string sorting).

The others travel as sorted, front-coded runs.  A loser tree that keeps common
prefix lengths merges a bucket's runs: two heads are compared by what they share
with the last winner, and bytes known to be equal are never looked at again.  The
merged order's prefix lengths on the right of the anchors, with those of the
sorted left contexts, say exactly which strings occur twice.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise

LENGTH, REACH, GRAM = 200, 128, 24
SHARED = LENGTH - REACH + 1
#: Bytes that are hashed at once; longer texts are cut into overlapping parts.
CHUNK = 1 << 20
#: Suffixes of one merge, and anchors with one prefix from which on strings are counted one by one instead.
BUCKET, HOT = 60_000, 200_000
#: Suffixes of a run, before it is sorted and sent.
RUN = 100_000
#: A key is salted when it has more than one in so many of all rows; so at most this many keys are, and are broadcast.
SALTED = 1000

_RANDOM = np.random.default_rng(20240501)
_TABLE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, made once a worker."""
    if not _POWERS:
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(CHUNK + 1, np.uint64(base))
                p[0] = 1
                _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, anchor, first, last string start) over texts laid end to end; at most CHUNK bytes.

    ``ends`` are the texts' ends; no string crosses one.
    """
    n, nothing = len(data), (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if n < LENGTH:
        return nothing
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        prefix = _mix((sums[SHARED:] - sums[:-SHARED]) * down[: n - SHARED + 1])
    at = np.arange(len(gram), dtype=np.uint64)
    low = _sliding_min((gram & np.uint64(0xFFFFFFFF00000000)) | at, REACH)[: n - LENGTH + 1]
    named = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(named))
    end = ends[np.searchsorted(ends, starts, "right")]
    valid = starts + LENGTH <= end
    starts, named = starts[valid], named[valid]
    if not len(starts):
        return nothing
    new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(new[1:], len(starts)) - 1
    return prefix[named[new]], named[new], starts[new], starts[last]


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts laid end to end: bytes, ends, and of each text its number and the offset of its part."""
    held, who, offset, size = [], [], [], 0

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(who), np.array(offset)

    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), CHUNK - LENGTH):
            part = text[start : start + CHUNK - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > CHUNK:
                yield laid()
                held, who, offset, size = [], [], [], 0
            held.append(part)
            who.append(k)
            offset.append(start)
            size += len(part)
    if held:
        yield laid()


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return at << 16 | (at - first) << 8 | (at - last)


def find_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, number of the text, packed place) of all anchors of whole texts.

    Parts of a long text overlap by LENGTH - 1 bytes, so each string lies in one;
    an anchor that two parts name is listed with the strings of each.
    """
    out: list[tuple] = []
    for data, ends, who, offset in _parts(texts):
        h, at, first, last = anchors(data, ends)
        part = np.searchsorted(ends, at, "right")
        shift = offset[part] - (ends[part] - np.diff(ends, prepend=0)[part]) if len(at) else at
        out.append((h, who[part] if len(at) else at, _pack(at + shift, first + shift, last + shift)))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of (prefix shared with the one before, string).

    Each inner node keeps the loser of its match and what that loser shares with
    the winner that passed it.  Of two heads the one that shares more with the
    last output is smaller; only when they share equally much are bytes
    compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]) -> None:
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.place = [0] * len(runs)
        self.shared = [0] * self.size
        self.loser = [-1] * self.size
        self.head: list[bytes | None] = [run[1][0] if run[1] else None for run in runs] + [None] * (self.size - len(runs))
        self.winner = self._start(1) if self.size > 1 else 0

    def _play(self, a: int, b: int, node: int) -> int:
        """Winner of two heads; the loser stays at the node."""
        x, y, known = self.head[a], self.head[b], self.shared
        if y is None or x is not None and known[a] > known[b]:
            win, lose = a, b
        elif x is None or known[b] > known[a]:
            win, lose = b, a
        else:
            same = common(x, y, known[a])
            if same == len(x) or same < len(y) and x[same] < y[same]:
                win, lose = a, b
            else:
                win, lose = b, a
            known[lose] = same
        self.loser[node] = lose
        return win

    def _start(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(self._start(2 * node), self._start(2 * node + 1), node)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in the run, prefix shared with the string before) in sorted order."""
        before: int = 0
        while self.runs and self.head[self.winner] is not None:
            run = self.winner
            yield run, self.place[run], before
            self.place[run] += 1
            lcps, strings = self.runs[run]
            if self.place[run] < len(strings):
                self.head[run], self.shared[run] = strings[self.place[run]], lcps[self.place[run]]
            else:
                self.head[run] = None
            node, win = (run + self.size) >> 1, run
            while node:
                win = self._play(win, self.loser[node], node)
                node >>= 1
            self.winner = win
            before = self.shared[win]


def _adjacent(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])])


def encode_run(entries: dict[tuple[bytes, bytes], list[tuple[int, int]]]) -> bytes:
    """A run as bytes: entries (right, left context) in order, front-coded on the right, with their owners."""
    import zstandard

    order = sorted(entries)
    parts, lcps, before = [], [], b""
    for right, _ in order:
        same = common(before, right, 0)
        lcps.append(same)
        parts.append(right[same:])
        before = right
    owners = np.array([o for key in order for o in entries[key]], np.int64).reshape(-1, 2)
    fields = [
        np.array(lcps, np.uint8).tobytes(), np.array([len(r) for r, _ in order], np.uint8).tobytes(), b"".join(parts),
        np.array([len(left) for _, left in order], np.uint8).tobytes(), b"".join(left for _, left in order),
        np.array([len(entries[key]) for key in order], np.uint32).tobytes(), owners.tobytes(),
    ]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<8Q", len(order), *map(len, fields)) + b"".join(fields))


def decode_run(blob: bytes) -> tuple[list[int], list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """(prefix lengths, right contexts, left contexts, owners' counts, owners) of a run."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, *sizes = struct.unpack_from("<8Q", raw)
    cuts = np.cumsum([64, *sizes])
    f = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    lcps, rights, at, before = list(f[0]), [], 0, b""
    for same, size in zip(lcps, f[1], strict=True):
        before = before[:same] + f[2][at : at + size - same]
        at += size - same
        rights.append(before)
    lefts, at = [], 0
    for size in f[3]:
        lefts.append(f[4][at : at + size])
        at += size
    assert len(rights) == n
    return lcps, rights, lefts, np.frombuffer(f[5], np.uint32), np.frombuffer(f[6], np.int64).reshape(-1, 2)


def repeated_strings(lcp: np.ndarray, rights: list[bytes], lefts: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Row per entry, column per offset of the anchor: whether that string occurs twice.

    Two entries have the string at offset o in common when they share o bytes on
    the left and LENGTH - o on the right; both are classes of an order with
    known common prefixes, so a pair of class numbers decides.
    """
    n = len(rights)
    out = np.zeros((n, REACH), bool)
    if not n:
        return out
    left = np.zeros((n, REACH), np.uint8)
    longest = np.array([len(x) for x in lefts])
    shortest = LENGTH - np.array([len(x) for x in rights])
    for k, x in enumerate(lefts):
        left[k, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    words = left.view(">u8")
    order = np.lexsort(words.T[::-1])
    shared = np.empty(n, np.int64)
    shared[order] = np.arange(n)
    left_lcp = _adjacent(left[order])
    several = counts > 1
    for o in range(REACH):
        have = np.flatnonzero((shortest <= o) & (o <= longest))
        if not len(have):
            continue
        on_right = np.cumsum(lcp < LENGTH - o)[have]
        on_left = np.cumsum(left_lcp < o)[shared[have]] if o else np.zeros(len(have), np.int64)
        pair = on_right * np.int64(n + 1) + on_left
        by = np.argsort(pair, kind="stable")
        same = np.concatenate([[False], pair[by][1:] == pair[by][:-1]])
        twice = same | np.append(same[1:], False)
        out[have[by[twice]], o] = True
        out[have[several[have]], o] = True
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
        h, who, place = find_anchors(texts)
        rid = batch.column(0).to_numpy()
        for k in range(0, len(h), RUN):
            part = slice(k, k + RUN)
            yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(rid[who[part]]), pa.array(place[part])], names=["h", "rid", "place"])


def _run_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bytes, bytes], list[tuple[int, int]]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(b, encode_run(entries)) for b, entries in sorted(held.items())]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "run"])

        for batch in batches:
            for rid, text, places, prefixes in zip(*[batch.column(c) for c in range(4)], strict=True):
                raw, rid = text.as_py().encode("utf-8", "surrogatepass"), rid.as_py()
                for place, h in zip(places.as_py(), prefixes.as_py(), strict=True):
                    at, most, least = place >> 16, place >> 8 & 255, place & 255
                    if at - least + LENGTH > len(raw):
                        continue  # another text's place under the same row hash
                    key = (raw[at : at - least + LENGTH], raw[at - most : at])
                    held.setdefault(h % buckets, {}).setdefault(key, []).append((rid, at))
                size += len(places)
                if size >= RUN:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _merge_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    decoded = [decode_run(x) for x in rows["run"]]
    merged = list(LoserTree([(d[0], d[1]) for d in decoded]))
    lcp = np.array([x[2] for x in merged], np.int64)
    pick = lambda field: [decoded[r][field][k] for r, k, _ in merged]
    counts = np.array(pick(3), np.int64)
    twice = repeated_strings(lcp, pick(1), pick(2), counts)
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    first = [np.concatenate([[0], np.cumsum(d[3].astype(np.int64))]) for d in decoded]
    owners = [decoded[r][4][first[r][k] : first[r][k + 1]] for r, k, _ in merged]
    of = np.repeat(np.arange(len(entry)), counts[entry]) if len(entry) else np.empty(0, np.int64)
    own = np.concatenate([owners[e] for e in entry]) if len(entry) else np.empty((0, 2), np.int64)
    return pd.DataFrame({"rid": own[:, 0], "low": own[:, 1] - high[of], "high": own[:, 1] - low[of] + LENGTH})


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and place of every string of the places given."""
    for batch in batches:
        for rid, text, places in zip(*[batch.column(c) for c in range(3)], strict=True):
            raw, out = text.as_py().encode("utf-8", "surrogatepass"), []
            for place in places.as_py():
                at, most, least = place >> 16, place >> 8 & 255, place & 255
                out += [(hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest(), s) for s in range(at - most, at - least + 1) if s + LENGTH <= len(raw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.binary()), pa.array([rid.as_py()] * len(out), pa.int64()), pa.array([s for _, s in out], pa.int64())], names=["digest", "rid", "start"]
            )


def _remove(kind: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["low"], s["high"]) for s in spans.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for low, high in merged:
                    kept.append(raw[at:low])
                    at = high
                rest = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def with_counts(rows: DataFrame, counts: DataFrame, key: str, salted: int = SALTED) -> DataFrame:
    """``rows`` whose key is in ``counts`` (key, n), with ``n``; a frequent key is dealt over all tasks.

    A key with more than one in ``salted`` of the counted rows has its row of ``counts``
    repeated once a partition, and its rows fall to one of those by their place.  There are
    fewer than ``salted`` such keys whatever the input, which bounds what is broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = F.col("n") > total / salted
    frequent = counts.filter(often).select(key, F.lit(True).alias("often"))
    spread = rows.columns
    dealt = rows.join(F.broadcast(frequent), key, "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(0).cast("int"))
    repeated = counts.withColumn("salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated.hint("merge"), [key, "salt"]).select(*spread, "n")


def repeated_spans(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """(rid, low, high): byte ranges that repeated strings cover, of the rows (rid, text)."""
    places = documents.mapInArrow(_anchor_rows, "h bigint, rid bigint, place bigint")
    # Counted before the join, with partial sums: a passage of a third of all rows is one row a task.
    known = materialise(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "known")
    candidates = materialise(with_counts(places, known, "h").select("rid", "place", "h", (F.col("n") > hot).alias("hot")), "anchors")
    discard(known)
    total, some_hot = candidates.agg(F.count(F.lit(1)), F.max("hot")).first()
    session = documents.sparkSession
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    rows = candidates.filter("not hot").groupBy("rid").agg(F.collect_list("place").alias("places"), F.collect_list("h").alias("prefixes"))
    runs = documents.join(rows, "rid").select("rid", "text", "places", "prefixes").mapInArrow(_run_rows(buckets), "bucket int, run binary")
    spans = runs.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_merge_bucket, "rid bigint, low bigint, high bigint")
    if some_hot:
        rows = candidates.filter("hot").groupBy("rid").agg(F.collect_list("place").alias("places"))
        strings = materialise(documents.join(rows, "rid").select("rid", "text", "places").mapInArrow(_hot_rows, "digest binary, rid bigint, start bigint"), "strings")
        twice = materialise(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
        found = with_counts(strings, twice, "digest").select("rid", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
        spans = spans.unionByName(found)
    found = materialise(spans, "spans")
    discard(candidates, *([strings, twice] if some_hot else []))
    return found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document without the bytes that strings of LENGTH bytes cover which start anywhere else too.

    Columns: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, with ``with_text``, the ``kept`` bytes.  All strings are judged
    on the input, so every copy goes.  A null or short text loses nothing;
    rows that repeat a document repeat all its strings; null ids pass through.
    An empty table gives no rows, and no other column is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    documents = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    spans = repeated_spans(documents.select("rid", "text"), hot)
    # A text has few spans beside its bytes: neighbours are merged where the row is.
    by_row = spans.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kind = df.schema[id_col].dataType.simpleString()
    joined = documents.join(by_row, "rid", "left").select("id", "text", "spans")
    out = joined.mapInArrow(_remove(kind, with_text), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)
