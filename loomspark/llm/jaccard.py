"""N-gram Jaccard join over prefix trees.

A document is the set of its word n-grams.  All sets are in one global order, rare
n-grams first: a count of the whole corpus over SLOTS slots ranks the slots, and an
n-gram's code is its slot's rank followed by the rest of its hash.  Two sets of
similarity t share one of the first |x| - ceil(t|x|) + 1 codes of each, so the sets
that share such a code are brought together in cells.

A cell's sets are stored in a trie, frequent n-grams first, where near copies run
along the same path.  A probe walks down level by level: the overlap of a path is
counted once for all sets below it, and a subtree is dropped when its longest rest
can no longer reach the overlap that its smallest set needs, or when all of its
sets are already in the probe's component.

Equal sets are one class and joined once.  Cells with the same least class are
merged, and their members are first compared with that class alone.  Only cells
that this leaves in more than one component are joined in full, and there only the
sets outside the cell's largest component are probes: a large group of near copies
costs its members, not its pairs, and no link between components is lost.

Before a cell's sets are sent to it, their parity sketches are: two sketches never
differ in more bits than their sets do in elements, so a set without a possible
partner in another component leaves the cell, and its n-grams stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, fresh, materialise, releasing
from loomspark.llm.components import connected_components

#: Rows of one Arrow batch that a task gives back, and texts a task remembers as seen.
ROWS, SEEN = 100_000, 100_000
#: Bits of an n-gram's slot; the counts of all slots are the only statistic that the driver holds.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Marks of wanted rows that a task gets by broadcast.
MARKS = 1 << 20
#: Most members of one trie, most probes that walk it in one task, and their n-grams in all.
TREE, ELEMENTS = 4096, 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Ascending hashes of the distinct word n-grams; of a shorter text, of all its words; A-Z as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        found = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k])
    return np.unique(found)


def class_of(shingles: np.ndarray) -> int | None:
    """A signed 64-bit name that equal sets share; none for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 7)).astype(np.int64)) if len(shingles) else None


def slots_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def rank_slots(counts: np.ndarray) -> np.ndarray:
    """Each slot's place when slots are sorted by count; a permutation, so that codes stay distinct."""
    ranks = np.empty(SLOTS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
    return ranks


def codes_of(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the global order: rank of the slot above the other bits of the hash, ascending."""
    return np.sort((ranks[slots_of(shingles)] << np.uint64(64 - SLOT_BITS)) | (shingles >> np.uint64(SLOT_BITS)))


def prefix_of(codes: np.ndarray, percent: int) -> np.ndarray:
    """The codes of which two similar sets share at least one."""
    return codes[: len(codes) - -(-len(codes) * percent // 100) + 1]


class Trie:
    """Sets of codes as a compressed trie; nodes in order of depth, the children of a node side by side."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        """``sets`` are ascending; paths run from the last code (most frequent) to the first."""
        self.codes, dense = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        paths = [p[::-1].astype(">u4") for p in np.split(dense, ends[:-1])]
        keys = [p.tobytes() for p in paths]
        #: Place in the trie -> number of the set.
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        paths = [paths[k] for k in self.order]
        self.sizes = np.array([len(p) for p in paths], np.int64)
        common = [0]
        for a, b in zip(paths, paths[1:], strict=False):
            short = min(len(a), len(b))
            differ = np.flatnonzero(a[:short] != b[:short])
            common.append(int(differ[0]) if len(differ) else short)
        nodes: list[tuple[int, int, int, int]] = []  # depth above, depth below, first place, place after the last
        firsts: list[int] = []
        counts: list[int] = []
        level = [(0, len(paths), 0)]
        while level:
            after = []
            for low, high, depth in level:
                firsts.append(len(nodes))
                # The places where the next code changes part the node's sets into its children.
                cuts = [low, *[k for k in range(low + 1, high) if common[k] == depth], high] if high - low > 1 else [low, high]
                made = 0
                for a, b in zip(cuts, cuts[1:], strict=False):
                    end = min([len(paths[a]), *common[a + 1 : b]])
                    if end == depth:
                        continue  # a set that ended at the node itself
                    nodes.append((depth, end, a, b))
                    made += 1
                    after.append((a, b, end))
                counts.append(made)
            level = after
        self._finish(paths, nodes, firsts, counts)

    def _finish(self, paths: list[np.ndarray], nodes: list[tuple[int, int, int, int]], firsts: list[int], counts: list[int]) -> None:
        top, end, low, high = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
        self.top, self.end, self.low, self.high = top, end, low, high
        runs = [paths[a][d:e] for d, e, a, _ in nodes]
        self.stop = np.cumsum([len(r) for r in runs])
        self.start = self.stop - (end - top)
        self.runs = np.concatenate(runs).astype(np.int64)
        self.last = self.codes[self.runs[self.stop - 1]]
        #: The children of node k, the root being -1, are first[k + 1] and those after it.
        self.first, self.count = np.array(firsts, np.int64), np.array(counts, np.int64)
        ranges = np.column_stack([low, high]).ravel()
        self.smallest = np.minimum.reduceat(np.append(self.sizes, self.sizes[-1]), ranges)[::2]
        self.largest = np.maximum.reduceat(np.append(self.sizes, 0), ranges)[::2]
        self.ranges = ranges
        #: Sets equal to a node's path: they come first of the node's places.
        self.closed = self.sizes[low] == end

    def parts(self, labels: np.ndarray) -> np.ndarray:
        """The label that all sets below a node have (``labels`` by place), or -1."""
        least = np.minimum.reduceat(np.append(labels, labels[-1]), self.ranges)[::2]
        most = np.maximum.reduceat(np.append(labels, -1), self.ranges)[::2]
        return np.where(least == most, least, -1)

    def walk(self, probe: np.ndarray, percent: int, skip: np.ndarray) -> np.ndarray:
        """Places of the sets similar to ``probe``; nodes where ``skip`` holds are not entered."""
        at = np.searchsorted(self.codes, probe)
        at[at == len(self.codes)] = 0
        marks = np.zeros(len(self.codes), np.int64)
        marks[at[self.codes[at] == probe]] = 1
        size, found = len(probe), []
        node, overlap = np.array([-1]), np.zeros(1, np.int64)
        while len(node):
            width = self.count[node + 1]
            shift = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            child, overlap = np.repeat(self.first[node + 1], width) + shift, np.repeat(overlap, width)
            fits = ~skip[child] & (100 * self.smallest[child] <= 100 * 100 * size // percent) & (100 * self.largest[child] >= percent * size)
            child, overlap = child[fits], overlap[fits]
            if not len(child):
                break
            length = self.end[child] - self.top[child]
            first = np.cumsum(length) - length
            run = self.runs[np.repeat(self.start[child] - first, length) + np.arange(length.sum())]
            overlap = overlap + np.add.reduceat(marks[run], first)
            ahead = np.searchsorted(probe, self.last[child])  # codes of the probe below the node's last one
            most = overlap + np.minimum(self.largest[child] - self.end[child], ahead)
            closed = self.closed[child] & (overlap * (100 + percent) >= percent * (size + self.end[child]))
            for k in child[closed]:
                place = self.low[k]
                while place < self.high[k] and self.sizes[place] == self.end[k]:
                    found.append(place)
                    place += 1
            alive = most * (100 + percent) >= percent * (size + self.smallest[child])
            node, overlap = child[alive], overlap[alive]
        return np.array(found, np.int64)


def join_cell(names: list[int], parts: list[int], sets: list[np.ndarray], probes: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect the parts of a cell: of the links between two parts, at least one that joins them.

    Members have a name, a part and a set; every probe (name, part, set) walks the members' trie.
    """
    trie = Trie(sets)
    known: dict[int, int] = {}
    label = [known.setdefault(p, len(known)) for p in parts]
    mine = [known.setdefault(p, len(known)) for _, p, _ in probes]
    root = np.arange(len(known))
    places = np.array(label)[trie.order]
    below, links = trie.parts(root[places]), []
    for (name, _, codes), own in zip(probes, mine, strict=True):
        hits = trie.walk(codes, percent, below == root[own])
        if not len(hits):
            continue
        found, first = np.unique(root[places[hits]], return_index=True)
        other = found != root[own]
        links += [(name, names[trie.order[hits[k]]]) for k in first[other]]
        if other.any():
            root[np.isin(root, found)] = root[own]
            below = trie.parts(root[places])
    return links


def _describe(n: int):
    """(id, n, cls, row, sketch) of every document, and (slot, seen): how many of the task's sets have an n-gram there."""
    names = ["id", "n", "cls", "row", "sketch", "slot", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = np.zeros(SLOTS, np.int64), set(), None
        for batch in batches:
            kind = batch.column(0).type
            size, cls, bits = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), n)
                size.append(len(shingles))
                cls.append(class_of(shingles))
                bits.append(sketch(shingles).tobytes() if len(shingles) else None)
                if cls[-1] is not None and cls[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls[-1])
                    counts += np.bincount(slots_of(shingles), minlength=SLOTS)
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), batch.column(2), pa.array(bits, pa.binary()), none, none], names=names)
        at = np.flatnonzero(counts)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at])], names=names)

    return releasing(run)


def _emit(n: int, percent: int, ranks: np.ndarray):
    """(key, cls): the prefix codes of every text's set, once for the copies within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held]).view(np.int64)
            cls = np.repeat(np.array([c for _, c in held], np.int64), [len(k) for k, _ in held])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls)], names=["key", "cls"])

        for batch in batches:
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), n)
                cls = class_of(shingles)
                if cls is None or cls in seen:
                    continue  # a copy in this task: its codes went out already
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                held.append((prefix_of(codes_of(shingles, ranks), percent), cls))
                rows += len(held[-1][0])
                if rows >= ROWS:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    return releasing(run)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each bit, about two bits an element, a power of two in all."""
    bits = max(512, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((_mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half the length of the same sets."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def possible(sizes: list[int], sketches: list[np.ndarray], parts: list[int], probes: list[tuple[int, np.ndarray, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members, and which probes (size, sketch, part), may be similar to one of another part on the other side."""
    size, part, length = np.array(sizes), np.array(parts), np.array([len(x) for x in sketches])
    member, walker = np.zeros(len(sizes), bool), np.zeros(len(probes), bool)
    # Similar sets have sketches of the same length or of one twice as long.
    by = {words: (np.flatnonzero(length == words), np.array([x for x in sketches if len(x) == words])) for words in set(length.tolist())}
    folded = {words: fold(bits) for words, (_, bits) in by.items()}
    for k, (n, bits, own) in enumerate(probes):
        for words, mine in ((len(bits), bits), (2 * len(bits), bits), (len(bits) // 2, fold(bits))):
            if words not in by:
                continue
            at, theirs = by[words]
            fits = (part[at] != own) & (100 * size[at] <= 10000 * n // percent) & (100 * size[at] >= percent * n)
            if not fits.any():
                continue
            rows = (theirs if words <= len(bits) else folded[words])[fits]
            near = np.bitwise_count(rows ^ mine).sum(axis=1, dtype=np.int64) * (100 + percent) <= (size[at][fits] + n) * (100 - percent)
            member[at[fits][near]] = True
            walker[k] |= near.any()
    return member, walker


def _codes(n: int, ranks: np.ndarray):
    """(cls, codes) of texts, named anew from the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes, held = [], [], 0
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), n)
                names.append(class_of(shingles))
                codes.append(codes_of(shingles, ranks).tobytes())
                held += len(shingles)
                if held >= ELEMENTS:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(codes, pa.binary())], names=["cls", "codes"])
                    names, codes, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(codes, pa.binary())], names=["cls", "codes"])

    return releasing(run)


def _by_cell(solve: Callable[[list[pa.RecordBatch]], list[tuple]], names: tuple[str, ...]):
    """Batches of what ``solve`` finds in each cell of sorted rows (cell, i, j, ...), one cell at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, found = None, []

        def give() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            for low, high in zip(starts, starts[1:], strict=False):
                key = tuple(keys[low])
                if held and key != at:
                    found += solve(held)
                    held = []
                at = key
                held.append(batch.slice(low, high - low))
            if len(found) >= 10_000:
                yield give()
        if held:
            found += solve(held)
        yield give()

    return releasing(run)


def _split(rows: list[pa.RecordBatch], columns: tuple[str, ...]) -> tuple[list[tuple], list[tuple]]:
    """(members, probes) of a cell, each a list of the values of ``columns``; binary ones as arrays of 64-bit words."""
    sides: tuple[list, list] = ([], [])
    for batch in rows:
        values = []
        for c in columns:
            column = batch.column(c)
            values.append([np.frombuffer(x.as_buffer(), np.uint64) for x in column] if column.type == pa.binary() else column.to_pylist())
        for probe, row in zip(batch.column("probe").to_pylist(), zip(*values, strict=True), strict=True):
            sides[probe].append(row)
    return sides


def _possible_in_cell(percent: int):
    def solve(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        members, probes = _split(rows, ("cell", "cls", "part", "size", "sketch"))
        if not members or not probes:
            return []
        cells, names, parts, sizes, sketches = zip(*members, strict=True)
        member, walker = possible(list(sizes), list(sketches), list(parts), [(size, bits, part) for _, _, part, size, bits in probes], percent)
        return [(cells[0], n) for n in {names[k] for k in np.flatnonzero(member)} | {probes[k][1] for k in np.flatnonzero(walker)}]

    return _by_cell(solve, ("cell", "cls"))


def _links_in_cell(percent: int):
    def solve(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        members, probes = _split(rows, ("cls", "part", "codes"))
        if not members or not probes:
            return []
        names, parts, sets = zip(*members, strict=True)
        return join_cell(list(names), list(parts), list(sets), probes, percent)

    return _by_cell(solve, ("a", "b"))


def _at_cells(rows: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (cell, i, j, probe, cls, part) with ``columns`` of their sets, each cell's rows together."""
    joined = rows.join(sets.select("cls", *columns), "cls").select("cell", "i", "j", "probe", "cls", "part", *columns)
    return joined.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def _possible(rows: DataFrame, classes: DataFrame, percent: int, name: str) -> DataFrame:
    """(cell, cls) of the rows that may have a link to another component of their cell."""
    found = _at_cells(rows, classes, ["size", "sketch"]).mapInArrow(_possible_in_cell(percent), "cell bigint, cls bigint")
    return materialise(found.distinct(), name)


def _links(rows: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) that connect the components of the rows' cells, by a trie for each."""
    return materialise(_at_cells(rows, sets, ["codes"]).mapInArrow(_links_in_cell(percent), "a bigint, b bigint"), name)


def _blocks(count: Column, elements: Column) -> Column:
    """Into how many blocks that many sets with that many n-grams are dealt; at least one."""
    return F.greatest(F.ceil(count / TREE), F.ceil(elements / ELEMENTS), F.lit(1)).cast("long")


def _dealt(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(name)), F.col(blocks)).cast("long")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _star_rows(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """The least class of each cell as the probe of tries of bounded size, which the other members are dealt to."""
    sized = stars.join(classes.select("cls", "size"), "cls")
    trees = sized.groupBy("cell").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("trees"))
    members = sized.join(trees, "cell").select("cell", _dealt("tree", "trees").alias("i"), F.lit(False).alias("probe"), "cls")
    centers = trees.select("cell", _every("trees").alias("i"), F.lit(True).alias("probe"), F.col("cell").alias("cls"))
    return members.unionByName(centers).withColumns({"j": F.lit(0).cast("long"), "part": F.col("cls")})


def _open_rows(members: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Of cells whose ``members`` (cell, cls) still lie in several components: all members, and as probes those outside the largest.

    Every pair of different components has an end outside the cell's largest one,
    so only those walk, each through all tries of the cell.
    """
    known = classes.select("cls", "size").join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "size", F.coalesce("component", "cls").alias("part"))
    members = members.join(known, "cls")
    groups = members.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    whole = groups.groupBy("cell").agg(F.max(F.struct("n", "elements", "part")).alias("main"), F.sum("n").alias("n"), F.sum("elements").alias("elements"))
    whole = whole.filter(F.col("n") > F.col("main.n")).select(
        "cell", F.col("main.part").alias("main"), _blocks(F.col("n"), F.col("elements")).alias("tries"), _blocks(F.col("n") - F.col("main.n"), F.col("elements") - F.col("main.elements")).alias("turns")
    )
    placed = members.join(whole, "cell")
    stored = placed.withColumns({"probe": F.lit(False), "i": _dealt("trie", "tries")}).withColumn("j", _every("turns"))
    probes = placed.filter("part <> main").withColumns({"probe": F.lit(True), "j": _dealt("turn", "turns")}).withColumn("i", _every("tries"))
    columns = ["cell", "i", "j", "probe", "cls", "part"]
    return stored.select(*columns).unionByName(probes.select(*columns))


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, ranks: np.ndarray, name: str) -> DataFrame:
    """(cls, codes) of the classes in ``wanted`` (cls), each from the text of its first row.

    A broadcast of the wanted rows' marks, MARKS of them at most, keeps other texts out of the shuffle.
    """
    rows = materialise(wanted.distinct().join(classes, "cls").select("first.row"), name + "-rows")
    mark = F.pmod(F.col("row"), F.lit(MARKS)).cast("int").alias("mark")
    texts = documents.select("row", "text", mark).join(F.broadcast(rows.select(mark).distinct()), "mark", "left_semi")
    texts = texts.join(rows, "row", "left_semi").dropDuplicates(["row"]).select("text")
    found = materialise(texts.mapInArrow(_codes(n, ranks), "cls bigint, codes binary"), name)
    discard(rows)
    return found


def _row(id_: Column, text: Column) -> Column:
    """A 64-bit name that rows share when both their ids and their texts are equal; ids may repeat or be null."""
    return F.xxhash64(id_, text)


def _linked(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) of all ``documents`` (id, text), and (cls, part, first): components of classes by their links.

    ``first`` is the first row of a class by id (nulls last) and row name.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    documents = documents.withColumn("row", _row(F.col("id"), F.col("text")))
    kind = documents.schema["id"].dataType.simpleString()
    described = documents.select("id", "text", "row").mapInArrow(_describe(n), f"id {kind}, n bigint, cls bigint, row bigint, sketch binary, slot bigint, seen bigint")
    described = materialise(described, "described")
    counts = np.zeros(SLOTS, np.int64)
    for slot, seen in described.filter("slot is not null").groupBy("slot").agg(F.sum("seen")).collect():  # at most SLOTS rows
        counts[slot] = seen
    ranks = rank_slots(counts)
    documents_of = described.filter("slot is null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = documents_of.filter("cls is not null").groupBy("cls").agg(first.alias("first"), F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")

    keys = documents.select("text").mapInArrow(_emit(n, percent, ranks), "key bigint, cls bigint")
    keys = materialise(keys, "prefixes")
    # A least and a greatest class a code combine before the shuffle; most codes have one class and end here.
    least = keys.groupBy("key").agg(F.min("cls").alias("cell"), F.max("cls").alias("high")).filter("cell < high").select("key", "cell")
    stars = materialise(keys.join(least, "key").filter("cls <> cell").select("cell", "cls").distinct(), "stars")
    discard(keys)

    near = _possible(_star_rows(stars, classes), classes, percent, "near-stars")
    sets = _sets(documents, classes, near.select("cls"), n, ranks, "star-sets")
    links = _links(_star_rows(near.filter("cls <> cell"), classes), sets, percent, "star-links")
    discard(sets)
    parts = connected_components(links)
    members = stars.unionByName(stars.select("cell", F.col("cell").alias("cls")).distinct())
    open_ = _possible(_open_rows(members, parts, classes), classes, percent, "near-open")
    sets = _sets(documents, classes, open_.select("cls"), n, ranks, "open-sets")
    more = _links(_open_rows(open_, parts, classes), sets, percent, "open-links")
    if not more.isEmpty():
        # The links found last run between the components of the first, which are far fewer than the classes.
        name = parts.withColumnsRenamed({"node": "x", "component": "px"})
        ends = more.join(name.withColumnsRenamed({"x": "a", "px": "pa"}), "a", "left").join(name.withColumnsRenamed({"x": "b", "px": "pb"}), "b", "left")
        merged = connected_components(ends.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
        named = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("node", F.coalesce("component", "cls")).drop("component")
        named = named.join(merged, "node", "left").select("cls", F.coalesce("component", "node").alias("part"), "first")
    else:
        named = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("part"), "first")
    named = materialise(named, "named")
    discard(classes, stars, sets, near, links, parts, open_, more)
    return documents_of.select("id", "n", "cls"), named


def link_ngrams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``.

    Documents link when 100 * |intersection| >= percent * |union| of their sets.
    ``component_id`` is the smallest id reachable by links, the document's own
    included.  A null or blank text has the empty set and links with nothing; a
    text of fewer than n words is one gram.  Rows that repeat an id are rows of
    their own; a null id never names a component unless all of its members are
    null, and an unlinked row with a null id has a null component.  An empty
    table gives no rows; no other column is read.
    """
    described, named = _linked(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, percent)
    lowest = named.groupBy("part").agg(F.min("first.id").alias("component_id"))
    named = named.join(lowest, "part").select("cls", "component_id")
    out = described.join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each component, the first by id (nulls last); all columns stay.

    Of rows that agree in id and text, any one stands for the others.  Rows that
    share only an id are rows of their own, and so are rows without id.  Null
    and blank texts belong to no component and all stay.
    """
    _, named = _linked(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, percent)
    name = fresh(df, "__row")
    first = named.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    blank = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    kept = df.filter(~blank).withColumn(name, _row(F.col(id_col), F.col(text_col))).join(first, name, "left_semi").dropDuplicates([name])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(df.filter(blank))
