"""Near-duplicate notes: an exact Jaccard self-join by universe partition.

Method. The shingle universe is cut by a hash into segments, as many for each band of set sizes as two linked sets can
differ in shingles, and one more. By the pigeonhole principle two linked sets then agree on a whole segment. Some
segments of a band may be twice as long and be indexed with their one-deletion neighbourhoods too: they tolerate one
difference and count twice. A cost model chooses their number for each band. Candidates are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import WordHashes, components, cut, expand, mixed, partitions, row_key, text_batches, whole_groups
from paceline.llm.shingles import fingerprints, shingle_sets

#: Sizes of a band differ by this factor at most.
BAND_RATIO = 1.5
#: The cost model: chance that a shingle of one set is in another that it isn't linked with, and what a pair costs, in
#: signatures (most fall to the bound of their sketches).
SHARED_BY_CHANCE, PAIR_COST = 0.01, 1.0
#: A sketch counts a set's shingles in this many cells; the counts' differences bound the sets' difference from below.
CELLS = 64
#: Signatures of a bucket, about, and signatures gathered in a task before they are dealt out.
BUCKET_SIGNATURES, FLUSH_SIGNATURES = 100_000, 1_000_000
#: Keys that a node shares with the smallest node of their buckets to be in its block; nodes and shingles of a block, about.
STRONG_VOTES, BLOCK_NODES, BLOCK_SHINGLES = 3, 1024, 500_000
#: Nodes of a key whose sketches are compared in one piece.
KEY_NODES = 2048
#: Whether a row is of the first block of a pair, of the second, or of the only one.
LEFT, RIGHT, BOTH = 0, 1, 2
#: A round of comparing blocks ships about as many times the shingles of all nodes; its shuffle goes before the next one.
ROUND_COPIES = 1.0
#: Signatures that are dealt out at a time, about, for each shingle of all notes.
ROUND_SIGNATURES = 0.75
#: Rows of keys whose sketches are compared at a time, for each shingle of all nodes: a row takes about ten shingles' bytes.
ROUND_ROWS = 0.1
#: Columns of the dense matrices that blocks are compared by.
MATRIX_COLUMNS = 4096


def sketch(values: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mixed(values) >> np.uint64(58)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def may_link(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of whole groups, sorted by pair: which nodes may link with one of another label in the other part (or in the same
    where there is one only), going by sizes and sketches, and the blocks of those: (node, block, other), each once."""
    cells = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), CELLS).astype(np.int16)
    sizes, labels, pair, side = frame["n"].to_numpy(), frame["label"].to_numpy(), frame["pair"].to_numpy(), frame["side"].to_numpy()
    nodes, blocks = frame["node"].to_numpy(), frame["block"].to_numpy()
    order = np.lexsort((side, pair))
    first = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
    total = np.diff(np.append(first, len(frame)))
    lefts = np.add.reduceat((side[order] != RIGHT).astype(np.int64), first)
    alone = side[order][first] == BOTH
    right_first = np.where(alone, first, first + lefts)
    rights = np.where(alone, total, total - lefts)
    left_rows = expand(first, lefts)
    partners = np.repeat(rights, lefts)
    partner_first = np.repeat(right_first, lefts)
    found = [frame.iloc[:0][["node", "block"]].assign(other=blocks[:0])]
    at = 0
    done = np.cumsum(partners)
    while at < len(left_rows):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 100_000)))
        x = order[np.repeat(left_rows[at:to], partners[at:to])]
        y = order[expand(partner_first[at:to], partners[at:to])]
        low = np.abs(cells[x] - cells[y]).sum(1)
        good = (low * (100 + percent) <= (sizes[x] + sizes[y]) * (100 - percent)) & (labels[x] != labels[y])
        x, y = np.concatenate([x[good], y[good]]), np.concatenate([y[good], x[good]])
        if len(x):
            found.append(pd.DataFrame({"node": nodes[x], "block": blocks[x], "other": blocks[y]}).drop_duplicates())
        at = to
    return pd.concat(found, ignore_index=True).drop_duplicates()


def bridges_between(group: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Labels of linked rows of two blocks (or inside one), as few pairs as connect the same labels."""
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(x) for x in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(sets)), sizes)
    kept = column >= 0
    row, column = row[kept], column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    labels, side = group["label"].to_numpy(), group["side"].to_numpy()
    left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    common = np.zeros((len(left), len(right)), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, MATRIX_COLUMNS):
        a, b = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        dense = np.zeros((len(sets), min(MATRIX_COLUMNS, width - at)), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        common += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    x, y = np.nonzero((100 * common >= percent * union) & (labels[left][:, None] != labels[right][None, :]))
    a, b = labels[left[x]], labels[right[y]]
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out: tuple[list[int], list[int]] = ([], [])
    for p, q in dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)):
        rp, rq = root(p), root(q)
        if rp != rq:
            parent[max(rp, rq)] = min(rp, rq)
            out[0].append(p)
            out[1].append(q)
    return out


def band_edges(percent: int, largest: int = 1 << 40) -> list[tuple[int, int]]:
    out, low = [], 1
    while low < largest:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high))
        low = high + 1
    return out


@dataclass(frozen=True)
class Scheme:
    """Segments of a band: the first `doubled` of them also index one-deletion neighbourhoods. Rows with at most `slack`
    matches' worth of segments of up to `weak` shingles leave those segments out."""

    segments: int
    doubled: int
    slack: int
    weak: int


def most_different(low_size: int, percent: int) -> int:
    """How many shingles two linked sets can differ in, the smaller having low_size."""
    other = low_size * 100 // percent
    return (low_size + other) * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, rows: int, percent: int) -> Scheme:
    """The cheapest scheme of a band that holds that many sets: signatures, and pairs that agree by chance."""
    allowed = most_different(high, percent)
    if not allowed:
        return Scheme(0, 0, 0, 0)
    best = None
    for doubled in sorted({0, (allowed + 1) // 8, (allowed + 1) // 4, (allowed + 1) // 2}):
        for weak in range(4):
            for slack in range(0, 2 * allowed + 12, 1 + allowed // 40):
                segments = allowed + 1 + slack - doubled
                each = low / segments
                poisson = [math.exp(-each) * each**k / math.factorial(k) for k in range(weak + 30)]
                small = segments * sum(poisson[: weak + 1])
                if slack >= small + 2 * math.sqrt(small):
                    break
            else:
                continue
            chance = sum(p * SHARED_BY_CHANCE**k for k, p in enumerate(poisson) if k > weak)
            cost = rows * (segments + doubled * high / segments + rows * segments * chance * PAIR_COST / 2)
            if best is None or cost < best[0]:
                best = (cost, Scheme(segments, doubled, slack, weak))
    return best[1] if best else Scheme(allowed + 1, 0, 0, 0)


def signatures(values: np.ndarray, counts: np.ndarray, scheme_of: np.ndarray, schemes: list[Scheme]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row of each, for rows that are each dealt by one scheme (-1 or one without segments: none)."""
    number = np.array([s.segments for s in schemes] + [0], np.int64)[scheme_of]
    doubled = np.array([s.doubled for s in schemes] + [0], np.int64)[scheme_of]
    slack = np.array([s.slack for s in schemes] + [0], np.int64)[scheme_of]
    least = np.array([s.weak for s in schemes] + [0], np.int64)[scheme_of]
    row = np.repeat(np.arange(len(counts)), counts)
    kept = number[row] > 0
    row, tokens = row[kept], mixed(values[kept] ^ np.uint64(0x5851F42D4C957F2D))
    segment = ((tokens >> np.uint64(32)) * number[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    first = np.cumsum(number) - number
    flat = first[row] + segment
    sums = np.zeros(int(number.sum()), np.uint64)
    np.add.at(sums, flat, tokens)
    sizes = np.bincount(flat, minlength=len(sums))
    owner = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(sums)) - first[owner]
    double = place < doubled[owner]
    # A linked pair agrees on slack + 1 matches' worth of segments at least. A row with no more than slack in small ones
    # can leave these out; any other row indexes them all, empty ones too, and so meets the others of its kind.
    weak = np.where(double, 2 * (sizes <= least[owner] + 1), sizes <= least[owner])
    full = np.bincount(owner, weights=weak, minlength=len(counts)) > slack
    salt = mixed((scheme_of[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
    whole = (sizes > least[owner]) | full[owner]
    keys, rows = [mixed(sums[whole] ^ salt[whole])], [owner[whole]]
    less = double[flat] & ((sizes[flat] > least[row] + 1) | full[row])
    if less.any():
        at = flat[less]
        keys.append(mixed((sums[at] - tokens[less]) ^ salt[at]))
        rows.append(row[less])
    return np.concatenate(keys), np.concatenate(rows)


def near_duplicate_notes(attempts: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", shingle_words: int = 4, percent: int = 85) -> DataFrame:
    """Groups of attempts whose notes are near-duplicates: (attempt_id, n_shingles, component_id).

    Notes are lower-cased (A-Z) and cut at ASCII white space; the set of an attempt holds its distinct shingles of
    shingle_words words, or its whole text where that is shorter. Attempts link when 100 * |intersection| >= percent *
    |union|; component_id is the smallest attempt_id reachable by links. Null or blank notes have no shingles and link
    with nothing: they are components of their own. Every row is returned, repeated rows and a null attempt_id included
    (nulls are never the smallest unless they are alone). Further columns are ignored. Sets are compared through 64-bit
    hashes of shingles.

    Work: notes with equal sets are one node. In each bucket the nodes are compared with its smallest one, best shared
    first; after that only pairs of a bucket that lie in different components are left, and these are compared in blocks
    inside tasks: a group of copies costs rows in proportion to its size, and no link between groups is missed.
    """
    spark = attempts.sparkSession
    edges = band_edges(percent)
    highs = np.array([h for _, h in edges])
    rows = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text")).withColumn("rk", row_key("id", "text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame, words in text_batches(batches, "text", True):
            values, counts = shingle_sets(words, shingle_words, known)
            yield pd.DataFrame({"id": frame["id"], "rk": frame["rk"], "n": counts, "node": fingerprints(values, counts).view(np.int64), "band": np.searchsorted(highs, counts).astype(np.int32)})

    id_type = attempts.schema[attempt_id].dataType.simpleString()
    sets = cut(rows.mapInPandas(describe, "id string, rk long, n long, node long, band int").withColumn("id", F.col("id").cast(id_type)))
    counted = sets.where("n > 0").groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()
    held, shingles_held = {r["band"]: r["c"] for r in counted}, sum(r["n"] for r in counted)
    # The smaller set of a pair decides the scheme, so a band with larger sets only is still probed from above.
    schemes = [allocate(low, high, held.get(b, 0), percent) for b, (low, high) in enumerate(edges[: max(held, default=0) + 1])]
    expected = sum(c * (schemes[b].segments * 1.6) for b, c in held.items())
    buckets = max(partitions(spark), int(expected / BUCKET_SIGNATURES) + 1)
    turns = max(1, math.ceil(expected / (ROUND_SIGNATURES * max(1, shingles_held))))

    def index(batches: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        keys_held: list[np.ndarray] = []
        nodes_held: list[np.ndarray] = []
        size, turn = 0, 0
        for _, words in text_batches(batches, "text", True):
            values, counts = shingle_sets(words, shingle_words, known)
            nodes = fingerprints(values, counts)
            own = np.searchsorted(highs, counts)
            own[counts == 0] = -1
            for down in (0, 1, 2):
                scheme = own - down
                # A larger set probes a lower band when that band's largest set could still link with it.
                fits = (scheme >= 0) & (own >= 0) & (100 * highs[np.maximum(scheme, 0)] >= percent * counts)
                scheme = np.where(fits, scheme, len(schemes))
                if fits.any():
                    k, r = signatures(values, counts, scheme, schemes)
                    if turns > 1:
                        now = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) % np.uint64(turns) == np.uint64(part)
                        k, r = k[now], r[now]
                    keys_held.append(k)
                    nodes_held.append(nodes[r])
                    size += len(k)
            if size >= FLUSH_SIGNATURES:
                yield from dealt(keys_held, nodes_held, turn)
                keys_held, nodes_held, size, turn = [], [], 0, turn + 1
        if size:
            yield from dealt(keys_held, nodes_held, turn)

    def dealt(keys_held: list[np.ndarray], nodes_held: list[np.ndarray], turn: int) -> Iterator[pd.DataFrame]:
        """For each bucket one packed row with one node for each key, and packed rows with all nodes of keys met twice here."""
        keys, nodes = np.concatenate(keys_held), np.concatenate(nodes_held)
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        keys = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[fresh], nodes[fresh]
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(head) - 1
        several = np.bincount(group)[group] > 1
        out = []
        if several.any():
            mk, mn = keys[several], nodes[several]
            for i in range(0, len(mk), 50_000):
                out.append((buckets + (turn * 31 + i // 50_000) % buckets, mk[i : i + 50_000].tobytes(), mn[i : i + 50_000].tobytes()))
        keys, nodes = keys[head], nodes[head]
        bounds = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))
        low = keys.astype(np.uint32)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            out.append((b, low[bounds[b] : bounds[b + 1]].tobytes(), nodes[bounds[b] : bounds[b + 1]].tobytes()))
        yield pd.DataFrame(out, columns=["bucket", "keys", "nodes"])

    def meet(bucket: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = int(bucket[0])
        if b >= buckets:
            for frame in batches:
                for k, n in zip(frame["keys"], frame["nodes"], strict=True):
                    yield pd.DataFrame({"key": np.frombuffer(k, np.int64), "node": np.frombuffer(n, np.int64)})
            return
        packed = [(k, n) for frame in batches for k, n in zip(frame["keys"], frame["nodes"], strict=True)]
        keys = np.frombuffer(b"".join(k for k, _ in packed), np.uint32)
        nodes = np.frombuffer(b"".join(n for _, n in packed), np.int64)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[fresh], nodes[fresh]
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
        several = np.bincount(group)[group] > 1
        yield pd.DataFrame({"key": keys[several].astype(np.int64) | (b << 32), "node": nodes[several]})

    # Signatures can be many times the shingles: some of the buckets are dealt, met and deleted at a time.
    def met_in(part: int) -> DataFrame:
        packed = rows.select("text").mapInPandas(lambda batches: index(batches, part), "bucket long, keys binary, nodes binary")
        return cut(packed.groupBy("bucket").applyInPandas(meet, "key long, node long").distinct())

    shared = reduce(DataFrame.union, [met_in(part) for part in range(turns)])

    nodes = cut(shared.select("node").distinct())
    source = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("rk").alias("rk"), F.min("n").alias("n"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame, words in text_batches(batches, "text", True):
            values, counts = shingle_sets(words, shingle_words, known)
            ends = np.cumsum(counts)
            same = fingerprints(values, counts).view(np.int64) == frame["node"].to_numpy()
            yield pd.DataFrame({"node": frame["node"], "n": counts, "shingles": [values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], "sketch": [sketch(values[e - c : e]) for e, c in zip(ends, counts, strict=True)]})[same]

    loaded = cut(rows.select("rk", "text").join(source.select("rk", "node"), "rk").mapInPandas(load, "node long, n long, shingles binary, sketch binary").dropDuplicates(["node"]))
    sizes = loaded.select("node", "n")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, verified on their whole sets."""

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                good = []
                for x, y in zip(frame["x"], frame["y"], strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(both) - common))
                yield frame.loc[good, ["a", "b"]]

        left = pairs.join(loaded.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return left.join(loaded.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").mapInPandas(check, "a long, b long")

    least = shared.groupBy("key").agg(F.min("node").alias("leader"))
    votes = shared.join(least, "key").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    first = cut(votes.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    stars = components(linked(first))
    label = cut(nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("label")))

    # Nodes that share several keys with the same smallest node form a block.
    strong = votes.where(f"c >= {STRONG_VOTES}").groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("over"))
    above = strong.select(F.col("node").alias("over"), F.col("over").alias("top"))
    tops = strong.join(above, "over", "left").select("node", F.coalesce("top", "over").alias("root"))
    heads = label.join(tops, "node", "left")
    rooted = heads.withColumn("root", F.coalesce("root", "node")).join(loaded.select("node", "n", "sketch"), "node")
    parts = rooted.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    blocks = cut(rooted.join(parts, "root").select("node", "label", "n", "sketch", F.xxhash64("root", F.pmod(F.xxhash64("node"), "parts")).alias("block")))

    # What is left: pairs of a key that lie in different components. The sketches of each key are compared as a matrix, those
    # of a key with many nodes in parts: a node goes on to the blocks of those nodes only that its sketch doesn't rule out.

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "pair", 4096):
            may = may_link(frame, percent)
            if len(may):
                yield may

    side = lambda own, other: F.when(F.col(own) == F.col(other), BOTH).when(F.col(own) < F.col(other), LEFT).otherwise(RIGHT)
    stored, rows_shared = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((sizes, F.col("n")), (shared, F.lit(1))))
    sieves = max(1, math.ceil(rows_shared / max(1, ROUND_ROWS * stored)))
    may = []
    for i in range(sieves):
        under = shared.where(F.pmod(F.xxhash64("key"), F.lit(sieves)) == i).join(label, "node")
        keys = under.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / KEY_NODES).cast("int").alias("parts")).where("lo < hi").select("key", "parts")
        part = under.join(keys, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        parted = part.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("pair"), side("part", "other").alias("side"), "node").join(blocks, "node")
        may.append(cut(parted.repartition(partitions(spark), "pair").sortWithinPartitions("pair").mapInPandas(sieve, "node long, block long, other long").distinct()))

    # Two blocks that hold such nodes are compared as matrices, and only links that connect something are returned.
    met = reduce(DataFrame.union, may).distinct()
    sieved = cut(met.select(F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("pair"), side("block", "other").alias("side"), "node").join(label, "node"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "pair", 256):
            for _, group in frame.groupby("pair", sort=False):
                a, b = bridges_between(group, percent)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

    # A node goes to every block that its own meets, which can be many times what is held: all pairs are compared, in rounds.
    shipped = sieved.join(sizes, "node").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(shipped / (ROUND_COPIES * max(1, stored))))
    found = []
    for i in range(rounds):
        work = sieved.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == i).join(loaded.select("node", "shingles"), "node")
        found.append(cut(work.select("pair", "side", "label", "shingles").repartition("pair").sortWithinPartitions("pair").mapInPandas(compare, "a long, b long")))
    joined = components(reduce(DataFrame.union, found))
    final = label.join(joined.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("group"))

    grouped = sets.join(final, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("group", "node")))
    least_id = grouped.where("group is not null").groupBy("group").agg(F.min("id").alias("least_id"))
    return grouped.join(least_id, "group", "left").select(F.col("id").alias(attempt_id), F.col("n").alias("n_shingles"), F.coalesce("least_id", "id").alias("component_id"))
