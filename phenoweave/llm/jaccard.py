"""Exact similarity join of word shingle sets, to components of linked documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import _mixed, chained, sized_join, slices, word_hashes
from phenoweave.session import ship_package, stored

#: Words of a shingle, and the similarity in hundredths from which two sets are linked.
WIDTH, LINKED = 4, 85
#: Counters of the sketch that orders shingles from rare to frequent, and the part of it in one row.
COUNTERS, COUNTERS_A_ROW = 1 << 22, 1 << 16
#: Sets and shingles, about, that one task compares. Larger clusters are dealt out in chunks.
CHUNK_SETS, CHUNK_SHINGLES = 512, 1 << 21
#: Parts of a signature, and the length of a list up to which all its pairs are held against their signatures.
PARTS, LISTED = 256, 512
#: Links that a task gathers before it passes their spanning forest on.
GATHERED = 1 << 17


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none.

    Hashes have 64 bits: two different shingles are taken for one with a chance of 1 in 2^64.
    """
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < width:
        return chained(words, len(words)) ^ np.uint64(len(words))
    return np.unique(chained(words, width))


def class_of(found: np.ndarray) -> int | None:
    """Equal sets have equal numbers: a 64-bit hash of the sorted set, null for the empty one."""
    if not len(found):
        return None
    places = _mixed(np.arange(1, len(found) + 1, dtype=np.uint64))
    return int(_mixed(np.array([np.bitwise_xor.reduce(_mixed(found + places)) ^ np.uint64(len(found))]))[0].astype(np.int64))


def prefix_length(size, linked: int = LINKED):
    """So many of the rarest shingles of a set that any set linked with it has one of them among its own."""
    return size - (linked * size + 99) // 100 + 1


def signature(found: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of PARTS parts of the hash range, 255 standing for more.

    Two sets differ in at least as many shingles as their signatures do in all.
    """
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _profile(docs: DataFrame) -> DataFrame:
    """Per row its set's size and class, and per task the counts of shingles in hashed counters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(COUNTERS, np.int32)
        for frame in slices(frames, ("text", "doc_id")):
            sets = [shingles(t) for t in frame["text"]]
            if sets:
                counters += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
            classes = pd.array([class_of(s) for s in sets], dtype="Int64")
            signed = [signature(s) for s in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n": [len(s) for s in sets], "cls": classes, "signature": signed, "part": None, "counts": None})
        parts = counters.reshape(-1, COUNTERS_A_ROW)
        used = np.flatnonzero(parts.any(axis=1))
        counts = [zlib.compress(np.minimum(parts[k], 65535).astype("<u2").tobytes(), 1) for k in used]
        if counts:
            yield pd.DataFrame({"doc_id": None, "n": 0, "cls": pd.array([None] * len(used), dtype="Int64"), "signature": None, "part": used, "counts": counts})

    out = _texts(docs).mapInPandas(run, "doc_id string, n long, cls long, signature binary, part int, counts binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _levels(profile: DataFrame) -> np.ndarray:
    """How far above the mean each counter stands, in powers of two: a fixed number of bytes for the driver."""

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS_A_ROW, np.int64)
        for frame in frames:
            for counts in frame["counts"]:
                total += np.frombuffer(zlib.decompress(counts), "<u2")
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})

    total = np.zeros((COUNTERS // COUNTERS_A_ROW, COUNTERS_A_ROW), np.int64)
    for part, counts in profile.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        total[part] = np.frombuffer(counts, np.int64)
    flat = total.ravel()
    return np.maximum(0, np.floor(np.log2(np.maximum(flat, 1) / max(1.0, flat.mean())))).astype(np.int8)


class Forest:
    """Union of numbers with the links that joined two trees."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _candidates(docs: DataFrame, levels: np.ndarray, classes: DataFrame) -> DataFrame:
    """Links between classes that share a prefix shingle and may be linked; linked sets are connected by them.

    The list of each shingle is sorted by size, and whoever stands alone in one
    goes no further. In a list of up to LISTED sets those are connected whose
    sizes and signatures allow a link. In a longer one neighbours are, unless
    their sizes are too far apart, which ends a block: two sets of a block are
    connected without naming their pairs. Either way the comparison that follows
    decides; these links only bring together what it has to compare.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = held.value
        done: set[int] = set()
        for frame in slices(frames, ("text", "doc_id")):
            columns: list[list] = [[], [], []]
            for text in frame["text"]:
                found = shingles(text)
                cls = class_of(found)
                if cls is None or cls in done:
                    continue
                if len(done) < GATHERED:
                    done.add(cls)
                order = np.argsort(rank[(found % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
                rarest = found[order[: prefix_length(len(found))]].astype(np.int64)
                for column, value in zip(columns, (rarest, np.full(len(rarest), len(found)), np.full(len(rarest), cls)), strict=True):
                    column.append(value)
            yield pd.DataFrame({name: np.concatenate(column or [np.empty(0, np.int64)]) for name, column in zip(("shingle", "n", "cls"), columns, strict=True)})

    def several(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of shingles that two sets or more have, each once."""
        held_back, paired = np.empty((0, 3), np.int64), False
        for frame in frames:
            rows = np.vstack([held_back, frame.to_numpy(np.int64)])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.append(paired, same) | np.append(same, False)
            held_back, paired = rows[-1:], bool(keep[-1])
            if keep[:-1].any():
                yield pd.DataFrame(rows[:-1][keep[:-1]], columns=["shingle", "n", "cls"])
        if paired:
            yield pd.DataFrame(held_back, columns=["shingle", "n", "cls"])

    def listed(sizes: np.ndarray, own: list[int], signed: list[bytes], forest: Forest) -> None:
        if len({forest.root(x) for x in own}) == 1:
            return
        parts = np.frombuffer(b"".join(signed), np.uint8).reshape(len(own), PARTS).astype(np.int16)
        for i in range(len(own) - 1):
            upto = i + 1 + np.searchsorted(LINKED * sizes[i + 1 :], 100 * sizes[i], side="right")
            differ = np.abs(parts[i + 1 : upto] - parts[i]).sum(axis=1)
            for j in np.flatnonzero((100 + LINKED) * differ <= (100 - LINKED) * (sizes[i] + sizes[i + 1 : upto])):
                forest.join(own[i], own[i + 1 + j])

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shingle and size; a list is gathered until it is longer than LISTED, then only its last row is."""
        forest, shingle, sizes, own, signed, long = Forest(), None, [], [], [], False

        def close() -> None:
            if not long and len(own) > 1:
                listed(np.array(sizes, np.int64), own, signed, forest)

        for frame in frames:
            for token, n, cls, sign in zip(frame["shingle"].tolist(), frame["n"].tolist(), frame["cls"].tolist(), frame["signature"], strict=True):
                if token != shingle:
                    close()
                    shingle, sizes, own, signed, long = token, [], [], [], False
                    if len(forest.above) > GATHERED:
                        if forest.links:
                            yield pd.DataFrame(forest.links, columns=["x", "y"])
                        forest = Forest()
                if long and LINKED * n <= 100 * sizes[-1]:
                    forest.join(own[-1], cls)
                sizes, own, signed = ([], [], []) if long else (sizes, own, signed)
                sizes.append(n)
                own.append(cls)
                signed.append(sign)
                if len(own) > LISTED:
                    for k in range(LISTED):
                        if LINKED * sizes[k + 1] <= 100 * sizes[k]:
                            forest.join(own[k], own[k + 1])
                    long = True
        close()
        if forest.links:
            yield pd.DataFrame(forest.links, columns=["x", "y"])

    rows = _texts(docs).mapInPandas(prefixes, "shingle long, n long, cls long")
    lists = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "cls").mapInPandas(several, "shingle long, n long, cls long")
    signed = lists.join(classes.select("cls", "signature"), "cls").select("shingle", "n", "cls", "signature")
    return signed.repartition("shingle").sortWithinPartitions("shingle", "n", "cls").mapInPandas(neighbours, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``x, y`` links; the component is its least node.

    Each round hangs the larger neighbours of a node, then the smaller ones, below
    its least neighbour, until no link changes; rounds grow with the logarithm of
    the longest path. Links are written to the shared folder between rounds.
    """
    two = F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))
    state, before = stored(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = state.select(F.explode(two).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("x"), F.col("m").alias("y"))
        large = stored(large.distinct(), "links")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("y", "m"), F.struct(F.col("x").alias("y"), "m"))).alias("e")).select(F.col("e.y").alias("x"), F.col("e.m").alias("y"))
        state = stored(small.where("x <> y").distinct(), "links")
    return state.select(F.col("x").alias("node"), F.col("y").alias("component")).union(state.select("y", "y").distinct())


def overlaps(sets: list[np.ndarray], probes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each probe, in order, how many shingles it shares with the sets at ``lo`` to ``hi``.

    Index lists hold positions in order, so a list is entered at the window's
    start and left at its end. The answers of a probe that resembles the one
    before it are derived from that one's: only lists of shingles that one has and
    the other lacks are read, and whole lists only for positions that are new.
    """
    m = len(sets)
    _, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = counts[local] > 1
    own = np.split(local[shared], np.cumsum(np.bincount(owner[shared], minlength=m))[:-1])
    keys = np.sort(local[shared] * m + owner[shared])
    positions = keys % m

    def read(out: np.ndarray, base: int, tokens: np.ndarray, a: int, b: int, sign: int) -> None:
        if a >= b or not len(tokens):
            return
        starts, ends = np.searchsorted(keys, tokens * m + a), np.searchsorted(keys, tokens * m + b)
        sizes = ends - starts
        total = int(sizes.sum())
        if total:
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
            out += sign * np.bincount(positions[at] - base, minlength=len(out))

    previous = None
    for i in probes:
        a, b = int(lo[i]), int(hi[i])
        out = np.zeros(max(0, b - a), np.int64)
        upto = a
        if previous is not None and a < previous[2]:
            _, pa, pb, answers, tokens = previous
            gone, new = np.setdiff1d(tokens, own[i], True), np.setdiff1d(own[i], tokens, True)
            if len(gone) + len(new) < len(own[i]):
                upto = min(pb, b)
                out[: upto - a] = answers[a - pa : upto - pa]
                read(out, a, new, a, upto, 1)
                read(out, a, gone, a, upto, -1)
        read(out, a, own[i], upto, b, 1)
        previous = (i, a, b, out, own[i])
        yield i, a, out


def _spanning(classes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets: of all pairs, or of those with an asked set and other labels."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((classes, sizes))
    classes, sizes, sets = classes[order], sizes[order], [sets[k] for k in order]
    label = np.arange(len(sets)) if labels is None else np.unique(labels[order], return_inverse=True)[1]
    hi = np.searchsorted(LINKED * sizes, 100 * sizes, side="right")
    if asked is None:
        probes, lo = np.arange(len(sets)), np.arange(1, len(sets) + 1)
    else:
        probes, lo = np.flatnonzero(asked[order]), np.searchsorted(100 * sizes, LINKED * sizes, side="left")
    found = []
    for i, a, shared in overlaps(sets, probes, lo, hi):
        near = a + np.flatnonzero(100 * shared >= LINKED * (sizes[i] + sizes[a : a + len(shared)] - shared))
        for other in np.unique(label[near]):
            if other != label[i]:
                j = near[label[near] == other][0]
                found.append((int(classes[i]), int(classes[j])))
                label[label == other] = label[i]
    return found


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    return frame["cls"].to_numpy(np.int64), [np.frombuffer(s, "<u8") for s in frame["shingles"]]


def _links_inside(members: DataFrame, key: list[str]) -> DataFrame:
    """Spanning links of each cluster, or chunk of one, that meets in a group of ``key``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in frame.drop_duplicates("cls").groupby("cluster"):
            if len(part) > 1:
                found.extend(_spanning(*_unpacked(part)))
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    return members.groupBy(*key).applyInPandas(run, "x long, y long")


def _links_across(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Spanning links between asked sets and members of other components of their cluster, chunk by chunk."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([left.assign(asked=True), right.assign(asked=False)]).drop_duplicates("cls")
        if not both["asked"].any():
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        classes, sets = _unpacked(both)
        found = _spanning(classes, sets, both["component"].to_numpy(np.int64), both["asked"].to_numpy(bool))
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    keys = ["cluster", "i", "j"]
    return asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(run, "x long, y long")


def _chunks(sets: str = "sets", weight: str = "weight"):
    return F.greatest(F.ceil(F.col(sets) / CHUNK_SETS), F.ceil(F.col(weight) / CHUNK_SHINGLES)).cast("long")


def _chunk(count: str):
    return F.pmod(F.xxhash64("cls"), F.col(count))


def _links(docs: DataFrame, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Spanning links of all linked classes, compared within their clusters."""
    wanted = clusters.join(classes, "cls").select("cls", "cluster", "doc_id", "n")
    wanted = stored(wanted, "clustered")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ("text",)):
            sets = [shingles(t) for t in frame["text"]]
            frame = frame.drop(columns="text").assign(shingles=[s.astype("<u8").tobytes() for s in sets])
            frame = frame[[class_of(s) == cls for s, cls in zip(sets, frame["cls"], strict=True)]]
            if len(frame):
                yield frame

    def sets_of(members: DataFrame) -> DataFrame:
        """Members with their sets, read from the texts again: who belongs where is known before, so no set is joined."""
        rows = sized_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), members, "doc_id", "inner")
        return rows.select("text", "cls", "cluster", "n", "chunks").mapInPandas(fetch, "cls long, cluster long, n long, chunks long, shingles binary")

    totals = wanted.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))
    totals = stored(totals.withColumn("chunks", _chunks()), "clusters")
    small = max(1, -(-int(totals.where("chunks = 1").agg(F.sum("weight")).first()[0] or 0) // CHUNK_SHINGLES))
    large = totals.where("chunks > 1").select("cluster", "chunks")
    members = stored(sized_join(wanted, large, "cluster", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))), "members")
    alone = sets_of(members.where("chunks = 1")).withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(small)))
    inside = _links_inside(alone, ["bucket"])
    dealt = stored(sets_of(members.where("chunks > 1")).dropDuplicates(["cls"]), "sets").withColumn("j", _chunk("chunks"))
    first = stored(inside.union(_links_inside(dealt, ["cluster", "j"])), "links")
    if not large.limit(1).count():
        return first
    # Of a large cluster, what its chunks left outside its largest component meets all chunks.
    known = components(first)
    parts = stored(dealt.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "chunks")
    counts = parts.groupBy("cluster", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("sets", "component")).alias("main"), F.sum("sets").alias("all_sets"), F.sum("weight").alias("all_weight"))
    main_weight = counts.select("cluster", "component", F.col("weight").alias("main_weight"))
    rest = main.withColumn("component", F.col("main.component")).join(main_weight, ["cluster", "component"])
    rest = rest.withColumn("sets", F.col("all_sets") - F.col("main.sets")).withColumn("weight", F.col("all_weight") - F.col("main_weight"))
    rest = stored(rest.where("sets > 0").withColumn("strays", F.greatest(_chunks(), F.lit(1).cast("long"))).select("cluster", F.col("component").alias("main"), "strays"), "strays")
    met = sized_join(parts, rest, "cluster", "inner")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["cluster", "i", "j", "cls", "component", "shingles"]
    asked = met.where("component <> main").withColumn("i", _chunk("strays")).drop("j").withColumn("j", each("chunks"))
    asked = asked.select(*[F.col(c).alias(c) for c in columns])  # names of its own, as both sides come from one frame
    return first.union(_links_across(asked, met.withColumn("i", each("strays")).select(*columns)))


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two rows are linked when 100 * shared shingles >= LINKED * all shingles of
    both. ``component_id`` is the least id reachable over links. A row without
    words is linked with nothing and its own component; equal sets are one class
    and travel once; rows without id keep their count but join no class and have no
    component. Repeated rows stay; other columns are ignored. Texts of any length
    count whole, an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    profile = stored(_profile(docs), "profile")
    rows = profile.where("part is null")
    classes = rows.where("cls is not null and doc_id is not null").groupBy("cls")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.max("n").alias("n"), F.max("signature").alias("signature"))
    classes = stored(classes, "classes")
    named = docs.where(F.col("doc_id").isNotNull())
    clusters = components(_candidates(named, _levels(profile), classes)).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    linked = components(_links(named, clusters, classes)).withColumnRenamed("node", "cls")
    joined = classes.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = joined.where("component <> cls or rows > 1 or doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("rows"))
    several = joined.select("cls", "component").join(least.where("rows > 1").select("component", "component_id"), "component").select("cls", "component_id")
    out = sized_join(rows.select("doc_id", F.col("n").alias("n_shingles"), "cls"), stored(several, "components"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
