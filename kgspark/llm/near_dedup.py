"""Near-duplicate groups with HyperMinHash sketches.

A document's set holds its distinct word shingles.  Equal sets are one class, so copies cost one row each.  A class
is sketched by registers, each the leading-zero count and first mantissa bits of the smallest hash in a bucket.  Bands
of registers give candidate buckets.  Inside a bucket members are first held against two centres, not against each other:
that links nearly all that is linked.  Members of a bucket whose components still differ are then held against each
other in blocks of a bounded size; a bucket beyond it is parted by further bands first.  Both times pairs pass the
sketches' estimate of Jaccard similarity, corrected for chance collisions, and are confirmed on the full sets, which
hold a 64-bit hash of each shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, LOWER_BYTES, over_batches, ready, settle, small, spaced_word_hashes, text_bytes, window_hashes

#: Rounds of hashing and buckets of a round; their product is the number of registers.
ROUNDS, BUCKETS = 8, 16
#: Registers of a band, each of another round: bands = ROUNDS * BUCKETS / BAND_ROWS.
BAND_ROWS = 4
#: Mantissa bits of a register, beside the leading-zero count.
MANTISSA = 10
#: Pairs whose estimate is so far below the wanted similarity are not verified: more than five standard errors.
MARGIN = 0.2
#: Members of a bucket, and their shingles, that are held against each other at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Larger buckets are parted by each of so many bands that follow theirs, and so again up to so many times.
FOLLOWING, LEVELS = 8, 3

_rng = np.random.default_rng(20_240_229)
_ODD = (_rng.integers(0, 1 << 63, ROUNDS, np.uint64) << np.uint64(1)) | np.uint64(1)
#: For each register, the order in which buckets are tried if its own is empty (its own comes first).
_PROBES = np.empty((ROUNDS, BUCKETS, BUCKETS), np.int64)
for _j in range(ROUNDS):
    for _b in range(BUCKETS):
        _PROBES[_j, _b] = [_b, *_rng.permutation([x for x in range(BUCKETS) if x != _b])]
_BITS = BUCKETS.bit_length() - 1
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - _BITS)


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text's bytes, A-Z lower-cased; empty without words."""
    return np.unique(window_hashes(spaced_word_hashes(data.translate(LOWER_BYTES)), n))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """ROUNDS x BUCKETS registers of 16 bits of a set that is not empty.

    An empty bucket takes the register of the first bucket in its probe order that is not, so two sets agree in a
    register about as often as they are similar, however small they are.
    """
    hashed = np.sort(shingles[None, :] * _ODD[:, None], axis=1)
    at = np.stack([np.searchsorted(row, _BOUNDS) for row in hashed])
    smallest = np.take_along_axis(hashed, np.minimum(at, len(shingles) - 1), axis=1)
    full = (at < len(shingles)) & (smallest >> np.uint64(64 - _BITS) == np.arange(BUCKETS, dtype=np.uint64))
    rest = ((smallest << np.uint64(_BITS)) >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    fraction, exponent = np.frexp(rest)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    registers = ((53 - exponent) << MANTISSA) | mantissa
    rounds = np.arange(ROUNDS)[:, None]
    tried = full[rounds[:, :, None], _PROBES]
    source = np.take_along_axis(_PROBES, tried.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
    return registers[rounds, source].astype(np.uint16)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often a register of two unrelated sets of n and m elements agrees by chance.

    Smallest values of a bucket are about exponential with rate n / BUCKETS; the sum runs over leading-zero counts, in
    each of which a cell is 2**-MANTISSA of the interval.
    """
    a, b = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    low = 2.0 ** -(np.arange(53) + 1)[None, :]
    s = a + b
    return (a * b * low / (1 << MANTISSA) / s * (np.exp(-s * low) - np.exp(-2 * s * low))).sum(axis=1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs (rows of registers, set sizes), corrected for chance collisions."""
    agree = (x == y).mean(axis=1)
    chance = collision_rate(n.astype(float), m.astype(float))
    return (agree - chance) / (1 - chance)


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, n_shingles, key (digest of the set) and sketch of every document."""

    def rows_of(batch):
        n, keys, sketches = [], [], []
        for data in batch.column("__bytes").to_pylist():
            s = shingle_set(data, words)
            n.append(len(s))
            keys.append(_digest(s))
            sketches.append(sketch(s).tobytes() if len(s) else None)
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "key": keys, "sketch": sketches}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = over_batches(docs.select("doc_id", text_bytes().alias("__bytes")), rows_of, f"doc_id {kind}, n_shingles bigint, key binary, sketch binary")
    return settle(scanned.withColumn("row", F.monotonically_increasing_id()))


def _bands(sketches: DataFrame) -> DataFrame:
    """band, slot, node: a row for each band of each sketch; slot is which band it is."""

    def rows_of(batch):
        nodes = np.asarray(batch.column("node"))
        registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(nodes), ROUNDS // BAND_ROWS, BAND_ROWS, BUCKETS)
        packed = registers.transpose(0, 1, 3, 2).astype(np.uint64) << (np.arange(BAND_ROWS, dtype=np.uint64) * np.uint64(16))
        packed = np.bitwise_or.reduce(packed, axis=3).reshape(len(nodes), -1)
        return {"band": packed.ravel().view(np.int64), "slot": np.tile(np.arange(packed.shape[1], dtype=np.int32), len(nodes)), "node": np.repeat(nodes, packed.shape[1])}

    exact = over_batches(sketches.select("node", "sketch"), rows_of, "band bigint, slot int, node bigint")
    return exact.select(F.xxhash64("band", "slot").alias("band"), "slot", "node")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, set: the full sets of some classes, made anew from one text of each."""
    wanted = settle(nodes.join(classes, "node").select("node", "key", "first_id"))

    def sets_of(batch):
        sets = [shingle_set(data, words) for data in batch.column("__bytes").to_pylist()]
        return {"key": [_digest(s) for s in sets], "set": [s.tobytes() for s in sets]}

    ids = small(wanted.select(F.col("first_id").alias("__id")).distinct(), 1_000_000)
    texts = docs.select("doc_id", text_bytes().alias("__bytes")).join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = over_batches(texts.select("__bytes"), sets_of, "key binary, set binary").join(small(wanted.select("node", "key"), 1_000_000), "key")
    return settle(sets.groupBy("node").agg(F.first("set").alias("set")))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have percent / 100 or more of their union in common."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a")
    sized = sized.filter((F.least("n_a", "n_b") * 100) >= F.greatest("n_a", "n_b") * percent)

    def near(batch):
        n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(n), -1) for c in ("sketch_a", "sketch_b"))
        keep = estimate(x, y, n, m) >= percent / 100 - MARGIN if len(n) else np.empty(0, bool)
        return {c: np.asarray(batch.column(c))[keep] for c in ("a", "b")}

    likely = settle(over_batches(sized, near, "a bigint, b bigint"))
    if likely.isEmpty():
        return likely
    sets = _sets(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), classes, docs, words)

    def verified(batch):
        a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
        keep = np.zeros(len(a), bool)
        for i, (s, t) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return {"a": a[keep], "b": b[keep]}

    both = likely.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return settle(over_batches(both, verified, "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that is not its own root.

    Large-star and small-star steps on distributed edges until they change nothing.
    """

    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        m = smallest(both).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        m = smallest(down)
        linked = down.join(m, "u")
        return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = state(e)
    while before[0]:
        e = settle(small_star(large(e)))
        if (now := state(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _from_centres(members: DataFrame) -> DataFrame:
    """a, b: two centres of each bucket with its other members; at most two pairs for each member.

    One is the member that shares most buckets, which lies amid its group; the other is drawn by hash.
    """
    top = F.max_by("node", F.struct("score", -F.col("node"))), F.max_by("node", F.struct(F.xxhash64("node"), "node"))
    centres = members.groupBy("band").agg(F.array_distinct(F.array(*top)).alias("centres"))
    return members.join(centres, "band").select(F.explode("centres").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _groups(batches, key: tuple[str, ...]):
    """Tables of the rows of each key, from batches that are sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        columns = [np.asarray(table.column(c)) for c in key]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(table) else np.empty(0, int)
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest
    rest = table = batch = None
    give_back()


_KEY = ("band", "block", "part")


def _sizes(members: DataFrame) -> DataFrame:
    """band, blocks, main (the component with most members) and minor (how many are of others), of buckets with several."""
    parts = members.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).groupBy("band")
    sizes = parts.agg(F.count("*").alias("parts"), F.sum("n").alias("rows"), F.sum("shingles").alias("shingles"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return settle(sizes.filter("parts > 1").select("band", blocks.alias("blocks"), "main", (F.col("rows") - F.col("most")).alias("minor")))


def _parted(members: DataFrame, bands: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of members (band, slot, node, comp, n) with the sizes of their bucket, and whether any was parted.

    Members of a bucket with more than a block of minor members are dealt to the buckets that they share with a band
    after theirs as well: similar ones share a third of all bands or more, others seldom do.  So a row becomes FOLLOWING
    rows a level, whatever the size of its bucket.  Buckets that are still large after LEVELS are left as they are.
    """
    out, parted = None, False
    n_bands = ROUNDS * BUCKETS // BAND_ROWS
    for level in range(LEVELS + 1):
        sized = members.join(_sizes(members), "band")
        fits = sized.filter(F.col("minor") <= BLOCK) if level < LEVELS else sized
        out = fits if out is None else out.unionByName(fits)
        large = settle(sized.filter(F.col("minor") > BLOCK).select("band", "slot", "node", "comp", "n")) if level < LEVELS else None
        if large is None or large.isEmpty():
            break
        parted = True
        later = large.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(FOLLOWING)))).withColumn("slot", F.pmod(F.col("slot") + F.col("step"), F.lit(n_bands)))
        later = later.join(bands.select("node", "slot", F.col("band").alias("other")), ["node", "slot"])
        members = settle(later.select(F.xxhash64("band", "other", "step").alias("band"), "slot", "node", "comp", "n"))
    return settle(out), parted


def _in_blocks(sized: DataFrame) -> DataFrame:
    """Rows of sized (see ``_parted``) by block, with part and visits.

    Each member is at home in one block of its bucket, and minor ones visit every block to be held against those at
    home.  Of two members of different components one is minor, so they meet.  If more than BLOCK visit, they come in
    parts, and those at home are there for each part.
    """
    parts = F.ceil(F.col("minor") / BLOCK).cast("int")
    home, visit = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit("visit")), parts).cast("int")
    once = sized.filter(F.col("minor") <= BLOCK).withColumns({"block": home, "part": F.lit(0)})
    again = sized.filter(F.col("minor") > BLOCK).withColumn("block", home).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    visits = sized.filter("comp <> main").withColumn("part", visit).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["band", "block", "part", "slot", "node", "comp", "n"]
    at_home = once.select(*columns).unionByName(again.select(*columns)).withColumn("visits", F.lit(False))
    return at_home.unionByName(visits.select(*columns).withColumn("visits", F.lit(True)))


def _across(members: DataFrame, bands: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between members of a bucket that are of different components, one for each two components met.

    First the sketches leave only members that have a likely partner in the bucket, each pair in the first band that
    it shares (in each band, if buckets were parted); then the full sets of these are held against each other.
    """
    sized, parted = _parted(members.select("band", "slot", "node", "comp").join(classes.select("node", "n"), "node"), bands)
    rows = _in_blocks(sized).join(classes.select("node", "sketch"), "node")
    least = percent / 100 - MARGIN

    def likely(batches):
        for t in _groups(batches, _KEY):
            n, comp, visits = (np.asarray(t.column(c)) for c in ("n", "comp", "visits"))
            x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(n), -1)
            slot = t.column("slot")[0].as_py()
            left, right = np.flatnonzero(visits), np.flatnonzero(~visits)
            keep = np.zeros(len(n), bool)
            for k in range(0, len(left), 32):
                i = left[k : k + 32]
                agree = x[i][:, None, :] == x[right][None, :, :]
                m, o = np.broadcast_to(n[i][:, None], agree.shape[:2]), np.broadcast_to(n[right][None, :], agree.shape[:2])
                good = (comp[i][:, None] != comp[right][None, :]) & (np.minimum(m, o) * 100 >= np.maximum(m, o) * percent)
                good &= agree.mean(axis=2) >= least
                if not parted:
                    good &= agree.reshape(len(i), len(right), ROUNDS // BAND_ROWS, BAND_ROWS, BUCKETS).all(axis=3).reshape(len(i), len(right), -1).argmax(axis=2) == slot
                a, b = np.nonzero(good)
                if len(a):
                    # chance agreement only lowers an estimate, so those below without the correction are out already
                    chance = collision_rate(m[a, b].astype(float), o[a, b].astype(float))
                    sure = (agree.mean(axis=2)[a, b] - chance) / (1 - chance) >= least
                    keep[i[a[sure]]] = keep[right[b[sure]]] = True
            if keep.any():
                yield from t.select([*_KEY, "visits", "node", "comp"]).filter(pa.array(keep)).combine_chunks().to_batches()

    by_key = lambda df: df.repartition(*_KEY).sortWithinPartitions(*_KEY)
    ready(docs.sparkSession)
    found = settle(by_key(rows).mapInArrow(likely, "band bigint, block int, part int, visits boolean, node bigint, comp bigint"))
    if found.isEmpty():
        return found.select(F.col("node").alias("a"), F.col("node").alias("b"))
    full = found.join(_sets(found.select("node").distinct(), classes, docs, words), "node")

    def linked(batches):
        for t in _groups(batches, _KEY):
            nodes, comp, visits = (np.asarray(t.column(c)) for c in ("node", "comp", "visits"))
            left, right = np.flatnonzero(visits), np.flatnonzero(~visits)
            if not (len(left) and len(right)):
                continue
            column = t.column("set")
            sets = [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in right]
            sizes = np.array([len(s) for s in sets])
            names, codes = np.unique(np.concatenate(sets), return_inverse=True)
            starts, mine, met = np.cumsum(sizes) - sizes, np.zeros(len(names), np.int32), set()
            out: list[tuple[int, int]] = []
            for i in left:
                own = np.frombuffer(column[int(i)].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                at = at[names[at] == own]
                mine[at] = 1
                common = np.add.reduceat(mine[codes], starts)
                mine[at] = 0
                good = (100 * common >= percent * (sizes + len(own) - common)) & (comp[right] != comp[i])
                for j in right[good]:
                    pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                    if pair not in met:
                        met.add(pair)
                        out.append((nodes[i], nodes[j]))
            if out:
                a, b = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return settle(by_key(full).mapInArrow(linked, "a bigint, b bigint"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included) and kept.

    docs: doc_id, text.  Texts without words have an empty set and are linked with nothing, themselves kept.  A null
    doc_id joins its group but names it only if no other does.  Repeated rows are alike; rows of one doc_id with
    different texts may be in different groups.  No rows in, no rows out.
    """
    scanned = _scan(docs, words)
    by_key = settle(scanned.filter("n_shingles > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n")))
    classes = settle(scanned.select(F.col("row").alias("node"), "sketch").join(by_key, "node"))
    bands = settle(_bands(classes))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = settle(bands.join(shared, "band"))
    scores = members.groupBy("node").agg(F.sum("size").alias("score"))
    members = settle(members.drop("size").join(scores, "node").withColumn("comp", F.col("node")))
    links = None
    if not members.isEmpty():
        pairs = settle(_from_centres(members).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = _confirmed(pairs, classes, docs, words, percent)
        roots = settle(components(links))
        more = _across(_labelled(members, roots), bands, classes, docs, words, percent)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if not more.isEmpty():
            links = settle(components(links.union(more))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    labelled = by_key.select("key", "node", "first_id")
    if links is not None:
        labelled = labelled.join(links.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left")
    else:
        labelled = labelled.withColumn("root", F.lit(None).cast("bigint"))
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    named = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(labelled.join(named, "root").select("key", "component_id"))
    rows = scanned.select("doc_id", "n_shingles", "key")
    grouped = rows.filter("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the columns of docs: that with the smallest doc_id.

    Of rows with the same doc_id and text one stays; texts without words all stay.
    """
    groups = settle(near_groups(docs, words, percent).filter("kept"))
    repeated = small(settle(groups.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id"))))
    ids = small(groups.select(F.col("doc_id").alias("__id")).distinct(), 1_000_000)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    stay = docs.join(ids, same, "left_semi")
    once = stay.join(repeated, same, "left_anti")
    twice = stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice).select(*docs.columns)
