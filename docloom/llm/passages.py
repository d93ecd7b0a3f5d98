"""Substring dedup: near-duplicate passages across documents by compact windows over min-hashes of tokens.

Tokens are 48-bit hashes of five-word shingles, at the place of their first word. A passage has ``least_words`` words
or more; two are near duplicates if the sets of their tokens have a likeness of ``percent``.

1. Batches of documents send their tokens, with places, to ranges of the token space; tokens met in two documents or
   more go back. Only regions in which runs of ``least`` tokens are mostly such tokens can hold a passage that repeats.
   Exact copies of a text are known by a digest of its words: one of them goes on.
2. Over a region's tokens each of several hash functions has a Cartesian tree: the least token of a span is its root,
   and the spans beside it are its subtrees; places of equal tokens share a root, so repetitive text makes flat trees.
   A node with its span is a compact window: every run inside the span that covers the node has that node's token as
   its min-hash. Spans shorter than a passage are left out.
3. Windows of neighbouring hash functions whose intervals overlap by a passage's length are joined: runs inside both
   share two min-hashes. Regions of equal tokens are copies, and one of them goes on. Regions that have the same two
   min-hashes in such a joint window are candidates. First they are ordered by a third min-hash, and each is paired with
   the first of those that have its third, or the first of these with the first of all.
4. Candidates are verified on the tokens themselves: the stretches of either region that are mostly tokens of the
   other must be long enough, and their sets alike enough. Passages that are linked, or overlap by half the least length
   or more, are of one class.
5. Every other pair of candidates is tried unless the nodes of both windows lie in passages of one class already, on
   sketches of the tokens around the nodes: each must lie in a run that is mostly tokens of the other's surroundings.
   Large groups are met in pairs of blocks. Pairs that would join classes or regions of none are verified first, then,
   under the classes that result, every pair left of the groups that have more. No pair is tried twice.

With 6 hash functions in a ring, two passages of likeness 0.75 agree under two neighbours with probability 0.962 at any
one place (0.981 at 0.80); longer passages have several places. README has the recall that was measured.

Edge cases: null, empty and short texts have no passages; a passage that repeats within one document alone is not
reported; an exact copy of 50 words or more reports its whole text; two texts that repeat an id are two documents; rows
without an id are left out; texts are read whole; an empty table gives no rows. Row keys hold under the condition that
``ngram_join`` states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import Scratch, map_batches, raw_texts, slices
from docloom.llm.components import connected_components
from docloom.llm.ngram_join import _SENT, _pack, _rows, _unpack, by_group, count_ranges, range_edges, ranges_of, token_batches
from docloom.llm.shingles import U, mix, shingle_hashes, spread, word_hashes

TOKEN_BITS = 48
HASHES = 6
_SEEDS = spread(1 << 41, HASHES)


def _pack_places(places: np.ndarray) -> bytes:
    """Places in a batch, in three bytes each where those are enough."""
    width = 3 if not len(places) or places.max() < 1 << 24 else 4
    return bytes([width]) + places.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpack_places(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    full = np.zeros((len(raw), 4), np.uint8)
    full[:, : data[0]] = raw
    return full.view(np.uint32).ravel()


def send_places(docs: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """Per batch of documents and range of tokens: the tokens and their places; and per batch ids, sizes and text digests.

    Kind 1 holds the first place of each token in each document, kind 2 the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = range_edges(buckets) >> U(64 - TOKEN_BITS)
        for name, batch in token_batches(batches):
            tokens, sizes, keys = [], [], []
            for part in slices(batch):
                raw = [(t or b"").lower() for t in raw_texts(part)]
                keys += [hashlib.md5(b" ".join(t.split()), usedforsecurity=False).digest() for t in raw]
                # a text shorter than a shingle has no place for one
                texts = [t if len(t.split(None, shingle)) >= shingle else b"" for t in raw]
                words, counts = word_hashes(texts)
                h, _ = shingle_hashes(words, counts, shingle)
                tokens.append(h >> U(64 - TOKEN_BITS))
                sizes.append(np.maximum(0, counts - shingle + 1))
            t, n = np.concatenate(tokens), np.concatenate(sizes).astype(np.int32)
            del tokens
            order = np.argsort(t, kind="stable").astype(np.uint32)
            t = t[order]
            owner = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])
            del owner
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            out = [(name % buckets, name, 0, 0, ids.tobytes(), n.tobytes(), b"".join(keys))]
            for b, some in ranges_of(t, edges):
                for kind, mask in ((1, first[some]), (2, ~first[some])):
                    if mask.any():
                        width, data = _pack(t[some][mask])
                        out.append((b, name, kind, width, data, _pack_places(order[some][mask]), None))
            yield _rows(out)

    return map_batches(docs.select("doc_id", "text"), run, _SENT)


def met_again(sent: DataFrame) -> DataFrame:
    """The same rows, cut down to tokens of two documents or more."""

    def count(rows: list[tuple]) -> pa.RecordBatch:
        out, runs = [r for r in rows if r[2] == 0], [r for r in rows if r[2] > 0]
        everything = np.concatenate([np.zeros(0, U), *(_unpack(r[3], r[4]) for r in runs if r[2] == 1)])
        everything.sort()
        again = np.unique(everything[1:][everything[1:] == everything[:-1]])
        del everything
        for r in runs if len(again) else ():
            t = _unpack(r[3], r[4])
            hit = again[np.minimum(np.searchsorted(again, t), len(again) - 1)] == t
            if hit.any():
                width, data = _pack(t[hit])
                out.append((r[0], r[1], r[2], width, data, _pack_places(_unpack_places(r[5])[hit]), None))
        return _rows(out)

    return by_group(sent, "bucket", count, _SENT)


def dense_share(percent: int) -> float:
    """Percent of a run's tokens that it has in common with a run of equal length, if their likeness is ``percent``."""
    return 200 * percent / (100 + percent)


def dense_runs(flags: np.ndarray, least: int, share: float, trim: bool = True) -> list[tuple[int, int]]:
    """Maximal [start, end) made of runs of ``least`` places of which ``share`` percent are set, cut to set ends if ``trim``."""
    if len(flags) < least:
        return []
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    if 100 * total[-1] < share * least:
        return []
    good = np.flatnonzero(total[least:] - total[:-least] >= -(-share * least // 100))
    if not len(good):
        return []
    breaks, out = np.flatnonzero(good[1:] - good[:-1] > least).tolist(), []
    for a, b in zip([0, *(i + 1 for i in breaks)], [*breaks, len(good) - 1], strict=True):
        lo, hi = int(good[a]), int(good[b]) + least
        if trim:
            inside = np.flatnonzero(flags[lo:hi])
            lo, hi = lo + int(inside[0]), lo + int(inside[-1]) + 1
        out.append((lo, hi))
    return out


_FOUND = "row long, doc_id long, key binary, size int, start int, tokens array<long>"


def regions(again: DataFrame, least: int, percent: int) -> DataFrame:
    """For each document of ``least`` tokens or more a row of its own, and one for each region that can hold a passage.

    The document's row has no start and no tokens. In a region, a token met in no other document is -1.
    """

    def gather(rows: list[tuple]) -> pa.RecordBatch:
        head = next(r for r in rows if r[2] == 0)
        ids, sizes = np.frombuffer(head[4], np.int64), np.frombuffer(head[5], np.int32).astype(np.int64)
        line = np.full(int(sizes.sum()), -1, np.int64)
        for r in rows:
            if r[2] > 0:
                line[_unpack_places(r[5])] = _unpack(r[3], r[4]).astype(np.int64)
        out, ends = [], np.cumsum(sizes)
        for i in np.flatnonzero(sizes >= least).tolist():
            named = ((head[1] << 16) + i, int(ids[i]), head[6][16 * i : 16 * i + 16], int(sizes[i]))
            out.append((*named, None, None))
            own = line[ends[i] - sizes[i] : ends[i]]
            out += [(*named, lo, own[lo:hi]) for lo, hi in dense_runs(own >= 0, least, dense_share(percent), trim=False)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["row", "doc_id", "key", "size", "start", "tokens"])

    return by_group(again, "batch", gather, _FOUND)


def compact_windows(h: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last node, start, end) for the nodes of the Cartesian tree over ``h`` whose span is at least ``least`` long.

    Places of the least value of a span are one node, so a run inside the span has that min-hash if it covers any.
    """
    spans = [(0, len(h))]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < least:
            continue
        own = h[lo:hi]
        c = int(own.argmin())
        nodes = (own == own[c]).nonzero()[0]
        if len(nodes) == 1:
            yield lo + c, lo + c, lo, hi
            spans += ((lo, lo + c), (lo + c + 1, hi))
        else:
            yield lo + c, lo + int(nodes[-1]), lo, hi
            edges = [lo - 1, *(lo + nodes).tolist(), hi]
            spans += [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > least]


def overlapping(one: np.ndarray, other: np.ndarray, least: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An interval join of two sets of compact windows (rows of four): which overlap by ``least`` places with nodes of both there.

    Places in the two sets, and start and end of the joint intervals. Large sets are met in blocks: those of the first
    set, in order of their starts, with the windows of the second that begin before a block ends and end after it begins.
    """

    def met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, last, start, end = x.T[:, :, None]
        lo, hi = np.maximum(start, y[:, 2]), np.minimum(end, y[:, 3])
        i, j = np.nonzero((hi - lo >= least) & (last >= lo) & (first < hi) & (y[:, 1] >= lo) & (y[:, 0] < hi))
        return i, j, lo[i, j], hi[i, j]

    if len(one) * len(other) <= most:
        return met(one, other)
    order, near = np.argsort(one[:, 2], kind="stable"), np.argsort(other[:, 2], kind="stable")
    starts, out, size = other[near, 2], [], max(1, most // len(other))
    for at in range(0, len(order), size):
        block = order[at : at + size]
        some = near[: np.searchsorted(starts, one[block, 3].max())]
        some = some[other[some, 3] > one[block, 2].min()]
        i, j, lo, hi = met(one[block], other[some])
        out.append((block[i], some[j], lo, hi))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def joint_windows(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs of min-hashes that windows of neighbouring hash functions share, each with a third min-hash and a place.

    Keys are distinct and ascend. The place is the first one's node. The third is the least value of another hash function near the first one's node.
    """
    lone = tokens < 0
    hashes = mix(tokens.view(U) ^ _SEEDS[:, None])
    hashes[:, lone] = ~U(0)
    windows = [np.array([w for w in compact_windows(h, least) if not lone[w[0]]], np.int64).reshape(-1, 4) for h in hashes]
    # least values of runs, by doubling: of 2 * half places ahead, cut short at the end
    half = 1 << (least.bit_length() - 2)
    around = hashes.copy()
    for width in (1 << i for i in range(half.bit_length())):
        around[:, :-width] = np.minimum(around[:, :-width], around[:, width:])
    met = [np.zeros((3, 0), np.int64)]
    for k in range(HASHES):
        other = (k + 1) % HASHES
        if len(windows[k]) and len(windows[other]):
            i, j, _, _ = overlapping(windows[k], windows[other], least)
            met.append(np.stack((np.full(len(i), k), windows[k][i, 0], windows[other][j, 0])))
    k, x, y = np.concatenate(met, axis=1)
    keys = mix(mix(hashes[k, x] ^ (k + 1).view(U)) + hashes[(k + 1) % HASHES, y])
    made, first = np.unique(keys.view(np.int64), return_index=True)
    k, x = k[first], x[first]
    return made, around[(k + 3) % HASHES, np.maximum(0, x - half)].view(np.int64), x


_WINDOWS = "key long, third long, region long, owner long, place int"
_MET = "key long, region long, owner long, place int, n long, other long"


def _record(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def region_windows(found: DataFrame, least: int) -> DataFrame:
    """Joint windows of all regions, each with the place of its first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [joint_windows(np.asarray(x.values), least) for x in batch.column("tokens")]
            n = [len(keys) for keys, _, _ in made]
            key, third, place = (np.concatenate([m[i] for m in made] or [np.zeros(0, np.int64)]) for i in range(3))
            region, owner = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), n) for c in ("region", "owner"))
            for at in range(0, len(key), 200_000):
                yield _record([c[at : at + 200_000] for c in (key, third, region, owner, place.astype(np.int32))], _WINDOWS)

    return map_batches(found.select("region", "owner", "tokens"), run, _WINDOWS)


def led_windows(windows: DataFrame) -> DataFrame:
    """The first pairs (region, other) to verify, in rows without a key, and the windows that three regions or more share.

    ``n`` is the number of a key's windows; all but those of one owner count. Regions of one key stand in order of their third min-hash: each is paired with the first one of that, or, if it is
    this one itself, with the first of all. ``open_pairs`` makes the others.
    """

    def meet(x: np.ndarray) -> list[pa.RecordBatch]:
        key, third, region, owner, place = x
        at = np.arange(len(key))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(fresh)
        apart = np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)
        of_key = np.cumsum(fresh) - 1
        kept, n = apart[of_key], np.diff(begins, append=len(key))[of_key]
        alike = ~fresh
        alike[1:] &= third[1:] == third[:-1]
        first, head = (np.maximum.accumulate(np.where(m, at, 0)) for m in (fresh, ~alike))
        lead = np.where(head == at, first, head)
        i = np.flatnonzero(kept & (owner != owner[lead]))
        pairs = np.unique(np.sort(np.stack([region[i], region[lead[i]]], axis=1), axis=1), axis=0)
        none = lambda n: pa.nulls(n, pa.int64())
        kept &= n > 2  # the one pair of two regions is among the first
        shared = [c[kept] for c in (key, region, owner, place.astype(np.int32), n)]
        return [
            _record([*shared, none(int(kept.sum()))], _MET),
            _record([none(len(pairs)), pairs[:, 0], none(len(pairs)), pa.nulls(len(pairs), pa.int32()), none(len(pairs)), pairs[:, 1]], _MET),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the key at hand
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not x.shape[1]:
                continue
            if not held or held[0][0, 0] != x[0, -1]:
                cut = int(np.searchsorted(x[0], x[0, -1]))
                if held or cut:
                    yield from meet(np.concatenate([*held, x[:, :cut]], axis=1))
                held, x = [], x[:, cut:]
            held.append(x)
        if held:
            yield from meet(np.concatenate(held, axis=1))

    return map_batches(windows.repartition("key").sortWithinPartitions("key", "third", "region"), run, _MET)


def passage_classes(links: DataFrame, least: int, tmp: Scratch) -> DataFrame:
    """(region, lo, hi, label, other, lo2, hi2): stretches of regions that verified passages cover, by class, each next to one passage.

    Passages of a region that overlap by half of ``least`` are one stretch, so a region has at most as many as its
    length gives room for. The passage is one of an exact copy or else the longest.
    """
    ids = links.withColumn("id", F.xxhash64("region", "lo", "hi", "other", "lo2", "hi2"))
    sides = ids.select("id", *_LINK).union(ids.where("region <> other").select("id", *_LINK[3:], *_LINK[:3]))
    before = Window.partitionBy("region").orderBy("lo", "hi")
    reach = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begun = sides.withColumn("from", F.when(reach.isNull() | (F.col("lo") > reach - least // 2), F.col("lo")))
    named = begun.withColumn("from", F.last("from", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    named = tmp.store(named.withColumn("node", F.xxhash64("region", "from")))
    labels = connected_components(named.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).select("u", "v"), tmp)
    best = F.max_by(F.struct("other", "lo2", "hi2"), F.struct(F.col("region") == F.col("other"), F.col("hi") - F.col("lo"), -F.col("other"), -F.col("lo2"), F.col("hi2")))
    stretches = named.groupBy("region", F.col("from").alias("begin"), "node").agg(F.max("hi").alias("end"), best.alias("o"))
    label = F.coalesce("component", "node").alias("label")
    out = tmp.store(stretches.join(labels, "node", "left").select("region", F.col("begin").alias("lo"), F.col("end").alias("hi"), label, "o.*"))
    tmp.drop(named, labels)
    return out


#: Regions of a key that are met in one block, and bits of a sketch.
_BLOCK, _BITS = 512, 1 << 14


def labelled(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``shared`` with the class of the stretch that a window's first node lies in, in keys whose nodes are not all of one class."""
    spans = classes.groupBy("region").agg(F.collect_list(F.struct("lo", "hi", "label")).alias("spans"))
    label = F.expr("array_min(transform(filter(spans, s -> place >= s.lo and place < s.hi), s -> s.label))")
    of_key = Window.partitionBy("key")
    placed = shared.join(spans, "region", "left").withColumn("label", label).drop("spans").withColumn("known", F.count("label").over(of_key))
    placed = placed.withColumn("low", F.min("label").over(of_key)).withColumn("high", F.max("label").over(of_key))
    return placed.where("not (known = n and low = high)").drop("known", "low", "high")


def partners(pairs: DataFrame) -> DataFrame:
    """``tried``: of each region the others it was verified with; a pair is listed once, where fewer are."""
    degree = pairs.select("region").union(pairs.select("other")).groupBy("region").agg(F.count("*").alias("d"))
    met = pairs.join(degree, "region").join(degree.select(F.col("region").alias("other"), F.col("d").alias("e")), "other")
    here = F.col("d") <= F.col("e")
    sided = met.select(F.when(here, F.col("region")).otherwise(F.col("other")).alias("region"), F.when(here, F.col("other")).otherwise(F.col("region")).alias("o"))
    return sided.groupBy("region").agg(F.collect_list("o").alias("tried"))


_SKETCHED = (
    "key long, region long, owner long, place int, label long, n long, tried array<long>, "
    "several boolean, far boolean, lost int, doubled int, line binary, around binary"
)


def _distinct(tokens: np.ndarray) -> np.ndarray:
    """The tokens in order, each once, without -1."""
    x = np.sort(tokens)
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    fresh[: np.searchsorted(x, 0)] = False
    return x[fresh]


def sketches(open_: DataFrame, found: DataFrame, tried: DataFrame, least: int) -> DataFrame:
    """The windows with sketches of the tokens around their first node, as 16-bit places of bits.

    ``line``: of each place less than ``least`` places away, in order, 65,535 where a token is met in no other document;
    its tokens are by ``doubled`` more than its bits. ``around``: the further bits of places up to twice as far, or of 20
    times as far where tokens repeat nearby. If the node's token has ``several`` places, those near any. ``lost``: by how
    many the bits are fewer than the tokens. ``far``: nearly all that is around repeats, so a passage may get its tokens
    from further away. Windows of one place share a sketch.
    """

    def some(tokens: np.ndarray, nodes: np.ndarray, far: int) -> np.ndarray:
        if len(nodes) == 1:
            near = tokens[max(0, nodes[0] - far) : nodes[0] + far + 1]
        else:
            inside = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(inside, np.maximum(0, nodes - far), 1)
            np.add.at(inside, np.minimum(len(tokens), nodes + far + 1), -1)
            near = tokens[np.cumsum(inside[:-1]) > 0]
        return near

    def sketch(tokens: np.ndarray, place: int, set_: np.ndarray) -> tuple:
        nodes = np.flatnonzero(tokens == tokens[place])
        near = some(tokens, nodes, least - 1)
        held = near[near >= 0]
        repeats = len(_distinct(held)) < len(held)
        slice_ = some(tokens, nodes, (20 if repeats else 2) * least)
        wide = _distinct(slice_)
        both, own = _distinct(wide & (_BITS - 1)), held & (_BITS - 1)
        set_[own] = True
        around = both[~set_[both]]
        set_[own] = False
        line = np.where(near < 0, 65535, near & (_BITS - 1)).astype(np.uint16)
        far = repeats and len(slice_) < len(tokens) and len(wide) < 2 * least
        doubled = len(held) - (len(both) - len(around))
        return len(nodes) > 1, far, len(wide) - len(both), doubled, line.tobytes(), around.astype(np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_, names = np.zeros(_BITS, bool), ("key", "place", "label", "n")
        for batch in batches:
            out: list[tuple] = []
            for region, owner, tried, windows, line in zip(*(batch.column(c).to_pylist() for c in ("region", "owner", "tried")), batch.column("windows"), batch.column("tokens"), strict=True):
                tokens, made = np.asarray(line.values), {}
                for key, place, label, n in zip(*(windows.values.field(c).to_pylist() for c in names), strict=True):
                    if place not in made:
                        made[place] = sketch(tokens, place, set_)
                    out.append((key, region, owner, place, label, n, tried, *made[place]))
                    if len(out) == 5_000:
                        yield _record(list(zip(*out, strict=True)), _SKETCHED)
                        out = []
            if out:
                yield _record(list(zip(*out, strict=True)), _SKETCHED)

    listed = open_.groupBy("region").agg(F.collect_list(F.struct("key", "place", "label", "n")).alias("windows"))
    with_tokens = listed.join(found, "region").join(tried, "region", "left")
    return map_batches(with_tokens.select("region", "owner", "tried", "windows", "tokens"), run, _SKETCHED)


_OPEN = "region long, other long, key long"


def open_pairs(placed: DataFrame, least: int, percent: int, spanning: bool) -> DataFrame:
    """Pairs (region, other) that share a joint window, but for those tried and those whose nodes lie in passages of one class.

    A passage that covers the node has a run of ``least`` places around it, most of which hold tokens of the other
    region's passage. Pairs whose sketches show fewer are left out. ``spanning``: of the pairs of a block those that join
    its classes and regions of none, if all of them are links; a row with nothing but the key stands for the others.
    """
    enough = int(-(-dense_share(percent) * least // 100))
    blocks = F.ceil(F.col("n") / _BLOCK)
    met = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("region"), "blocks"))
    met = met.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met"))
    columns = ("region", "owner", "label", "own", "several", "far", "lost", "doubled", "line", "around", "tried", "key")

    def meet(rows: list[tuple]) -> pa.RecordBatch:
        _, region, owner, label, own, several, far, lost, doubled, line, around, tried, key = zip(*rows, strict=True)
        region, owner, own, lost, doubled = (np.array(c, np.int64) for c in (region, owner, own, lost, doubled))
        several, far = np.array(several), np.array(far)
        # regions of no class are groups of their own
        known = np.array([x is not None for x in label])
        group = np.unique(np.array([x or 0 for x in label], np.int64), return_inverse=True)[1]
        group = np.where(known, group, len(rows) + np.arange(len(rows)))
        two = (own != own[0]).any()  # two blocks: each is a tile of its own too
        a, b = (np.flatnonzero(own == own[0]), np.flatnonzero(own != own[0])) if two else (np.arange(len(rows)),) * 2
        apart = (owner[a, None] != owner[b]) & (region[a, None] != region[b]) & (group[a, None] != group[b])
        if not two:
            apart = np.tril(apart)
        others = np.array([x for t in tried for x in t or ()], np.int64)
        order = np.argsort(region)
        at = order[np.minimum(np.searchsorted(region, others, sorter=order), len(rows) - 1)]
        held = region[at] == others
        done = np.zeros((len(rows), len(rows)), bool)
        done[np.repeat(np.arange(len(rows)), [len(t or ()) for t in tried])[held], at[held]] = True
        apart &= ~(done | done.T)[a[:, None], b]
        if not apart.any():
            return _record([[], [], []], _OPEN)
        # bits of two rows or more are columns; the last column stays empty
        n_line, n_around = (np.array([len(x) // 2 for x in c]) for c in (line, around))
        of_line, of_around = (np.frombuffer(b"".join(c), np.uint16) for c in (line, around))
        held = of_line < _BITS
        bits = np.flatnonzero(np.bincount(of_line[held], minlength=_BITS) + np.bincount(of_around, minlength=_BITS) > 1)
        column = np.full(1 << 16, len(bits), np.int32)
        column[bits] = np.arange(len(bits))
        row = np.repeat(np.arange(len(rows)), n_line)
        near = np.zeros((len(rows), len(bits) + 1), bool)
        near[row, column[of_line]] = True
        wide = near.copy()
        wide[np.repeat(np.arange(len(rows)), n_around), column[of_around]] = True
        near[:, -1] = wide[:, -1] = False
        lines = np.full((len(rows), 2 * least - 1), len(bits), np.int32)
        single = ~several[row]
        lines[row[single], (np.arange(len(row)) - np.repeat(np.cumsum(n_line) - n_line, n_line))[single]] = column[of_line[single]]

        def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), len(y)), np.float32)
            for at in range(0, len(bits), 2048):
                out += x[:, at : at + 2048].astype(np.float32) @ y[:, at : at + 2048].astype(np.float32).T
            return out

        def dense(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            """Whether the node lies in a run of which enough is among the other's tokens."""
            good = several[one]
            at = np.flatnonzero(~good)
            for some in np.array_split(at, -(-len(at) // 4096)) if len(at) else ():
                total = np.cumsum(wide[other[some, None], lines[one[some]]], axis=1, dtype=np.int16)
                good[some] = np.maximum(total[:, least - 1], (total[:, least:] - total[:, :-least]).max(axis=1)) >= enough
            return good

        there = common(near[a], wide[b])
        back = common(near[b], wide[a]).T if two else there.T
        most = np.minimum(there + doubled[a, None], back + doubled[b])
        # the passages have as many different tokens in common as a run has places
        i, j = np.nonzero(apart & (most >= enough))
        if len(i):
            all_ = (common(wide[a], wide[b]) + np.minimum(lost[a, None], lost[b]))[i, j]
            good = far[a[i]] | far[b[j]] | (all_ >= enough)
            i, j = i[good], j[good]
        most, i, j = most[i, j], a[i], b[j]
        for x, y in ((0, 1), (1, 0)):
            good = dense((i, j)[x], (i, j)[y])
            most, i, j = most[good], i[good], j[good]
        rest: list[None] = []
        if spanning:
            chosen = np.zeros(len(i), bool)
            # the best pair of each group that a row meets, row by row
            late, early = np.maximum(i, j), np.minimum(i, j)
            order = np.lexsort((-most, late))
            cuts = np.flatnonzero(np.diff(late[order], prepend=-1, append=len(rows)))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                some = order[lo:hi]
                me = late[some[0]]
                some = some[group[early[some]] != group[me]]
                joined, first = np.unique(group[early[some]], return_index=True)
                chosen[some[first]] = True
                group[np.isin(group, joined)] = group[me]
            rest = [] if chosen.all() else [None]
            i, j = i[chosen], j[chosen]
        first, second = np.minimum(region[i], region[j]).tolist(), np.maximum(region[i], region[j]).tolist()
        return _record([first + rest, second + rest, [key[0]] * (len(i) + len(rest))], _OPEN)

    return by_group(met.select(tile.alias("tile"), *columns), "tile", meet, _OPEN)


def _within(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are among ``known``, which ascend and hold no -1."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def common_passages(s: np.ndarray, t: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of stretches of two token lines that are long and alike enough."""
    share, out = dense_share(percent), []
    for lo, hi in dense_runs(_within(s, _distinct(t)), least, share, trim=False):
        x = s[lo:hi]
        for lo2, hi2 in dense_runs(_within(t, _distinct(x)), least, share, trim=False):
            # where one goes on with what the other holds elsewhere, what the two have in common is cut out
            y = _distinct(t[lo2:hi2])
            for a, b in dense_runs(_within(x, y), least, share):
                own = _distinct(x[a:b])
                there = np.flatnonzero(_within(t[lo2:hi2], own))
                a2, b2 = lo2 + int(there[0]), lo2 + int(there[-1]) + 1
                lone = [bool((z < 0).any()) for z in (x[a:b], t[a2:b2])]  # tokens of no other document count as one
                common, own_size, size = int(_within(own, y).sum()), len(own) + lone[0], len(_distinct(t[a2:b2])) + lone[1]
                # a stretch that ends within a passage of least length counts as that passage
                if (100 + percent) * common >= percent * (max(own_size, least) + max(size, least)):
                    out.append((lo + a, lo + b, a2, b2))
    return out


_LINKS = "region long, lo int, hi int, other long, lo2 int, hi2 int"
_LINK = ("region", "lo", "hi", "other", "lo2", "hi2")


def verified(pairs: DataFrame, found: DataFrame, least: int, percent: int) -> DataFrame:
    """Passages (region, lo, hi, other, lo2, hi2), in tokens of their regions, of the pairs of regions that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column("region").to_pylist(), batch.column("other").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                out += [(a, lo, hi, b, lo2, hi2) for lo, hi, lo2, hi2 in common_passages(np.asarray(x.values), np.asarray(y.values), least, percent)]
            yield _record([[r[i] for r in out] for i in range(6)], _LINKS)

    met = pairs.join(found.select("region", F.col("tokens").alias("x")), "region").join(found.select(F.col("region").alias("other"), F.col("tokens").alias("y")), "other")
    return map_batches(met.select("region", "other", "x", "y"), run, _LINKS)


_NAMES = ("doc_id", "first_word", "end_word", "other_id", "other_first_word", "other_end_word", "whole", "class_id", "class_first_word")


def repeated_passages(docs: DataFrame, least_words: int = 50, shingle: int = 5, percent: int = 75, tmp: Scratch | None = None) -> DataFrame:
    """Passages that another document repeats, each with its class and one passage of another document that it is linked with.

    doc_id, first_word, end_word; other_id, other_first_word, other_end_word; whole, class_id, class_first_word. Passages
    are of one class if links join them; the class is named by its passage of smallest doc_id and first word. ``whole``
    rows are texts with exact copies: these are a class, and the passages inside the text have rows for its first document
    only. The result is read from tables of ``tmp``.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    least = least_words - shingle + 1
    named = docs.where("doc_id is not null").select("doc_id", "text")
    found = tmp.store(regions(met_again(send_places(named, shingle, count_ranges(named))), least, percent))
    tmp.release()
    texts = found.where("start is null")
    copies = texts.groupBy("key").agg(F.min_by("row", F.struct("doc_id", "row")).alias("row"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    own = tmp.store(found.where("start is not null").join(copies.select("row"), "row", "left_semi").select("row", "doc_id", "start", "tokens"))
    # regions of equal tokens are copies of the first one, which goes on; a region of one document alone is never met with others of it
    marks = (F.xxhash64("tokens").alias("x"), F.hash("tokens").alias("y"))
    place = F.struct("row", "start", "doc_id")
    alike = own.groupBy(*marks).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    named = tmp.store(alike.withColumn("region", F.monotonically_increasing_id()))
    many = F.col("low.row") < F.col("high.row")
    first = named.select(F.col("low.row").alias("row"), F.col("low.start").alias("start"), "region", F.when(many, -1 - F.col("region")).otherwise(F.col("low.row")).alias("owner"))
    leads = tmp.store(own.join(first, ["row", "start"]).select("region", "owner", "tokens"))
    met = tmp.store(led_windows(region_windows(leads, least)))
    tmp.release()
    shared = met.where("other is null").drop("other")
    pairs = tmp.store(met.where("other is not null").select("region", "other").distinct())
    own_pairs = leads.where("owner < 0").select("region", F.col("region").alias("other"))
    parts = [tmp.store(verified(pairs.union(own_pairs), leads, least, percent))]
    classes = passage_classes(parts[0], least, tmp)
    left = tmp.store(labelled(shared, classes).select("key", "region", "place", "label", "n"))
    tmp.drop(met)
    tmp.release()
    sketched = tmp.store(sketches(left, leads, partners(pairs), least))
    tmp.drop(left)
    # pairs that span classes first: where they are links, the rest of the classes' pairs need no check
    met = tmp.store(open_pairs(sketched, least, percent, True))
    more = tmp.store(met.where("region is not null").select("region", "other").distinct())
    parts.append(tmp.store(verified(more, leads, least, percent)))
    tmp.drop(classes)
    classes = passage_classes(parts[0].union(parts[1]), least, tmp)
    rest = sketched.drop("label", "tried").join(met.where("region is null").select("key").distinct(), "key", "left_semi")
    rest = labelled(rest, classes).join(partners(pairs.union(more)), "region", "left")
    more = tmp.store(open_pairs(rest, least, percent, False).select("region", "other").distinct())
    parts.append(tmp.store(verified(more, leads, least, percent)))
    tmp.drop(classes, met)
    classes = passage_classes(parts[0].union(parts[1]).union(parts[2]), least, tmp)
    tmp.drop(*parts, sketched, leads)
    members = own.select("row", "start", "doc_id", *marks).join(named, ["x", "y"]).select("region", "row", "start", "doc_id")
    there = members.join(classes, "region").join(named.select(F.col("region").alias("other"), F.col("low").alias("one"), F.col("high").alias("last")), "other")
    partner = F.when(F.col("one.row") != F.col("row"), F.col("one")).otherwise(F.col("last"))
    span = lambda start, lo, hi: ((F.col(start) + F.col(lo)).alias("first_word"), (F.col(start) + F.col(hi) + shingle - 1).alias("end_word"))
    held = there.withColumn("p", partner).select("label", "doc_id", *span("start", "lo", "hi"), F.struct("p.doc_id", *span("p.start", "lo2", "hi2")).alias("p"))
    held = tmp.store(held)
    tmp.drop(own, named, classes)
    names = held.groupBy("label").agg(F.min(F.struct("doc_id", "first_word")).alias("c"))
    held = held.join(names, "label").select("doc_id", "first_word", "end_word", "p.*", F.lit(False), "c.*").toDF(*_NAMES)
    whole = texts.select("key", "doc_id", "size").distinct().join(copies.where("low < high"), "key")
    words = (F.col("size") + shingle - 1).cast("int")
    other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    whole = whole.select("doc_id", F.lit(0), words, other, F.lit(0), words, F.lit(True), "low", F.lit(0)).toDF(*_NAMES)
    return held.union(whole).distinct()
