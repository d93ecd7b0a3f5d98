"""N-gram Jaccard join: all links between documents whose shingle sets are alike, and the classes that links form.

1. Tokens are 64-bit hashes of word shingles. Batches of documents send their sorted tokens to ranges of the token
   space, where each token's document frequency is counted; tokens of two documents or more go back to the batches.
   A token of one document cannot be shared, so a document survives only if enough of its tokens came back. There are
   as many ranges as the text takes, and rows are streamed, so a task holds one range or one batch at a time.
2. Exact copies (of the word sequence) are one class from the start, and only one row of it goes on.
3. Families of near copies are joined first where that is cheap: survivors that share a smallest token under a hash
   are streamed past a few leading documents, and exact overlaps make links. Labels of what is joined so far let the
   next step pass over pairs that need no check any more.
4. Two alike documents share a token among their rarest few, whatever else they hold, and their set sizes lie in the
   same band or in neighbouring ones. Survivors meet in a tile for each such token and band, with the next band's
   beside it. Tiles hold hashed bitmap signatures; sizes and bit counts bound the overlap from above, and large tiles
   are cut into pairs of blocks.
5. Pairs that the bounds allow are checked by intersecting the sorted token arrays: first pairs that span a tile's
   labels, then, under the labels that result, every pair left.

Rows have keys of their own (partition, batch and place), so two texts that repeat an id are two documents. Keys hold
as long as the scan gives each task the same rows in the same order, as tables do; what comes from a shuffle should be
written to a table first.

Edge cases: a null or empty text has an empty set and is linked with nothing; a text of fewer words than a shingle is
one shingle; very long texts are taken whole; repeated rows are exact copies; an empty table gives no rows; a row
without an id is linked with nothing, its class null. Only ``doc_id`` and ``text`` are read. Two shingles count as equal
if their hashes are: for two documents of n and m shingles that differ, that is wrong with probability n m / 2 ** 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Scratch, map_batches, raw_texts, slices, with_text_columns
from docloom.llm.components import connected_components
from docloom.llm.shingles import U, mix, shingle_hashes, spread, word_hashes

SIGNATURE_WORDS = 16
#: Rows of a tile that are compared in one piece.
BLOCK = 1024
#: A batch's documents are numbered in 16 bits, and their text is sorted as tokens in one piece.
MOST_DOCS, BATCH_BYTES = 60_000, 8 << 20
#: Bytes of text whose tokens make up one range of the token space.
RANGE_BYTES = 8 << 20


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in runs that are numbered and sorted together, with the run's name."""
    made = 0
    for whole in batches:
        for first in range(0, whole.num_rows, MOST_DOCS):
            for part in slices(whole.slice(first, MOST_DOCS), limit=BATCH_BYTES):
                yield (TaskContext.get().partitionId() << 24) | made, part
                made += 1


def count_ranges(docs: DataFrame) -> int:
    """How many ranges the token space is cut into: by the bytes of text, which one pass sums."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-size // RANGE_BYTES))


#: Turns of joining labels by spanning pairs before every pair left is checked.
SPANNING_TURNS = 1
_SEEDS = spread(1 << 40, 4)


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending integers as steps of as few bytes as the largest step takes."""
    steps = np.diff(values, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return width, steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view(U).ravel(), dtype=U)


_SENT = "bucket int, batch long, kind int, width int, tokens binary, owners binary, frequencies binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_FIELDS = ["bucket", "batch", "kind", "width", "tokens", "owners", "frequencies"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_FIELDS)


def range_edges(buckets: int) -> np.ndarray:
    """First token of each range."""
    return np.array([(i << 64) // buckets for i in range(buckets)], dtype=U)


def ranges_of(t: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges that ascending tokens fall into, with the places of their tokens."""
    if len(t):
        first, last = np.searchsorted(edges, t[[0, -1]], side="right") - 1
        cuts = [0, *np.searchsorted(t, edges[first + 1 : last + 1]).tolist(), len(t)]
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False), int(first)):
            if lo < hi:
                yield b, slice(lo, hi)


def send_tokens(docs: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """For each batch of documents a row for each range of tokens, and one with its ids, set sizes and text digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = range_edges(buckets)
        for name, batch in token_batches(batches):
            tokens, owners, keys, base = [], [], [], 0
            for part in slices(batch):
                texts = [(t or b"").lower() for t in raw_texts(part)]
                words, counts = word_hashes(texts)
                h, o = shingle_hashes(words, counts, shingle)
                tokens.append(h)
                owners.append((o + base).astype(np.uint16))
                base += len(texts)
                keys += [hashlib.md5(b" ".join(t.split()), usedforsecurity=False).digest() for t in texts]
            t, o = np.concatenate(tokens), np.concatenate(owners)
            del tokens, owners
            order = np.argsort(t, kind="stable")  # owners stay ascending among equal tokens
            t, o = t[order], o[order]
            del order
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
            t, o = t[fresh], o[fresh]
            sizes = np.bincount(o, minlength=batch.num_rows).astype(np.int32)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            out = [(name % buckets, name, 0, 0, ids.tobytes(), sizes.tobytes(), b"".join(keys))]
            for b, some in ranges_of(t, edges):
                width, data = _pack(t[some])
                out.append((b, name, 1, width, data, o[some].tobytes(), None))
            yield _rows(out)

    return map_batches(docs.select("doc_id", "text"), run, _SENT)


def by_group(df: DataFrame, group: str, work: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over the rows of each group, which are streamed: a task holds one group at a time."""
    names = df.columns
    at = names.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][at] != r[at]:
                    yield work(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield work(rows)

    return map_batches(df.repartition(group).sortWithinPartitions(group), run, schema)


def shared_tokens(sent: DataFrame) -> DataFrame:
    """The same rows, cut down to tokens of two documents or more, with document frequencies (at most 65,535)."""

    def count(rows: list[tuple]) -> pa.RecordBatch:
        out, runs = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
        everything = np.concatenate([np.zeros(0, U), *(_unpack(r[3], r[4]) for r in runs)])
        everything.sort()
        again = everything[1:][everything[1:] == everything[:-1]]
        del everything
        shared, extra = np.unique(again, return_counts=True)
        for r in runs if len(shared) else ():
            t = _unpack(r[3], r[4])
            at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
            hit = shared[at] == t
            if hit.any():
                width, data = _pack(t[hit])
                frequency = np.minimum(extra[at[hit]] + 1, 65535).astype(np.uint16)
                out.append((r[0], r[1], 1, width, data, np.frombuffer(r[5], np.uint16)[hit].tobytes(), frequency.tobytes()))
        return _rows(out)

    return by_group(sent, "bucket", count, _SENT)


def gather_tokens(shared: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, text digest, and the shared tokens, rarest first, of documents that hold enough of them."""

    def gather(rows: list[tuple]) -> pa.RecordBatch:
        head = next(r for r in rows if r[2] == 0)
        ids, sizes = np.frombuffer(head[4], np.int64), np.frombuffer(head[5], np.int32)
        keys = [head[6][i : i + 16] for i in range(0, len(head[6]), 16)]
        runs = [r for r in rows if r[2] == 1]
        t = np.concatenate([np.zeros(0, U), *(_unpack(r[3], r[4]) for r in runs)])
        o, f = (np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r[i], np.uint16) for r in runs)]) for i in (5, 6))
        order = np.lexsort((t, f, o))
        t, o = t[order].view(np.int64), o[order]
        ends = np.cumsum(np.bincount(o, minlength=len(ids)))
        lists = []
        for i, n in enumerate(sizes):
            own = t[(ends[i - 1] if i else 0) : ends[i]]
            lists.append(own if n and 100 * len(own) >= percent * n else None)
        named = (head[1] << 16) + np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(named), pa.array(ids), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["row", "doc_id", "n_shingles", "key", "tokens"])

    return by_group(shared, "batch", gather, "row long, doc_id long, n_shingles long, key binary, tokens array<long>")


def _links(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether two arrays of distinct tokens overlap enough: percent of the union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return (100 + percent) * common >= percent * (n_a + n_b)


def _pairs(pairs: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(len(names))], names=names)


def family_links(survivors: DataFrame, percent: int, salts: int = 16, leaders: int = 4) -> DataFrame:
    """Links (a, b) to leading documents among survivors that share a smallest token under either of two hashes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.values).view(U) for x in batch.column("tokens")]
            for seed in _SEEDS[:2]:
                least = [int((mix(t ^ seed) & U((1 << 62) - 1)).min()) for t in lists]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], names=["least", *batch.schema.names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in batches:
            pairs = []
            for least, salt, row, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("least", "salt", "row", "n_shingles")), batch.column("tokens"), strict=True):
                if group != (least, salt):
                    group, heads = (least, salt), []
                own = np.asarray(tokens.values)
                for lead, n_lead, lead_tokens in heads:
                    if _links(own, lead_tokens, n, n_lead, percent):
                        pairs.append((row, lead))
                        break
                else:
                    if len(heads) < leaders:
                        heads.append((row, n, own))
            yield _pairs(pairs, ["a", "b"])

    placed = map_batches(survivors.select("row", "n_shingles", "tokens"), place, "least long, row long, n_shingles long, tokens array<long>")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return map_batches(placed.repartition("least", "salt").sortWithinPartitions("least", "salt", "row"), stream, "a long, b long")


def signatures(survivors: DataFrame) -> DataFrame:
    """s_row, n, number of shared tokens, and a bitmap with one hashed bit for each shared token."""
    bits = 64 * SIGNATURE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for x in batch.column("tokens"):
                flags = np.zeros(bits, np.uint8)
                flags[(mix(np.asarray(x.values).view(U) ^ _SEEDS[2]) % U(bits)).astype(np.int64)] = 1
                maps.append(np.packbits(flags).tobytes())
            held = pa.array([len(x) for x in batch.column("tokens")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held, pa.array(maps, pa.binary())], names=["s_row", "n", "held", "bits"])

    return map_batches(survivors.select("row", "n_shingles", "tokens"), run, "s_row long, n long, held long, bits binary")


def _compare(rows: list[tuple], percent: int, thin: int | None) -> list[tuple[int, int, int, int, int]]:
    """Pairs (a, b, label a, label b, bound) of a tile that sizes and bit counts allow; rows: side, next, row, label, n, held, bits.

    ``next`` marks rows of the next band, which are not compared with each other here. All such pairs under different
    labels, or with a number for ``thin`` those that span the labels: a pair found joins its labels at once, as if it
    were a link, so a tile gives fewer pairs than it has labels. The number sets the order.
    """
    rows = sorted(rows, key=lambda r: r[4])
    side, above, name, label, n, held = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(6))
    both = 0 in side and 1 in side
    maps = np.frombuffer(b"".join(r[6] for r in rows), U).reshape(len(rows), -1)
    reach = np.searchsorted(n, n * 100 // percent, side="right")
    start = np.searchsorted(n, -(-n * percent // 100), side="left")
    group = label.copy()
    order = np.arange(len(rows)) if thin is None else np.argsort(mix(name.view(U) ^ U(thin)))
    out = []
    for i in order:
        if thin is not None and (group == group[i]).all():
            break
        j = np.arange(i + 1 if thin is None else start[i], reach[i])
        keep = (group[j] != group[i]) & (above[j] + above[i] < 2)
        if both:
            keep &= side[j] != side[i]
        j = j[keep]
        if not len(j):
            continue
        most = np.minimum(held[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64), held[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64))
        good = (100 + percent) * most >= percent * (n[i] + n[j])
        j, most = j[good], most[good]
        if thin is not None and len(j):
            best = np.argsort(-most, kind="stable")
            j, most = j[best], most[best]
            joined, first = np.unique(group[j], return_index=True)
            j, most = j[first], most[first]
            group[np.isin(group, joined)] = group[i]
        for k, m in zip(j.tolist(), most.tolist(), strict=True):
            a, b = (i, k) if name[i] < name[k] else (k, i)
            out.append((int(name[a]), int(name[b]), int(label[a]), int(label[b]), m))
    return out


def size_band(n: Column, percent: int) -> Column:
    """Sizes of alike sets lie in one band or in neighbouring ones: a band spans the largest ratio that the likeness allows."""
    return F.floor(F.ln(n) / F.ln(F.lit(100 / percent * (1 + 1e-9)))).cast("int")


def candidate_pairs(survivors: DataFrame, signed: DataFrame, labels: DataFrame, percent: int, thin: int | None = None) -> DataFrame:
    """Distinct pairs (a, b, la, lb, bound), under different labels, that share one of their rarest tokens and pass the bounds.

    All of them, or with a number for ``thin`` pairs that span the labels of each tile.
    """
    held = F.size("tokens")
    # n - ceil(percent n / 100) + 1 rarest tokens of the whole set; those of one document come first and are left out
    rarest = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1 - (F.col("n_shingles") - held)
    band = size_band(F.col("n_shingles"), percent).alias("band")
    named = survivors.join(labels, survivors.row == labels.node, "left").select("row", F.coalesce("component", "row").alias("label"), band, F.slice("tokens", F.lit(1), rarest.cast("int")).alias("tokens"))
    members = named.select("row", "label", "band", F.explode("tokens").alias("token"))
    mixed = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("tile")).where("low < high").select("token", "tile")
    place = lambda at, above: F.struct(at.alias("at"), F.lit(above).alias("above"))
    # a token that few documents hold has one tile; others have a tile for each band, in which the next one's rows take part
    own_tile = F.when(F.col("tile") > BLOCK, F.array(place(F.col("band"), 0), place(F.col("band") - 1, 1))).otherwise(F.array(place(F.lit(-2), 0)))
    met = members.join(mixed, "token").select("row", "label", "token", "tile", F.explode(own_tile).alias("p")).select("row", "label", "token", "tile", "p.*")
    cuts = F.ceil(F.col("tile") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row", "token"), cuts).cast("int")
    other = F.explode(F.sequence(F.lit(0), cuts - 1))
    dealt = met.select("token", "at", "above", "row", "label", own.alias("own"), other.alias("other"))
    dealt = dealt.select("token", "at", "above", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "row", "label")
    tiles = dealt.join(signed, dealt.row == signed.s_row).select("token", "at", "i", "j", "side", "above", "row", "label", "n", "held", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        names = ["a", "b", "la", "lb", "bound"]
        for batch in batches:
            pairs = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:4] != tile:
                    if len(rows) > 1:
                        pairs += _compare(rows, percent, thin)
                    tile, rows = r[:4], []
                rows.append(r[4:])
            yield _pairs(pairs, names)
        if len(rows) > 1:
            yield _pairs(_compare(rows, percent, thin), names)

    dealt_out = tiles.repartition("token", "at", "i", "j").sortWithinPartitions("token", "at", "i", "j")
    return map_batches(dealt_out, run, "a long, b long, la long, lb long, bound long").distinct()


def verify(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token arrays overlap enough."""
    left = survivors.select(F.col("row").alias("a"), F.col("n_shingles").alias("n_a"), F.col("tokens").alias("t_a"))
    right = survivors.select(F.col("row").alias("b"), F.col("n_shingles").alias("n_b"), F.col("tokens").alias("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            columns = [x.column(c).to_pylist() for c in ("n_a", "n_b")]
            ok = [_links(np.asarray(a.values), np.asarray(b.values), n, m, percent) for a, b, n, m in zip(x.column("t_a"), x.column("t_b"), *columns, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(mask), x.column("b").filter(mask)], names=["a", "b"])

    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")
    return map_batches(met, run, "a long, b long")


def joined_rows(docs: DataFrame, tmp: Scratch, shingle: int = 5, percent: int = 75) -> DataFrame:
    """row, doc_id, n_shingles, key, component_id and ``leads``, true in one row of each class, a table of ``tmp``.

    Rows without an id are left out.
    """
    named = docs.where("doc_id is not null")
    gathered = tmp.store(gather_tokens(shared_tokens(send_tokens(named, shingle, count_ranges(named))), percent))
    tmp.release()
    slim = gathered.select("row", "doc_id", "n_shingles", "key")
    classes = tmp.store(slim.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("key", F.col("first.row").alias("first")))
    survivors = tmp.store(gathered.where("tokens is not null").join(classes.select(F.col("first").alias("row")), "row", "left_semi"))
    signed = tmp.store(signatures(survivors))

    links = tmp.store(family_links(survivors, percent))
    labels = connected_components(links, tmp)
    # pairs that span the labels first: where they are links, the rest of the labels' pairs need no check
    for turn in range(SPANNING_TURNS):
        pairs = candidate_pairs(survivors, signed, labels, percent, turn)
        pair = [F.least("la", "lb"), F.greatest("la", "lb")]
        best = pairs.groupBy(*pair).agg(F.max_by(F.struct("a", "b"), F.struct("bound", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b")
        found = tmp.store(verify(best, survivors, percent))
        if found.isEmpty():
            tmp.drop(found)
            break
        more = tmp.store(links.union(found))
        tmp.drop(links, found, labels)
        links = more
        labels = connected_components(links, tmp)
    rest = verify(candidate_pairs(survivors, signed, labels, percent), survivors, percent)
    more = tmp.store(links.union(rest))
    tmp.drop(links, labels, survivors, signed)
    tmp.release()
    labels = connected_components(more, tmp)

    # a class is a component of copies, or for an empty set the rows of one id
    of_class = classes.join(labels, classes["first"] == labels.node, "left").select("key", F.coalesce("component", "first").alias("component"))
    named = slim.join(of_class, "key", "left")
    named = named.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component"))).withColumn("alone", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    leads = named.groupBy("component", "alone").agg(F.min(F.struct("doc_id", "row")).alias("lead"))
    same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    met = named.alias("x").join(leads.alias("y"), same("component") & same("alone"))
    out = tmp.store(met.select("x.row", "x.doc_id", "x.n_shingles", "x.key", F.col("lead.doc_id").alias("component_id"), (F.col("x.row") == F.col("lead.row")).alias("leads")))
    tmp.drop(more, labels, classes, gathered)
    return out


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 75, tmp: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach; read from a table of ``tmp``."""
    found = joined_rows(docs, tmp or Scratch(docs.sparkSession), shingle, percent).select("doc_id", "n_shingles", "component_id")
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"))
    return found.union(unnamed)


def word_digest(docs: DataFrame) -> DataFrame:
    """The rows with ``__key``, a digest of the text's words as ``send_tokens`` makes it."""

    def make(batch: pa.RecordBatch) -> list:
        texts = [(t or b"").lower() for t in raw_texts(batch)]
        return [pa.array([hashlib.md5(b" ".join(t.split()), usedforsecurity=False).digest() for t in texts], pa.binary())]

    return with_text_columns(docs, [T.StructField("__key", T.BinaryType())], make, docs.columns)


def keep_one_per_class(docs: DataFrame, shingle: int = 5, percent: int = 75, tmp: Scratch | None = None) -> DataFrame:
    """All columns of one row of each class, the one with the smallest id; rows without an id stay.

    Only ids are matched with the rows, whose texts are neither sorted nor grouped. Where rows repeat an id and not
    all of them stay, their texts' digests tell which.
    """
    rows = joined_rows(docs, tmp or Scratch(docs.sparkSession), shingle, percent)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("__n"), F.count_if("leads").alias("__kept")).where("__kept > 0")
    one = lambda some: some.select("doc_id").hint("shuffle_hash")
    kept = docs.join(one(ids.where("__n = __kept")), "doc_id", "left_semi").select(*docs.columns)
    part = ids.where("__n > __kept")
    if not part.isEmpty():
        leads = rows.where("leads").join(part.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("key").alias("__key"))
        some = word_digest(docs.join(one(part), "doc_id", "left_semi").select(*docs.columns))
        some = some.join(leads.hint("shuffle_hash"), ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
        kept = kept.union(some.select(*docs.columns))
    return kept.union(docs.where("doc_id is null"))
