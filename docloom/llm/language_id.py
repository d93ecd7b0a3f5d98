"""Language identification by partial matching over bytes, with frozen statistics.

For each language a context tree holds what followed each context of up to three bytes. A byte's cost is the code
length under the longest context that the tree has, with escapes (method C) to shorter ones and at last to a uniform
code over the 256 bytes. After the fit nothing changes, so the cost depends on four bytes alone. Trees are kept sparse:
for each language sorted runs of three and four bytes that it has, with their costs, and what an escape costs in each
context; contexts of one byte are a table. The distinct runs of a slice of text are looked up once, in every language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a table without usable rows gives ``und``
everywhere; bytes never seen in the fit cost what escapes to the uniform code cost; texts are scored whole; repeated
rows give repeated results. Only ``text`` and the columns asked for are read; ``lang`` is read in the fit alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_batches, raw_texts, slices, with_text_columns

UNDETERMINED = "und"


@dataclass(frozen=True)
class ContextTree:
    """Bits by run: ``four`` and ``three`` are ascending runs of bytes, ``contexts`` ascending runs of three bytes."""

    four: np.ndarray
    four_bits: np.ndarray
    contexts: np.ndarray
    context_escape: np.ndarray
    three: np.ndarray
    three_bits: np.ndarray
    pair_escape: np.ndarray
    two_bits: np.ndarray

    def bits(self, runs: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each run of four, after the three before it."""
        cost, hit = _found(self.four, self.four_bits, runs)
        missed = runs[~hit]
        escape, _ = _found(self.contexts, self.context_escape, missed >> 8)  # a context that the tree lacks costs none
        shorter, known = _found(self.three, self.three_bits, missed & 0xFFFFFF)
        rest = missed[~known]
        shorter[~known] = self.pair_escape[(rest >> 8) & 0xFFFF] + self.two_bits[rest & 0xFFFF]
        cost[~hit] = escape + shorter
        return cost


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the wanted keys, 0 where there is none, and whether there is one."""
    if not len(keys):
        return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], np.float32(0)), hit


def grow_tree(runs: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The tree of distinct runs of four bytes, ascending, and how often each was met."""

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, place = np.unique(keys, return_inverse=True)
        return names, np.bincount(place, weights=n, minlength=len(names))

    def blended(keys: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each run under method C; and by context: the contexts and the probability of an escape."""
        contexts, place = np.unique(keys >> 8, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(contexts))
        kinds = np.bincount(place, minlength=len(contexts))
        return (n + kinds[place] * shorter) / (total + kinds)[place], contexts, kinds / (total + kinds)

    runs, n4 = runs.astype(np.uint32), counts.astype(np.float64)
    k3, n3 = summed(runs & 0xFFFFFF, n4)
    k2, n2 = summed(k3 & 0xFFFF, n3)
    k1, n1 = summed(k2 & 0xFF, n2)
    one = np.full(256, len(k1) / 256 / (n1.sum() + len(k1)))
    one[k1] += n1 / (n1.sum() + len(k1))
    p2, c2, e2 = blended(k2, n2, one[k2 & 0xFF])
    two = np.tile(one, 256)  # a context that was never met costs no escape
    for c, e in zip(c2.tolist(), e2.tolist(), strict=True):
        two[c << 8 : (c + 1) << 8] *= e
    two[k2] = p2
    p3, c3, e3 = blended(k3, n3, two[k3 & 0xFFFF])
    pair_escape = np.ones(1 << 16)
    pair_escape[c3] = e3
    p4, c4, e4 = blended(runs, n4, p3[np.searchsorted(k3, runs & 0xFFFFFF)])
    bits = lambda p: -np.log2(p).astype(np.float32)
    return ContextTree(runs, bits(p4), c4.astype(np.uint32), bits(e4), k3.astype(np.uint32), bits(p3), bits(pair_escape), bits(two))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    trees: tuple[ContextTree, ...]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language; each text starts after three line feeds."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        runs, ends = byte_runs(texts)
        if not len(runs):
            return total
        distinct, place = np.unique(runs, return_inverse=True)
        some = lengths > 0
        starts = (ends - lengths)[some]
        for j, tree in enumerate(self.trees):
            total[some, j] = np.add.reduceat(tree.bits(distinct)[place], starts, dtype=np.float64)
        return total


def byte_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run of four that ends in each byte of each text, and where each text's runs end."""
    data = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    if len(data) < 4:
        return np.zeros(0, np.uint32), ends
    runs = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    own = np.ones(len(runs), bool)
    for i, end in enumerate(ends[:-1].tolist()):
        own[end + 3 * i : end + 3 * i + 3] = False  # what leads over to the next text
    return runs[own], ends


def count_runs(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the distinct runs of four bytes, ascending, and their counts: summed by Spark, collected as the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[str, list[bytes]] = defaultdict(list)
            for part in slices(batch):
                for name, text in zip(part.column("lang").to_pylist(), raw_texts(part), strict=True):
                    totals[name].append(text or b"")
            for name, texts in totals.items():
                runs, n = np.unique(byte_runs(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array(runs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "run", "n"])

    counted = map_batches(docs.select("lang", "text"), run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    found: dict[str, list[np.ndarray]] = defaultdict(list)
    gathered = counted.groupBy("lang", F.shiftright("run", 24).alias("first")).agg(F.collect_list("run").alias("runs"), F.collect_list("n").alias("ns"))
    for r in gathered.toLocalIterator():  # a row for each language and first byte of its runs
        found[r["lang"]].append(np.array([r["runs"], r["ns"]], np.int64))
    out = {}
    for name, parts in found.items():
        both = np.concatenate(parts, axis=1)
        order = np.argsort(both[0])
        out[name] = both[0][order], both[1][order]
    return out


def fit_languages(docs: DataFrame, usable: Column, most_rows_per_language: int = 4000) -> LanguageModel | None:
    """Trees fitted on rows where ``usable`` holds and text and lang are known; None if there are none.

    The one bound of the fit is ``most_rows_per_language``: about so many rows of each language, drawn by a hash of id
    and text, so that a group of copies has its share. Every language met is learned, from all bytes of its rows. Sizes
    of languages and the trees themselves pass through the driver.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    share = F.try_element_at(F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, most_rows_per_language / n)))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("language fit")), F.lit(1 << 20)) < share * (1 << 20)
    runs = {name: x for name, x in count_runs(rows.where(drawn)).items() if len(x[0])}
    return LanguageModel(tuple(sorted(runs)), tuple(grow_tree(*runs[name]) for name in sorted(runs))) if runs else None


def identify_languages(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score``, the posterior of the best language from code lengths per byte."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if model is None:
        keep = [c for c in docs.columns if c != "text"] if keep is None else keep
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        frozen = shared.value
        texts = [t or b"" for t in raw_texts(batch)]
        letters = [any(map(str.isalpha, t.decode())) if t else False for t in texts]
        bits = frozen.bits(texts)
        # evidence grows with the length, but bytes of one text are not independent
        scale = np.maximum(1, np.array([len(t) for t in texts]) / 32)[:, None]
        odds = np.exp2(np.maximum(-1000, -(bits - bits.min(axis=1, keepdims=True)) / scale))
        best, score = bits.argmin(axis=1), 1 / odds.sum(axis=1)
        names = [frozen.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())]

    return with_text_columns(docs, fields, make, keep)
