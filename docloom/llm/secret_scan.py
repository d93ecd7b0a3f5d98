"""Secret scans: fixed credential patterns, and a token-efficiency test for random strings.

Ordinary words cost a byte-pair vocabulary few tokens; random strings cost about one for every two characters. A
string of key characters is reported if its characters per token are few, after digests and identifiers are set
aside. Spans are in code points, the end exclusive.

Edge cases: a null or empty text has no spans; texts are scanned whole, however long; repeated rows give repeated
results; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import map_batches, with_text_columns

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The patterns of the base scan, in the order in which spans that start alike are listed.
KINDS = ("assign", "access", "hex", "random")
#: In either case, of ASCII letters alone: without (?a), (?i) would also take letters such as the long s.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A cheap test that holds wherever ASSIGN can match.
_HINTS = ("passw", "secret", "token", "api")

#: Runs that may be keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests and identifiers that are no secrets: UUIDs, hex digests, numbers and dates.
KNOWN = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:0x)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9_+/=-]+"
)
#: Paths and names in snake, kebab or camel case, and their words: no secrets if the vocabulary encodes the words well.
NAME = re.compile(r"/?[A-Za-z]+(?:[_/=+-]+[A-Za-z]+)*[_/=+-]*(?:[0-9]{1,4})?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # a candidate holds no white space, so one piece is the whole candidate
    return tiktoken.Encoding("candidates", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end): leftmost matches that don't overlap, per kind; short ones are dropped."""
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 20:
                yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def token_count(run: str, encoder: tiktoken.Encoding) -> int:
    # long runs are judged in windows, so that a byte-pair merge of a very long run stays cheap
    return sum(len(encoder.encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256))


def random_spans(text: str, encoder: tiktoken.Encoding, most_chars_per_token: float) -> Iterator[tuple[int, int, int]]:
    """Runs of key characters that the vocabulary encodes badly."""
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if KNOWN.fullmatch(run) or len(run) > most_chars_per_token * token_count(run, encoder):
            continue
        if NAME.fullmatch(run):
            # words in capitals cost more tokens than the same words in small letters
            words = [w.lower() for w in NAME_WORD.findall(run)]
            if sum(map(len, words)) > most_chars_per_token * sum(token_count(w, encoder) for w in words):
                continue
        yield m.start(), 3, m.end()


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """[start, end] of the stretches that spans, in order of their starts, cover without a gap."""
    out: list[list[int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def covered(start: int, end: int, stretches: list[list[int]]) -> bool:
    """Whether one of the stretches, in order, holds all of [start, end)."""
    at = bisect_right(stretches, [start, 1 << 62]) - 1
    return at >= 0 and stretches[at][1] >= end


def scan(text: str | None, vocabulary: str, most_chars_per_token: float) -> tuple[list[int], str, str]:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    if not text:
        return [0, 0, 0], hashlib.sha256(b"").hexdigest(), ""
    base = sorted(base_spans(text))
    found = base
    more = list(random_spans(text, encoding(vocabulary), most_chars_per_token))
    if more:
        # a random run that base spans cover is the same secret; one that reaches beyond them is reported whole
        stretches = merged(base)
        found = sorted(base + [x for x in more if not covered(x[0], x[2], stretches)])
    joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)


def scan_secrets(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    most_chars_per_token: float = 2.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """Spans of secrets of each row's whole text. ``vocabulary``: a tiktoken file at the same path on every executor."""
    names = ("n_assign", "n_access", "n_hex")
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]

    def make(batch: pa.RecordBatch) -> list:
        rows = [scan(t, vocabulary, most_chars_per_token) for t in batch.column("text").to_pylist()]
        return [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)] + [
            pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)
        ]

    return with_text_columns(docs, fields, make, keep)


def redact(text: str | None, vocabulary: str = DEFAULT_VOCABULARY, most_chars_per_token: float = 2.0) -> str | None:
    """The text with each span replaced by the name of its kind in angle brackets; overlapping spans become one."""
    spans = scan(text, vocabulary, most_chars_per_token)[2]
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",")):
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced; ``n_chars`` follows the text where it is a column."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, vocabulary) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                sizes = [n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
                new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return map_batches(docs, run, docs.schema)
