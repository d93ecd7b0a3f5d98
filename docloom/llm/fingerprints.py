"""I-Match fingerprints: hashes of the terms that several randomised lexicons keep. Built-in functions only.

Terms are the distinct words of a text in small letters; they stand by their 64-bit hashes. The band holds the terms of
two documents or more whose inverse document frequency over all documents lies between two fixed bounds; frequencies
are counted exactly, by term. The upper bound makes the band's size one of the language, not of the corpus: it has at
most ``exp(most_idf)`` times as many terms as a text has on average.

The lexicon is looked up in a bit set of ``2 ** LEXICON_BITS`` places, on which the band's terms are marked but for
places that a term below the band shares. So common terms never pass; terms of the band that share a common one's place
do not either; and a term too rare for the band passes if it shares the place of one in it.

Randomised lexicons are fixed for all texts: lexicon k of level l keeps the terms whose hash leaves k when divided by
``FIRST * 4 ** l``, for k below ``PARTS``, so the lexicons of each level are a quarter as dense as those of the level
before. A fingerprint is the hash of the text's sorted terms in each of them. Short texts are told by dense lexicons,
long ones by thin ones, so the likeness of two fingerprints is that of the level that shows most: the share of equal
hashes among the lexicons in which either text has terms, or among ``LEAST`` if those are fewer.

A text with few of its terms in the lexicon (less than ``FEW`` of them) is one of common terms, or one whose copies make
its terms common; all its terms are kept, whatever their frequency.

Edge cases: a null text counts as empty; a text without terms in any lexicon has a digest of the whole text as its
fingerprint, alike to its equals only; equal texts have equal fingerprints and likeness 1; the document after the last is
the first; rows of equal id follow each other by text; null ids come first; an empty table gives no rows; texts are taken
whole. Terms of equal hash count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import WORD, shuffle_partitions

LEXICON_BITS = 20
PARTS, FIRST, LEVELS, DIGITS = 16, 64, 4, 6
LEAST, FEW = 4, 0.25
_EMPTY = "." * DIGITS


def hashed_terms(text: Column) -> Column:
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.transform(terms, lambda t: F.xxhash64(t))


def _place(term_hash: Column) -> Column:
    """High bits: low ones tell the lexicons apart."""
    return F.shiftrightunsigned(term_hash, 64 - LEXICON_BITS)


def fit_lexicon(docs: DataFrame, least_idf: float = 3.0, most_idf: float = 9.0) -> Column:
    """The lexicon of terms with ``least_idf <= log(documents / frequency) <= most_idf``, as a constant array of 64-bit words.

    One row per word of the bit set passes through the driver.
    """
    total = float(max(docs.count(), 1))
    frequency = docs.select(F.explode(hashed_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(total) / F.col("df"))
    place = _place(F.col("term"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = F.bit_or(F.when((idf >= least_idf) & (idf <= most_idf) & (F.col("df") > 1), bit).otherwise(F.lit(0).cast("long")))
    common = F.bit_or(F.when(idf < least_idf, bit).otherwise(F.lit(0).cast("long")))
    words = frequency.groupBy(F.shiftright(place, 6).alias("word")).agg(marks.bitwiseAND(F.bitwise_not(common)).alias("bits"))
    bits = dict(words.collect())  # at most 2 ** (LEXICON_BITS - 6) rows
    return F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(1 << (LEXICON_BITS - 6)))), ",").cast("array<bigint>")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, by way of a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column, lexicon: Column) -> Column:
    """Hex digits of each lexicon's hash, level by level, or dots where the text has no term in a lexicon."""

    def in_lexicon(h: Column) -> Column:
        place = _place(h)
        return F.getbit(F.get(lexicon, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    def levels(hashes: Column, i: int) -> Column:
        residue = lambda x: x.bitwiseAND(F.lit(FIRST * 4**i - 1))
        part = lambda kept: F.when(F.size(kept) == 0, _EMPTY).otherwise(F.lower(F.right(F.hex(F.xxhash64(kept)), F.lit(DIGITS))))
        parts = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
        joined = lambda kept: F.array_join(F.transform(parts, lambda k: part(F.filter(kept, lambda x: residue(x) == k))), "")
        # what a level keeps holds all that the next one keeps
        rest = (lambda kept: F.concat(joined(kept), levels(kept, i + 1))) if i + 1 < LEVELS else joined
        return _bind(F.filter(hashes, lambda x: residue(x) < PARTS), rest)

    def kept(hashes: Column) -> Column:
        return _bind(F.filter(hashes, in_lexicon), lambda own: F.when(F.size(own) >= FEW * F.size(hashes), own).otherwise(hashes))

    made = _bind(_bind(hashed_terms(text), lambda hashes: F.sort_array(kept(hashes))), lambda hashes: levels(hashes, 0))
    return F.coalesce(F.nullif(made, F.lit(_EMPTY * PARTS * LEVELS)), F.concat(F.lit("--"), F.sha2(text, 256)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints."""
    at = lambda z, k: F.substring(z, k * DIGITS + 1, F.lit(DIGITS))

    def share(x: Column, y: Column, i: int) -> Column:
        places = F.sequence(F.lit(i * PARTS), F.lit(i * PARTS + PARTS - 1))
        filled = F.size(F.filter(places, lambda k: (at(x, k) != _EMPTY) | (at(y, k) != _EMPTY)))
        equal = F.size(F.filter(places, lambda k: (at(x, k) == at(y, k)) & (at(x, k) != _EMPTY)))
        return equal / F.greatest(filled, F.lit(LEAST))

    digests = F.startswith(a, F.lit("--")) | F.startswith(b, F.lit("--"))
    return F.when(a == b, 1.0).when(digests, 0.0).otherwise(F.greatest(*(share(a, b, i) for i in range(LEVELS))))


def with_following(rows: DataFrame, columns: dict[str, str], runs: int) -> DataFrame:
    """Columns of the next row by ascending doc_id (then text), named by ``columns``; the first row follows the last.

    Rows are cut by id into at most ``runs`` runs of about equal size, and each run also gets a copy of the row after
    its end, so that no task sees more than its run. The cuts and the first id of each run pass through the driver.
    """
    spark = rows.sparkSession
    cuts = rows.select(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    run = F.lit(0) if not cuts else F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id")))
    placed = rows.withColumn("_run", run)
    firsts = [(r["_run"], r["first"]) for r in placed.groupBy("_run").agg(F.min(F.struct("doc_id")).alias("first")).orderBy("_run").collect()]
    if not firsts:
        return placed.drop("_run").select("*", *(F.col(c).alias(n) for c, n in columns.items()))
    heads = [(first["doc_id"], firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    small = spark.createDataFrame(heads, "head_id long, head_run int")
    guests = placed.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head_id"))).drop("_run", "head_id").withColumnRenamed("head_run", "_run")
    both = placed.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    order = Window.partitionBy("_run").orderBy("_guest", F.asc_nulls_first("doc_id"), "text")
    led = both.select("*", *(F.lead(c).over(order).alias(n) for c, n in columns.items()))
    return led.where(~F.col("_guest")).drop("_run", "_guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of an edit of it, and the likeness to the edit and to the next document.

    The edit replaces the last quarter of the code points by the first as many of the next document.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = fit_lexicon(texts)
    first = texts.withColumn("fingerprint", fingerprint(F.col("text"), lexicon))
    runs = min(4096, 4 * shuffle_partitions(docs.sparkSession))
    led = with_following(first, {"text": "next_text", "fingerprint": "next_fingerprint"}, runs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = led.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
        "fingerprint",
        "next_fingerprint",
    )
    marked = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), lexicon).alias("edited_fingerprint"), "next_fingerprint")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
