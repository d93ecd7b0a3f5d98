"""Pipeline stages as functions from frame to frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.intermediate import Scratch


def add_fields(df: DataFrame, **fields: Column) -> DataFrame:
    return df.withColumns(fields)


def replace_with(df: DataFrame, document: Column) -> DataFrame:
    """Rows become the document given."""
    return df.select(document.alias("_doc")).select("_doc.*")


def sort_by_count(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def bucket(df: DataFrame, value: Column, boundaries: list, default=None, **measures: Column) -> DataFrame:
    """Groups of [boundary, next boundary); what lies outside goes to ``default``, an error without one."""
    lower = F.lit(None)
    for low, high in zip(boundaries, boundaries[1:], strict=False):
        lower = F.when((value >= low) & (value < high), F.lit(low)).otherwise(lower)
    outside = F.raise_error(F.lit("a value lies outside the boundaries")) if default is None else F.lit(default)
    return df.groupBy(F.coalesce(lower, outside).alias("bucket")).agg(*(c.alias(n) for n, c in measures.items()))


def values_at(df: DataFrame, value: str, ranks: list[int], accuracy: int = 10_000) -> list:
    """The values at these ranks, from 1, in ascending order; NULLs have no rank.

    Approximate quantiles give a narrow interval around each rank. Values below it are counted, and only those inside it
    are ordered, by distinct value. An interval that turns out not to hold its rank is widened until it does.
    """
    x, n = F.col(value), df.where(F.col(value).isNotNull()).count()
    found, left, width = {}, sorted(set(ranks)), 2 / accuracy
    while left:
        shares = [(max(0.0, (r - 1) / n - width), min(1.0, r / n + width)) for r in left]
        edges = df.agg(F.percentile_approx(value, [s for pair in shares for s in pair], accuracy)).first()[0]
        low = [edges[2 * i] if width < 1 else None for i in range(len(left))]  # in the end everything is inside
        high = [edges[2 * i + 1] if width < 1 else None for i in range(len(left))]
        under = [F.lit(False) if a is None else x < F.lit(a) for a in low]
        upto = [F.lit(True) if b is None else x <= F.lit(b) for b in high]
        counts = df.where(x.isNotNull()).agg(*(F.count_if(c) for c in under + upto)).first()
        held = [i for i, r in enumerate(left) if counts[i] < r <= counts[len(left) + i]]
        if held:
            inside = F.filter(F.array(*(F.when(~under[i] & upto[i], F.lit(i)) for i in held)), lambda i: i.isNotNull())
            sizes = df.where(x.isNotNull()).select(x.alias("x"), F.explode(inside).alias("i")).groupBy("i", "x").count()
            target = F.create_map(*(F.lit(v) for i in held for v in (i, left[i] - counts[i])))[F.col("i")]
            reached = F.sum("count").over(Window.partitionBy("i").orderBy("x"))
            placed = sizes.withColumn("reached", reached).where((F.col("reached") >= target) & (F.col("reached") - F.col("count") < target))
            found |= {left[r.i]: r.x for r in placed.select("i", "x").collect()}
        left, width = [r for r in left if r not in found], width * 8
    return [found[r] for r in ranks]


def bucket_auto(df: DataFrame, value: str, buckets: int, accuracy: int = 10_000, **measures: Column) -> DataFrame:
    """About equal groups by value, cut at exact quantiles; rows are never ordered as a whole.

    Equal values share a group, so there may be fewer groups than asked for; a group's number is that of the cuts below
    it. Each has its least and greatest value.
    NULLs come before all values, as in a sort: they count towards the first groups and have a group to themselves only
    if they fill one; a group that holds some has NULL as its least value.
    """
    n, nulls = df.agg(F.count("*"), F.count_if(F.col(value).isNull())).first()
    ranks = [-(-i * n // buckets) - nulls for i in range(1, buckets)] if n > nulls else []
    cuts = values_at(df, value, [r for r in ranks if r > 0], accuracy)
    filled = sum(r <= 0 for r in ranks)  # groups that NULLs fill
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    made = df.groupBy(F.when(F.col(value).isNull(), 0).otherwise(place + filled).alias("bucket"))
    low = F.when(F.count(value) == F.count("*"), F.min(value))
    return made.agg(low.alias("low"), F.max(value).alias("high"), *(c.alias(n) for n, c in measures.items()))


#: Grid places that one row expands to at a time.
_GRID = 10_000


def densify(df: DataFrame, field: str, step: int, partition: list[str] | None = None, bounds: tuple | str = "partition", unit: str | None = None) -> DataFrame:
    """Rows for the values of a grid that a partition lacks, other columns NULL; rows off the grid stay as they are.

    The grid starts at the lower bound and has steps of ``step``, or of so many ``unit`` (second to year) for dates.
    Bounds are a partition's own least and greatest value (``partition``), those of all rows (``full``), or a pair, the
    upper end exclusive. Grids are laid out in stretches, so no row expands to more than ``_GRID`` places at once.
    """
    keys, kind = partition or [], df.schema[field].dataType
    at = F.col(field)
    if isinstance(bounds, tuple):
        edges = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        edges = edges.withColumns({"_lo": F.lit(bounds[0]).cast(kind), "_hi": F.lit(bounds[1]).cast(kind)})
    elif bounds == "full" and keys:
        whole = df.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))  # one row
        edges = df.select(*keys).distinct().join(F.broadcast(whole), F.lit(True))
    else:
        edges = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    if unit is None:
        place = lambda i: (F.col("_lo").cast("double") + i * step).cast(kind)
        last = F.floor((F.col("_hi").cast("double") - F.col("_lo").cast("double")) / step)
    else:
        place = lambda i: F.timestamp_add(unit.upper(), (i * step).cast("int"), F.col("_lo")).cast(kind)
        last = F.floor(F.timestamp_diff(unit.upper(), F.col("_lo"), F.col("_hi")) / step)
    edges = edges.where("_lo is not null and _hi is not null").withColumn("_last", last.cast("long")).where("_last >= 0")
    stretches = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / _GRID))).alias("_s"))
    places = F.sequence(F.col("_s") * _GRID, F.least(F.col("_last"), F.col("_s") * _GRID + _GRID - 1))
    grid = stretches.repartition(*keys, "_s").select(*keys, "_hi", F.explode(places).alias("_i"))
    low = edges.select(*keys, "_lo")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    grid = grid.alias("g").join(low.alias("e"), same or F.lit(True)).select(*(F.col(f"g.{k}").alias(k) for k in keys), "_hi", place(F.col("_i")).alias(field))
    if isinstance(bounds, tuple):
        grid = grid.where(at < F.col("_hi"))
    grid = grid.select(*keys, field)
    there = df.select(*keys, field).distinct()
    new = grid.alias("g").join(there.alias("t"), [F.col(f"g.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*keys, field]], "left_anti")
    return df.unionByName(new, allowMissingColumns=True)


def fill_value(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), v if isinstance(v, Column) else F.lit(v)) for n, v in values.items()})


def fill_locf(df: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    """NULLs take the last value before them."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def fill_linear(df: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    """NULLs between two values lie on the line between them."""
    w = Window.partitionBy(*partition).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(column).cast("double").alias("y")))
    p, q = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
    made = df.withColumn("_p", p).withColumn("_q", q)
    line = F.col("_p.y") + (F.col("_q.y") - F.col("_p.y")) * F.try_divide(F.col(order).cast("double") - F.col("_p.x"), F.col("_q.x") - F.col("_p.x"))
    return made.withColumn(column, F.coalesce(F.col(column).cast("double"), line)).drop("_p", "_q")


def facet(df: DataFrame, **pipelines) -> dict[str, DataFrame]:
    """Several pipelines over the same rows."""
    return {n: f(df) for n, f in pipelines.items()}


def lookup(df: DataFrame, other: DataFrame, local: str | list[str], foreign: str | list[str], name: str, pipeline: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each row with the array of the other relation's documents of equal key or keys; an empty array without any.

    ``pipeline`` makes the documents from the other relation first, and has to keep the foreign columns. Documents are
    gathered per key before the join.
    """
    local, foreign = ([x] if isinstance(x, str) else x for x in (local, foreign))
    other = other if pipeline is None else pipeline(other)
    keys = [f"_key{i}" for i in range(len(foreign))]
    gathered = other.groupBy(*(F.col(f).alias(k) for f, k in zip(foreign, keys, strict=True))).agg(F.sort_array(F.collect_list(F.struct(*other.columns))).alias(name))
    none = F.array().cast(gathered.schema[name].dataType)
    met = df.join(gathered, [F.col(a) == F.col(k) for a, k in zip(local, keys, strict=True)], "left")
    return met.withColumn(name, F.coalesce(name, none)).drop(*keys)


def lookup_where(df: DataFrame, other: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """Each row, named by the distinct values of ``key``, with the other relation's documents for which a condition on both holds.

    The condition should hold an equality, so that rows meet by a join on it. Documents are gathered for each row: where
    measures of those above a value are enough, ``lookup_above`` does without.
    """
    met = df.join(other, condition).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*other.columns))).alias(name))
    none = F.array().cast(met.schema[name].dataType)
    return df.join(met, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce(name, none)).drop("_key")


#: Stretches of values that a key's rows are ordered in.
_STRETCHES = 64


def lookup_above(df: DataFrame, other: DataFrame, local: tuple[str, str], foreign: tuple[str, str], **measures: tuple[Column, Callable]) -> DataFrame:
    """Each row with measures of the other relation's documents of equal key and greater value; NULL without any.

    ``local`` and ``foreign`` name key and value, numbers or dates. A measure is an aggregate of documents and the function
    that merges such aggregates: ``(F.count("*"), F.sum)``. Rows and documents never meet in pairs: both come down to their
    distinct values, which are added up in descending order, in stretches between approximate quantiles of a key.
    """
    pair = lambda d, names: d.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()).withColumns({"_k": F.col(names[0]), "_v": F.col(names[1])})
    merged = [merge(n).alias(n) for n, (_, merge) in measures.items()]
    points = pair(other, foreign).groupBy("_k", "_v").agg(*(c.alias(n) for n, (c, _) in measures.items()))
    asked = pair(df, local).select("_k", "_v").distinct()
    edges = points.groupBy("_k").agg(F.percentile_approx("_v", [i / _STRETCHES for i in range(1, _STRETCHES)], 1000).alias("_edges"))
    both = points.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    placed = both.join(edges, "_k").withColumn("_s", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    higher = Window.partitionBy("_k").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("_k", "_s").agg(*merged).select("_k", "_s", *(merge(n).over(higher).alias(n) for n, (_, merge) in measures.items()))
    # a stretch begins with what lies above it; at one value, what is asked comes before the documents
    lines = placed.withColumn("_first", F.lit(False)).unionByName(ahead.withColumn("_first", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy("_k", "_s").orderBy(F.desc("_first"), F.desc("_v"), F.desc("_asked")).rowsBetween(Window.unboundedPreceding, 0)
    found = lines.select("_k", "_v", "_asked", *(merge(n).over(upto).alias(n) for n, (_, merge) in measures.items())).where("_asked").drop("_asked")
    return df.join(found, (F.col(local[0]) == F.col("_k")) & (F.col(local[1]) == F.col("_v")), "left").drop("_k", "_v")


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn at random: a top-n by a random key."""
    return df.orderBy(F.rand(seed)).limit(n)


def sample_rate(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each row with that probability."""
    return df.where(F.rand(seed) < rate)


def redact(df: DataFrame, keep: Column) -> DataFrame:
    return df.where(keep)


def graph_lookup(df: DataFrame, edges: DataFrame, start: str, source: str, target: str, most_depth: int) -> DataFrame:
    """(start, node, depth): nodes reached from each start value over edges, by breadth; each node once, at its least depth.

    Each level is written to the shared folder and joined with the edges from there, so the plan of a level does not
    hold those before it.
    """
    tmp = Scratch(df.sparkSession)
    links = tmp.store(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct())
    first = df.select(F.col(start).alias("start")).distinct().join(links, F.col("start") == F.col("_s"))
    frontier = reached = tmp.store(first.select("start", F.col("_t").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, most_depth + 1):
        step = frontier.join(links, F.col("node") == F.col("_s")).select("start", F.col("_t").alias("node")).distinct()
        frontier = tmp.store(step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def geo_near(df: DataFrame, lon: str, lat: str, at: tuple[float, float], most_metres: float | None = None) -> DataFrame:
    """Rows with their great-circle distance in metres, nearest first."""
    x, y = (F.radians(F.col(c).cast("double")) for c in (lon, lat))
    x0, y0 = (F.radians(F.lit(v)) for v in at)
    h = F.pow(F.sin((y - y0) / 2), 2) + F.cos(y) * F.cos(y0) * F.pow(F.sin((x - x0) / 2), 2)
    made = df.withColumn("distance", 2 * 6378100.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))
    return (made if most_metres is None else made.where(F.col("distance") <= most_metres)).orderBy("distance")


def vector_search(df: DataFrame, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows of highest cosine similarity: exact, as a top-k over all rows."""
    v = F.col(vector)
    q = F.lit([float(x) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(x * x for x in query) ** 0.5
    return df.withColumn("similarity", F.try_divide(dot, norm * size)).orderBy(F.desc_nulls_last("similarity")).limit(k)
