"""Normalisation, splits, labels, imputation, metrics and matrices between trajectories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from trajecta.operators import kernels as K
from trajecta.operators.measures import numbered
from trajecta.roles import Roles


def normalize(df: DataFrame, keys: Sequence[str], columns: Sequence[str], inplace: bool = False) -> DataFrame:
    """z-scores within the group (deviation of a sample), as columns ..._norm or in place."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c if inplace else f"{c}_norm": F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in columns})


def fit_normalization(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a for c in columns for a in (F.avg(c).alias(f"__mean_{c}"), F.stddev_samp(c).alias(f"__std_{c}"))])


def apply_normalization(df: DataFrame, fitted: DataFrame, keys: Sequence[str], columns: Sequence[str], inplace: bool = False) -> DataFrame:
    """z-scores by fitted means and deviations; groups that were not fitted by their own."""
    w = Window.partitionBy(*keys)
    rows = df.join(fitted, list(keys), "left")
    made = {}
    for c in columns:
        mean, std = F.coalesce(f"__mean_{c}", F.avg(c).over(w)), F.coalesce(f"__std_{c}", F.stddev_samp(c).over(w))
        made[c if inplace else f"{c}_norm"] = F.try_divide(F.col(c) - mean, std)
    return rows.withColumns(made).drop(*[f"__{k}_{c}" for c in columns for k in ("mean", "std")])


def matching_columns(df: DataFrame, features: Sequence[str], stats: Sequence[str]) -> list[str]:
    """Numeric columns whose names hold a feature and a statistic, but no ..._norm."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, k in df.dtypes if (k in numeric or k.startswith("decimal")) and not c.endswith("_norm") and any(f in c for f in features) and any(s in c for s in stats)]


def scale_by_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """column as a share of the table's largest value, if that is above 0; the largest value is one number, fetched once."""
    top = df.agg(F.max(column)).first()[0]
    return df.withColumn(name, F.col(column) / F.lit(top) if top is not None and top > 0 else F.col(column))


def folds(df: DataFrame, group: Sequence[str], shares: Sequence[tuple[str, int]] = (("train", 60), ("val", 20), ("test", 20)), seed: int = 42) -> DataFrame:
    """df with fold: all rows of a group fall into one, by the first eight hex digits of the MD5 of the seed and its key."""
    at = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(g).cast("string") for g in group])), 1, 8), 16, 10).cast("long") % 100
    out, edge = F.lit(shares[-1][0]), 100
    for name, share in reversed(shares):
        edge -= share
        out = F.when(at >= edge, F.lit(name)).otherwise(out) if edge + share == 100 else F.when((at >= edge) & (at < edge + share), F.lit(name)).otherwise(out)
    return df.withColumn("fold", out)


def of_fold(df: DataFrame, split: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    return df.join(split.where(F.col("fold") == fold).select(*keys).distinct(), list(keys), "left_semi")


def with_labels(df: DataFrame, labels: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    out = df.join(labels, list(keys), "left")
    if strict:
        names = [c for c in labels.columns if c not in keys]
        if out.where(" or ".join(f"`{n}` is null" for n in names)).limit(1).count():
            raise ValueError("rows without labels")
    return out


def group_labels(df: DataFrame, keys: Sequence[str], labels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first label of each group that is not null."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in labels])


def impute(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, nan and infinite values become the mean over train; of other columns the most frequent value."""
    numeric = [c for c, k in df.dtypes if c in columns and k in ("double", "float", "int", "bigint")]
    others = [c for c in columns if c not in numeric]

    def clean(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    stats = train.agg(*[F.avg(clean(c)).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in others]).first()
    return df.withColumns({c: F.coalesce(clean(c), F.lit(stats[c]).cast("double")) for c in numeric} | {c: F.coalesce(F.col(c), F.lit(stats[c])) for c in others})


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(guess) - F.col(truth)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(truth))).alias("r2"))


def classification_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, and precision, recall and F1 averaged over the classes that occur."""
    pairs = df.groupBy(F.col(truth).alias("a"), F.col(guess).alias("b")).agg(F.count("*").alias("k"))
    sides = pairs.select(F.col("a").alias("c"), F.col("k").alias("real"), F.lit(0).alias("said"), F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0).alias("hit")).unionByName(pairs.select(F.col("b").alias("c"), F.lit(0).alias("real"), F.col("k").alias("said"), F.lit(0).alias("hit")))
    each = sides.groupBy("c").agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "real"), F.lit(0.0))
    return each.agg((F.sum("hit") / F.sum("real")).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f1"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """auc of one row: the share of pairs of a positive (1) and a negative (0) whose scores stand in that order, ties counting half; null without both.

    Rows are counted by distinct score, so that ranks run over those.
    """
    each = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).cast("double").alias("p"), F.count_if(F.col(truth) == 0).cast("double").alias("n"))
    below = F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("p", "n", F.coalesce(below, F.lit(0.0)).alias("below")).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def pivoted(df: DataFrame, rows: Sequence[str], column: str, value: Column, most: int = 200) -> DataFrame:
    """A row for each value of rows, a column for each of column (sorted; more than most are an error), with the aggregate value."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    return df.groupBy(*rows).pivot(column, found).agg(value)


def task_type(df: DataFrame, label: str, most: int = 20) -> str:
    """classification for text, booleans and few whole values; else regression."""
    kind = dict(df.dtypes)[label]
    if kind in ("string", "boolean"):
        return "classification"
    few = df.select(label).distinct().limit(most + 1).count() <= most
    return "classification" if few and (kind in ("int", "bigint", "smallint") or not df.where(F.col(label) != F.floor(label)).limit(1).count()) else "regression"


Table = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def listed_paths(df: DataFrame, roles: Roles) -> DataFrame:
    """(id, path): the rows of each trajectory in order, as one array of their values (x, y and, if known, duration)."""
    from trajecta.plans.extractor import with_id

    values = [roles.x, roles.y, *([roles.duration] if roles.duration else [])]
    listed = F.array_sort(F.collect_list(F.struct("seq", *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])))
    flat = F.flatten(F.transform(listed, lambda r: F.array(*[r[f"v{i}"] for i in range(len(values))])))
    return with_id(numbered(df, roles), roles).groupBy("id").agg(flat.alias("path"))


class Pairs:
    """All pairs of trajectories, dealt out in pairs of blocks, so that no task holds more than two blocks. Pairs leave a task only if rows are asked for.

    measure: of two paths, or (by_table) a table of two lists of paths. width: values in a row of a path.
    """

    def __init__(self, paths: DataFrame, width: int, measure: Callable, by_table: bool, similarity: bool, block: int) -> None:
        self.width, self.measure, self.by_table, self.similarity = width, measure, by_table, similarity
        n = max(1, -(-paths.count() // block))
        dealt = paths.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        groups = min(n * (n + 1) // 2, 4096)
        more = [c for c in paths.columns if c not in ("id", "path")]
        self.dealt = dealt.select(F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), "c", "id", "path", *more).repartition(max(groups, paths.sparkSession.sparkContext.defaultParallelism), "i", "j")

    def run(self, f: Callable, schema: str) -> DataFrame:
        """f gets the rows of two blocks, the strips (places in the first, values) of the table of their pairs, and whether the blocks are one; and returns an Arrow table."""
        width, measure, by_table, similarity = self.width, self.measure, self.by_table, self.similarity

        def task(table: pa.Table) -> pa.Table:
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            sides = []
            for c in (i, j):
                part = table.filter(pc.equal(table["c"], c)) if i != j else table
                part = part.take(pc.sort_indices(part, sort_keys=[("id", "ascending")]))
                lists = part["path"].combine_chunks()
                flat, cut = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
                sides.append((part, [flat[a:b].reshape(-1, width) for a, b in zip(cut[:-1], cut[1:], strict=True)]))
            (left, p), (right, q) = sides
            names = [s["id"].to_numpy().astype(str) for s, _ in sides]

            def strips():
                for at in range(0, len(p), 256):
                    rows = range(at, min(at + 256, len(p)))
                    if by_table:
                        v = np.asarray(measure(p[rows.start : rows.stop], q), float)
                    else:
                        v = np.zeros((len(rows), len(q)))
                        for k, a in enumerate(rows):
                            for b in range(a if i == j else 0, len(q)):
                                first, second = (p[a], q[b]) if names[0][a] <= names[1][b] else (q[b], p[a])
                                v[k, b] = 1.0 if similarity and names[0][a] == names[1][b] else measure(first, second)
                    if similarity and i == j:
                        v[np.arange(len(rows)), rows] = 1.0
                    yield rows, v

            if not len(p) or not len(q):
                return pa.Table.from_batches([], schema=to_arrow_schema(kind))
            return f(left, right, strips(), i == j)

        kind = _parse_datatype_string(schema)
        return self.dealt.groupBy("i", "j").applyInArrow(task, schema)

    def rows(self, value: Callable[[np.ndarray, pa.Table, pa.Table, range], np.ndarray] = lambda v, left, right, at: v) -> DataFrame:
        """(p, q, value): both triangles."""

        def f(left: pa.Table, right: pa.Table, strips, same: bool) -> pa.Table:
            a, b = (t["id"].combine_chunks() for t in (left, right))
            out = []
            for at, v in strips:
                v = value(v, left, right, at)
                here = np.arange(at.start, at.stop)
                i, j = np.repeat(here, len(b)), np.tile(np.arange(len(b)), len(here))
                flat = v.ravel()
                if same:
                    keep = i <= j
                    i, j, flat = i[keep], j[keep], flat[keep]
                    mirror = i < j
                else:
                    mirror = slice(None)
                out.append(pa.table({"p": a.take(pa.array(i)), "q": b.take(pa.array(j)), "value": flat}))
                out.append(pa.table({"p": b.take(pa.array(j[mirror])), "q": a.take(pa.array(i[mirror])), "value": flat[mirror]}))
            return pa.concat_tables(out)

        return self.run(f, "p string, q string, value double")

    def packed(self) -> DataFrame:
        """(p, q, v): strips of the table with their ids, values as bytes; of two equal blocks the upper triangle counts."""

        def f(left: pa.Table, right: pa.Table, strips, same: bool) -> pa.Table:
            p, q = left["id"].to_pylist(), right["id"].to_pylist()
            made = [(p[at.start : at.stop], q, v.tobytes()) for at, v in strips]
            return pa.table({c: pa.array([m[k] for m in made], kind) for k, (c, kind) in enumerate((("p", pa.list_(pa.string())), ("q", pa.list_(pa.string())), ("v", pa.binary())))})

        return self.run(f, "p array<string>, q array<string>, v binary")

    def sums(self) -> DataFrame:
        """(id, total, top): of each row of the matrix the sum and the largest value."""

        def f(left: pa.Table, right: pa.Table, strips, same: bool) -> pa.Table:
            n, m = len(left), len(right)
            total, top, other, most = np.zeros(n), np.full(n, -np.inf), np.zeros(m), np.full(m, -np.inf)
            for at, v in strips:
                if same:
                    v = np.where(np.arange(m) >= np.arange(at.start, at.stop)[:, None], v, np.nan)
                s = slice(at.start, at.stop)
                total[s], top[s] = np.nansum(v, 1), np.nanmax(v, 1)
                if same:
                    v = np.where(np.arange(m) > np.arange(at.start, at.stop)[:, None], v, np.nan)
                other += np.nansum(v, 0)
                most = np.fmax(most, np.fmax.reduce(v, 0))
            if same:
                return pa.table({"id": left["id"], "total": total + other, "top": np.fmax(top, most)})
            return pa.table({"id": pa.concat_arrays([left["id"].combine_chunks(), right["id"].combine_chunks()]), "total": np.concatenate([total, other]), "top": np.concatenate([top, most])})

        parts = self.run(f, "id string, total double, top double")
        return parts.groupBy("id").agg(F.sum("total").alias("total"), F.max("top").alias("top"))


def pairwise(df: DataFrame, roles: Roles, measure: Callable[[np.ndarray, np.ndarray], float], similarity: bool = False, block: int | None = None, table: Table | None = None, centred: bool = False) -> DataFrame:
    """(p, q, value) between all trajectories, p and q their ids. Trajectories are dealt out in pairs of blocks, so no task holds more than two.

    table: gives measure for all pairs of two lists of paths at once, which is faster. similarity: scaled as (value + 1) /
    the largest such, with 2 on the diagonal before scaling. centred: as double_centred, from sums of rows that are made
    beforehand, so that the pairs themselves are not moved.
    """
    width = 3 if roles.duration else 2
    block = block or (1024 if table else 64)
    paths = listed_paths(df, roles)
    pairs = Pairs(paths, width, table or measure, table is not None, similarity, block)
    if not (similarity or centred):
        return pairs.rows()
    sums = pairs.sums()
    if similarity:
        top = sums.agg(F.max("top")).first()[0]
        least = (top if top is not None and np.isfinite(top) else 0) + 1
        scaled = pairs.rows(lambda v, left, right, at: (v + 1) / least)
        return double_centred(scaled) if centred else scaled
    n, total = sums.agg(F.count("*"), F.sum("total")).first()
    if not n:
        return pairs.rows()
    grand = total / n / n
    known = Pairs(paths.join(sums.select("id", (F.col("total") / n).alias("mean")), "id"), width, table or measure, table is not None, False, block)
    return known.rows(lambda v, left, right, at: -0.5 * (v - left["mean"].to_numpy()[at.start : at.stop, None] - right["mean"].to_numpy()[None] + grand))


def double_centred(matrix: DataFrame) -> DataFrame:
    """(p, q, value) with rows and columns centred, times -1/2. Means are made first and joined, so that no window holds a row of the matrix."""
    by_p, by_q = (matrix.groupBy(c).agg(F.avg("value").alias(f"__{c}")) for c in "pq")
    grand = matrix.agg(F.avg("value")).first()[0]
    return matrix.join(by_p, "p").join(by_q, "q").select("p", "q", (-0.5 * (F.col("value") - F.col("__p") - F.col("__q") + F.lit(grand))).alias("value"))


#: So many rows (1.2 GB) may a matrix on the driver have.
MOST = 12_000


def _parts(df: DataFrame):
    """The rows of df, one part at a time; all parts are made at once beforehand, as the iterator asks for one after the other."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()
        yield from kept.toLocalIterator()
    finally:
        kept.unpersist()


def collect_pairs(df: DataFrame, roles: Roles, measure: Callable[[np.ndarray, np.ndarray], float], table: Table | None = None, block: int | None = None, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """collect_matrix of pairwise, without a row for each pair."""
    paths = listed_paths(df, roles)
    names = [r[0] for r in paths.select("id").orderBy("id").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} rows")
    at, out = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in _parts(Pairs(paths, 3 if roles.duration else 2, table or measure, table is not None, False, block or (1024 if table else 64)).packed()):
        p, q = (np.array([at[k] for k in r[c]]) for c in "pq")
        v = np.frombuffer(r["v"]).reshape(len(p), len(q))
        upper = p[:, None] <= q[None] if set(r["p"]) <= set(r["q"]) else np.ones(v.shape, bool)
        i, j = np.nonzero(upper)
        out[p[i], q[j]] = out[q[j], p[i]] = v[i, j]
    return names, out


def collect_matrix(matrix: DataFrame, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """The matrix as an array, for the dense steps (orders, compromise); more than most rows (1.2 GB) are an error.

    Executors pack the values with their places, which the driver fetches one part at a time.
    """
    names = [r[0] for r in matrix.select("p").distinct().orderBy("p").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} rows")
    at = pa.array(names, pa.string())

    def pack(batches):
        for b in batches:
            p, q = (pc.index_in(b[c], at).to_numpy().astype(np.int32).tobytes() for c in "pq")
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.binary()), "q": pa.array([q], pa.binary()), "v": pa.array([b["value"].to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary())})

    out = np.zeros((len(names), len(names)))
    for r in _parts(matrix.select("p", "q", "value").mapInArrow(pack, "p binary, q binary, v binary")):
        out[np.frombuffer(r["p"], np.int32), np.frombuffer(r["q"], np.int32)] = np.frombuffer(r["v"])
    return names, out


def rv_of(df: DataFrame, roles: Roles, factors: Sequence[Callable[[list[np.ndarray], int], tuple[np.ndarray, np.ndarray]]]) -> float:
    """kernels.rv of the double-centred matrices of two measures that are products U V' of rows made of each path (and the number of steps of the longest).

    No pair is made: with centred U and V the sum of products of two such matrices is that of the elements of U1'U2 and
    V1'V2. Time grows with the number of trajectories, and memory with the square of the number of steps.
    """
    paths, width = listed_paths(df, roles), 3 if roles.duration else 2
    steps = int((paths.agg(F.max(F.size("path"))).first()[0] or 0) / width)

    def grams(batches):
        n, mean, gram = 0, None, None
        for b in batches:
            lists = [np.asarray(p.values.to_numpy(zero_copy_only=False)).reshape(-1, width) for p in b["path"]]
            for at in range(0, len(lists), 512):
                made = [f(lists[at : at + 512], steps) for f in factors]
                own = [np.hstack([m[side] for m in made]) for side in (0, 1)]
                part = len(own[0]), [o.mean(0) for o in own], [(o - o.mean(0)).T @ (o - o.mean(0)) for o in own]
                n, mean, gram = K.merged_grams((n, mean, gram), part)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "mean": pa.array([np.array(mean).tobytes()], pa.binary()), "gram": pa.array([np.array(gram).tobytes()], pa.binary())})

    total = (0, None, None)
    for r in paths.select("path").coalesce(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(grams, "n long, mean binary, gram binary").collect():
        mean = np.frombuffer(r["mean"]).reshape(2, -1)
        total = K.merged_grams(total, (r["n"], list(mean), list(np.frombuffer(r["gram"]).reshape(2, mean.shape[1], -1))))
    if not total[0]:
        return float("nan")
    first = factors[0]([np.zeros((1, width))], steps)[0].shape[1]
    u, v = total[2]
    cut = slice(None, first), slice(first, None)
    both = [[float((u[a, b] * v[a, b]).sum()) for b in cut] for a in cut]
    return both[0][1] / float(np.sqrt(both[0][0] * both[1][1]))


def order_of(names: list[str], m: np.ndarray, how: str = "hierarchical") -> list[str]:
    order = {"hierarchical": lambda: K.ward_order(m), "optimal": lambda: K.ward_order(m, True), "mds": lambda: K.mds_order(m), "spectral": lambda: K.spectral_order(m)}[how]()
    return [names[i] for i in order]


def order_rows(matrix: DataFrame, how: str = "hierarchical") -> list[str]:
    return order_of(*collect_matrix(matrix), how)
