"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives counts (words, symbols, repeated lines, words in repeated
windows, ...).  Two base rules reject outright.  What passes is described by a
vector of transformed statistics; per language and source, the
minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps over all rows: from coordinate-wise medians and absolute
deviations, take the share ``H`` of rows that lie nearest, re-estimate, repeat
until the determinant falls no more.  Scatter is never taken below ``FLOORS``
(statistics that are constant in clean text would else have none).  Rows
beyond a cut-off of the squared Mahalanobis distance are rejected.

Every step is a grouped aggregation over a narrow written table with one row
for each document: a hot source is pre-aggregated in every task, and only sums
and distance histograms are shuffled.

Rows of groups of fewer than ``min_rows`` rows are judged by an estimate over
all rows of their language, those of large groups included, and where the
language is too small too, by one over all rows of the table; a table below
that size is held to the base rules only.

Defined results: null and empty texts have no words and fail the base rule;
null languages and sources are groups of their own; equal rows are counted each
and judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that may not be found twice.
WINDOW = 8
#: The statistics of the vector and the least standard deviation of each.
FLOORS = {"f_length": 0.5, "f_word": 0.08, "f_symbols": 0.12, "f_lines": 0.2, "f_distinct": 0.08, "f_adjacent": 0.12, "f_upper": 0.12, "f_repeat": 0.2}
NAMES = list(FLOORS)
P = len(NAMES)
#: Share of a group's rows that the estimate rests on; most concentration steps; bins of a histogram.
H, STEPS, BINS = 0.75, 12, 2048
#: Groups whose estimates are broadcast; for more, rows and estimates are joined by a shuffle.
GROUPS = 50_000
#: Rejected beyond this many times the chi-squared quantile at H (a robust z of about 9 in one direction).
CUTOFF = 8.0


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of that many words (a power of two) that are found twice or more, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, size = ids.astype(np.int64), 1
    while size < window:
        _, rank = np.unique(rank[:-size] * (int(rank.max()) + 1) + rank[size:], return_inverse=True)
        if rank.max() + 1 == len(rank):
            return 0  # all pairs differ, so all windows do
        size *= 2
    again = np.bincount(rank)[rank] > 1
    steps = np.zeros(len(ids) + 1, np.int64)
    steps[:n] += again
    steps[window : window + n] -= again
    return int((np.cumsum(steps) > 0).sum())


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: splits at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated(ids)
    adjacent = int((ids[1:] == ids[:-1]).sum()) if n else 0
    low = text.lower()
    upper = int((_code_points(text) != _code_points(low)).sum()) if text != low and len(text) == len(low) else 0
    vector = (
        math.log(n + 10),
        math.log((word_chars + 55) / (n + 10)),
        math.sqrt(symbols / (n + 10)),
        math.sqrt(dup_lines / (len(lines) + 10)),
        math.log((len(known) + 10) / (n + 10)),
        math.sqrt(adjacent / (n + 10)),
        math.sqrt(upper / (word_chars + 50)),
        math.sqrt(repeats / (n + 10)),
    )
    return (n, word_chars, symbols, dup_lines, repeats, *vector)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and the vector of each row (and _row if docs have it)."""
    own = ["doc_id", "lang", "source"] + ["_row"] * ("_row" in docs.columns)
    schema = T.StructType(
        [docs.schema[c] if c in docs.columns else T.StructField(c, T.StringType()) for c in own]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("base_failed", T.BooleanType())]
        + [T.StructField(c, T.DoubleType()) for c in NAMES]
    )

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*[statistics(t) for t in common.texts_of(batch)]))
        out = {c: batch.column(batch.schema.get_field_index(c)) for c in own}
        out |= dict(zip(COUNTS + NAMES, map(list, rows)))
        out["base_failed"] = [n < 20 or 100 * r > 30 * n for n, r in zip(out["n_words"], out["n_repeat_words"])]
        return out

    return common.map_batches(docs.select("text", *own), run, schema)


# -- estimates -----------------------------------------------------------------


def _chi2(p: float, k: int) -> float:
    """The chi-squared quantile by Wilson and Hilferty."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


_KEY = ["g_lang", "g_source"]
_PARAMS = T.StructType([T.StructField(k, T.StringType()) for k in _KEY] + [T.StructField("n", T.LongType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("whiten", T.ArrayType(T.DoubleType())), T.StructField("logdet", T.DoubleType()), T.StructField("before", T.DoubleType())])
_LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


#: The statistics' offsets from the column centre, in SQL: one call to the JVM for a formula of many terms.
_OFF = [f"({c} - centre[{k}])" for k, c in enumerate(NAMES)]


def _distance() -> Column:
    """The squared Mahalanobis distance by the columns centre and whiten (rows of the inverse Cholesky factor)."""
    z = [" + ".join(["0.0D", *[f"whiten[{_LOWER.index((i, j))}] * {_OFF[j]}" for j in range(i + 1)]]) for i in range(P)]
    return F.expr(" + ".join(["0.0D", *[f"({x}) * ({x})" for x in z]]))


def _bin(d2: Column) -> Column:
    """The histogram bin of a distance: even steps of its logarithm from e^-12 to e^20."""
    return F.least(F.greatest(F.floor((F.log(d2 + 1e-12) + 12) * (BINS / 32)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _edge(b: Column) -> Column:
    """The upper edge of a bin."""
    return F.exp((b + 1) / (BINS / 32) - 12)


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """rows with the key of the group whose estimate they enter; also in the pools by language and over all that judge small groups.

    A row of a small group enters pools only; a pool that judges no row is not made.
    """
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("\x00")), F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    rows = rows.withColumns({"g_lang": lang, "g_source": source})
    sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("g_lang").agg(F.sum("n").alias("of_lang"), (F.min("n") < min_rows).alias("pooled"))
    by_lang = common.written(by_lang, "languages")
    # one number: whether a language is too small, so that its rows need the estimate over all
    over_all = not by_lang.filter(F.col("of_lang") < min_rows).isEmpty()
    to = sizes.join(by_lang, "g_lang").select(
        *_KEY,
        F.array_compact(
            F.array(
                F.when(F.col("n") >= min_rows, F.struct("g_lang", "g_source")),
                F.when(F.col("pooled") & (F.col("of_lang") >= min_rows), F.struct(F.col("g_lang"), F.lit("\x01").alias("g_source"))),
                F.when(F.lit(over_all), F.struct(F.lit("\x01").alias("g_lang"), F.lit("\x01").alias("g_source"))),
            )
        ).alias("to"),
    )
    keyed = rows.join(common.checked_broadcast(common.written(to, "pooled"), GROUPS), _KEY).withColumn("to", F.explode("to"))
    return keyed.withColumns({"g_lang": F.col("to.g_lang"), "g_source": F.col("to.g_source")}).drop("to")


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians and absolute deviations, from histograms, as first estimates."""
    width = {c: s / 16 for c, s in FLOORS.items()}

    def medians(frame: DataFrame, value) -> DataFrame:
        cells = frame.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(value(c) / width[c]).alias("b")) for k, c in enumerate(NAMES)])).alias("x"))
        cells = cells.groupBy(*_KEY, "x.k", "x.b").agg(F.count("*").alias("n"))

        def middle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["k", "b"])
            out = pdf.iloc[0][_KEY].to_dict() | {"n": int(pdf.loc[pdf.k == pdf.k.iloc[0], "n"].sum())}
            mids = []
            for k in range(P):
                own = pdf[pdf.k == k]
                at = int(np.searchsorted(own.n.cumsum().to_numpy(), own.n.sum() / 2))
                mids.append((own.b.iloc[at] + 0.5) * width[NAMES[k]])
            return pd.DataFrame([out | {"mids": mids}])

        return cells.groupBy(*_KEY).applyInPandas(middle, "g_lang string, g_source string, n long, mids array<double>")

    centres = common.written(medians(rows, F.col), "medians").select(*_KEY, "n", F.col("mids").alias("centre"))
    near = rows.join(common.checked_broadcast(centres.select(*_KEY, "centre"), GROUPS), _KEY)
    spread = medians(near, lambda c: F.abs(F.col(c) - F.col("centre")[NAMES.index(c)]))

    def params(batches):
        for pdf in batches:
            floors = np.array(list(FLOORS.values()))
            pdf["whiten"] = [[1 / max(1.4826 * m[i], floors[i]) if i == j else 0.0 for i, j in _LOWER] for m in pdf["mids"]]
            pdf["logdet"] = pdf["before"] = np.inf
            yield pdf[[f.name for f in _PARAMS]]

    return spread.drop("n").join(centres, _KEY).select(*_KEY, "n", "centre", "mids").mapInPandas(params, _PARAMS)


def _reach(rows: DataFrame) -> DataFrame:
    """Per group the bin that holds the distance of the H-th part of the rows."""
    bins = rows.groupBy(*_KEY, "bin").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*_KEY)  # at most BINS rows
    upto, of_all = F.sum("c").over(group.orderBy("bin")), F.sum("c").over(group)
    return bins.select(*_KEY, "bin", (upto >= F.ceil(H * of_all)).alias("enough")).filter("enough").groupBy(*_KEY).agg(F.min("bin").alias("reach"))


def _estimates(batches):
    """Centres and scatters from the sums of each group."""
    floors = np.array(list(FLOORS.values())) ** 2
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            m = r["m"]
            mean = np.array([r[f"s{i}"] for i in range(P)]) / m
            scatter = np.zeros((P, P))
            for i, j in _LOWER:
                scatter[i, j] = scatter[j, i] = r[f"q{i}_{j}"] / m - mean[i] * mean[j]
            scatter[np.diag_indices(P)] = np.maximum(np.diag(scatter), 0) + floors
            low = np.linalg.cholesky(scatter)
            inv = np.linalg.inv(low)
            # sums carry offsets from the centre before
            out.append({k: r[k] for k in _KEY} | {"n": r["n"], "centre": (mean + np.array(r["origin"])).tolist(), "whiten": [inv[i, j] for i, j in _LOWER], "logdet": 2 * float(np.log(np.diag(low)).sum()), "before": r["before"]})
        yield pd.DataFrame(out, columns=[f.name for f in _PARAMS])


def _step(rows: DataFrame, params: DataFrame, small: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A concentration step: estimates from the H-th part of each group's rows nearest by the params."""
    near = rows.join(small(params), _KEY).withColumn("bin", _bin(_distance()))
    # kept, so that no broadcast waits for a pass over the rows
    near = near.join(small(keep(_reach(near), "reach")), _KEY).filter("bin <= reach")
    sums = [F.expr(f"sum({x}) AS s{i}") for i, x in enumerate(_OFF)] + [F.expr(f"sum({_OFF[i]} * {_OFF[j]}) AS q{i}_{j}") for i, j in _LOWER]
    agg = near.groupBy(*_KEY).agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("centre").alias("origin"), F.first("logdet").alias("before"), *sums)
    return agg.mapInPandas(_estimates, _PARAMS)


def estimates(rows: DataFrame) -> DataFrame:
    """Per group the minimum-covariance-determinant estimate and scale (of squared distances).

    Warns if a determinant still fell in the last step; the estimate is a minimum of fewer steps then.
    """
    params = common.written(_start(rows), "mcd")
    # a row for each group, in all steps; few of them stay out of files, as each write costs the driver's memory plans, threads and processes
    small, keep = (F.broadcast, lambda df, _: common.held(df)) if params.limit(GROUPS + 1).count() <= GROUPS else (lambda df: df, common.written)
    for _ in range(STEPS):
        params = keep(_step(rows, params, small, keep), "mcd")
        if params.filter(F.col("logdet") < F.col("before") - 1e-3).isEmpty():
            break
    else:
        warnings.warn(f"determinants still fell after {STEPS} concentration steps", stacklevel=2)
    scale = _reach(rows.join(small(params), _KEY).withColumn("bin", _bin(_distance())))
    return keep(params.join(scale.select(*_KEY, F.greatest(_edge(F.col("reach")) / _chi2(H, P), F.lit(0.05)).alias("scale")), _KEY), "mcd")


def judged(docs: DataFrame, min_rows: int = 200, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of docs: doc_id (and _row if docs have it), the counts, base_failed, distance and kept."""
    rows = common.written(measured(docs), "quality")
    passed = common.written(_grouped(rows.filter(~F.col("base_failed")).select("lang", "source", *NAMES), min_rows).drop("lang", "source"), "vectors")
    params = common.checked_broadcast(estimates(passed).filter(F.col("n") >= min_rows).select(*_KEY, F.struct("centre", "whiten", "scale").alias("m")), GROUPS)
    # rows of small groups look the estimates by language and over all up in two steps more
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("\x00")), F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    keyed = rows.withColumns({"g_lang": lang, "g_source": source})
    for step in ({}, {"g_source": F.lit("\x01")}, {"g_lang": F.lit("\x01"), "g_source": F.lit("\x01")}):
        name = f"m{len([c for c in keyed.columns if c.startswith('m_')])}"
        keyed = keyed.withColumns(step).join(params.withColumnRenamed("m", f"m_{name}"), _KEY, "left")
    models = [c for c in keyed.columns if c.startswith("m_")]
    best = keyed.withColumn("m", F.coalesce(*models)).withColumns({"centre": F.col("m.centre"), "whiten": F.col("m.whiten")})
    distance = F.when(~F.col("base_failed"), _distance() / F.col("m.scale"))
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff * _chi2(H, P), F.lit(True))
    return best.select("doc_id", *[c for c in ("_row",) if c in docs.columns], *COUNTS, "base_failed", distance.alias("distance"), kept.alias("kept"))


def keep_good(docs: DataFrame, min_rows: int = 200, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that are kept, all columns as they are; each row by itself, whatever its doc_id.

    A row is known by its id and a hash of what it is judged by, so rows with the same of these share their fate.
    """
    docs, back = common.set_aside(docs, ["doc_id", "text", "lang", "source"])
    told = F.xxhash64("text", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("lang", "source")])
    rows = docs.withColumn("_row", told)
    bad = judged(rows, min_rows, cutoff).filter(~F.col("kept")).select(F.col("doc_id").alias("_bad"), F.col("_row").alias("_bad_row")).distinct()
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_bad"]) & (rows["_row"] == bad["_bad_row"]), "left_anti").select(*back)
