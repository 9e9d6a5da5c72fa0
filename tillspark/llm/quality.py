"""Operator 9: quality rules with robust multivariate outliers, in DataFrame functions only.

``statistics`` counts words, symbols, repeated lines and repeated 8-word windows of every text.
``outliers`` estimates centre and scatter of the transformed statistics in each cell (language and source) by
the minimum covariance determinant and measures each document's Mahalanobis distance from its own cell.

The estimate has ``STARTS`` deterministic starts, all about the medians: scatter by the median deviations alone,
by the squashed (tanh) and by the spatial-sign covariance of what is scaled by them.  From each, concentration
steps go on until no cell's determinant falls any more: centre and covariance of a subset, then the ``SUPPORT``
share of documents nearest under them.  The start with the least determinant gives the cell's estimate.  Every
step is one grouped aggregation of bounded state.  Distances are scaled so that their median is that of a
chi-square; a cell of under ``least_cell`` documents is estimated with the other small ones of its language, and
those that are still few all together (1: every cell by itself).

Cases: a null text has no words and fails the base rules; null language or source is a cell of its own, apart
from the empty string; texts that fail the base rules don't enter the estimates; a cell whose statistics don't
vary gets the variance floor; repeated rows are judged alike; a text of any length is counted whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BLANKS = " \t\n\x0b\x0c\r"
#: Words of the windows that count as repeated.
WINDOW = 8
SUPPORT, STARTS, LEAST_CELL = 0.75, 3, 100
#: By how much a log determinant falls at least in a step that counts.
FALL = 1e-3
#: Added to the variances, on the scale of the transformed statistics: most texts repeat nothing, so that
#: the last two would else reject any repeated line.
FLOORS = (0.05**2, 0.05**2, 0.05**2, 0.1**2, 0.25**2)
#: Median and cut of a chi-square with five degrees; the cut is passed once in 10**12 normal cases.
CHI_MEDIAN, CUT = 4.3515, 64.0
FEATURES = 5
#: Up to so many cells (some 200 bytes each) are broadcast to their documents; more are joined by a shuffle.
BROADCAST_CELLS = 10_000


def _small(side: DataFrame, few: bool) -> DataFrame:
    """``side``, of a row a cell (or a cell and start), marked for broadcast if cells are few: they are uneven."""
    return F.broadcast(side) if few else side


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and ``keep``."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # `_lines` and the arrays below are used more than once, so that the optimiser doesn't inline them
    first = docs.select(*keep, words.alias("_words"), lines.alias("_lines"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    second = first.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))
    third = second.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows).otherwise(F.array().cast("array<long>"))).drop("_hashes")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    fourth = third.withColumn("_ordered", F.when(repeats, ordered)).drop("_windows")

    def again(x: Column, k: Column) -> Column:
        before = F.get(F.col("_ordered"), k - 1)["h"]
        behind = F.get(F.col("_ordered"), k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(behind == x["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter("_ordered", again), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")))["n"]
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_ordered")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _parts() -> tuple[Column, Column]:
    """Language and source, with null apart from the empty string."""
    return tuple(F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))


def _cell_table(rows: DataFrame, least_cell: int) -> DataFrame:
    """The cell in which each language and source is estimated."""
    lang, source = _parts()
    counts = staged(rows.groupBy(lang.alias("_l"), source.alias("_s")).count(), "counts")
    few = F.col("count") < least_cell
    by_lang = counts.where(few).groupBy("_l").agg(F.sum("count").alias("_n"))
    counts = counts.join(by_lang, "_l", "left")
    cell = F.when(~few, F.concat_ws("\x1f", "_l", "_s")).when(F.col("_n") >= least_cell, F.col("_l")).otherwise("\x1e")
    return staged(counts.select("_l", "_s", cell.alias("cell")), "cells")


def _cells(rows: DataFrame, least_cell: int) -> DataFrame:
    """``rows`` with the cell in which each is estimated."""
    table = _cell_table(rows, least_cell)
    return _in_cells(rows, table, table.count() <= BROADCAST_CELLS)


def _in_cells(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    lang, source = _parts()
    return rows.withColumns({"_l": lang, "_s": source}).join(_small(table, few), ["_l", "_s"]).drop("_l", "_s")


def _x(i: int) -> str:
    return f"x{i}"


def _sum(terms) -> Column:
    return sum(terms, F.lit(0.0))


KEY = ["cell", "start"]


def _distances(rows: DataFrame, shape: DataFrame, few: bool = True) -> DataFrame:
    """``rows`` with d2, the squared distance under the centre (m) and inverse factor (v) of their key."""
    parts = [_sum(F.col(f"v{i}{j}") * (F.col(_x(j)) - F.col(f"m{j}")) for j in range(i + 1)) for i in range(FEATURES)]
    key = [c for c in KEY if c in rows.columns]
    joined = rows.join(_small(shape, few), key)
    return joined.select(*rows.columns, _sum(p * p for p in parts).alias("d2"))


def _factored(out: DataFrame) -> DataFrame:
    """The key, the centre, the inverse of the Cholesky factor of covariances c, and their log determinant."""
    n = range(FEATURES)
    for i in n:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - _sum(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] / 100))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in n:
        for i in range(j, FEATURES):
            rest = F.lit(1.0) if i == j else -_sum(F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i))
            out = out.withColumn(f"v{i}{j}", rest / F.col(f"l{i}{i}"))
    logdet = 2 * _sum(F.log(F.col(f"l{i}{i}")) for i in n)
    return out.select(*KEY, *(f"m{i}" for i in n), *(f"v{i}{j}" for i in n for j in range(i + 1)), logdet.alias("logdet"))


def _shape(rows: DataFrame) -> DataFrame:
    """Centre and covariance of the rows of each key."""
    n = range(FEATURES)
    means = [F.avg(_x(i)).alias(f"m{i}") for i in n]
    covs = [(F.covar_pop(_x(i), _x(j)) + (FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}") for i in n for j in range(i + 1)]
    return _factored(rows.groupBy(*KEY).agg(*means, *covs))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """The first shapes of each cell: ``STARTS`` scatters about the medians."""
    n = range(FEATURES)
    medians = staged(rows.groupBy("cell").agg(*(F.percentile_approx(_x(i), 0.5).alias(f"m{i}") for i in n)), "medians")
    off = rows.join(_small(medians, few), "cell").groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(_x(i)) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i in n))
    scales = off.select("cell", *(F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i]).alias(f"s{i}") for i in n))
    centres = staged(medians.join(scales, "cell"), "centres")
    z = [((F.col(_x(i)) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in n]
    scaled = rows.join(_small(centres, few), "cell").select("cell", *z)
    scaled = scaled.withColumn("_norm", F.sqrt(F.greatest(_sum(F.col(f"z{i}") * F.col(f"z{i}") for i in n), F.lit(1e-9))))

    def products(start: int, of) -> list[Column]:
        return [F.avg(of(i) * of(j)).alias(f"p{start}{i}{j}") for i in n for j in range(i + 1)]

    found = scaled.groupBy("cell").agg(*products(1, lambda i: F.tanh(f"z{i}")), *products(2, lambda i: F.col(f"z{i}") / F.col("_norm")))

    def scatter(start: int, i: int, j: int) -> Column:
        own = F.lit(float(i == j)) if start == 0 else F.col(f"p{start}{i}{j}")
        return (own * F.col(f"s{i}") * F.col(f"s{j}") + (FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}")

    both = centres.join(found, "cell")
    parts = [both.select("cell", F.lit(k).alias("start"), *(f"m{i}" for i in n), *(scatter(k, i, j) for i in n for j in range(i + 1))) for k in range(STARTS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _factored(staged(out, "starts"))


def estimates(rows: DataFrame, few: bool = True) -> DataFrame:
    """The minimum-determinant shape of each cell of ``rows`` (cell and the transformed statistics).

    A step is two passes: the distance that the nearest share lies within, and the shape of that share, which
    stays if its determinant is the least so far.
    """
    every = rows.select("cell", *(_x(i) for i in range(FEATURES))).withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    best = staged(_starts(rows, few), "shape")
    fields = [c for c in best.columns if c not in KEY]
    first = True
    while True:
        near = _distances(every, best, few)
        edge = staged(near.groupBy(*KEY).agg(F.percentile_approx("d2", SUPPORT).alias("_edge")), "edge")
        shape = _shape(near.join(_small(edge, few), KEY).where("d2 <= _edge"))
        # the first shapes are of other scales, so that they aren't compared
        fell = F.lit(True) if first else F.col("new.logdet") < F.col("old.logdet") - FALL
        lower = F.lit(True) if first else F.col("new.logdet") < F.col("old.logdet")
        both = shape.select(*KEY, F.struct(*fields).alias("new")).join(best.select(*KEY, F.struct(*fields).alias("old")), KEY)
        step = staged(both.select(*KEY, F.when(lower, F.col("new")).otherwise(F.col("old")).alias("b"), fell.alias("_fell")), "shape")
        best = step.select(*KEY, "b.*")
        if not first and step.where("_fell").isEmpty():
            break
        first = False
    return best.groupBy("cell").agg(F.min_by(F.struct(*fields), F.struct("logdet", "start")).alias("b")).select("cell", "b.*")


def outliers(stats: DataFrame, least_cell: int = LEAST_CELL) -> DataFrame:
    """``stats`` (with lang and source) with distance2, null for rows that fail the base rules."""
    own = stats.columns
    rows = stats.where(~base_failed())
    table = _cell_table(rows, least_cell)
    few = table.count() <= BROADCAST_CELLS
    rows = staged(_in_cells(rows, table, few).withColumns({_x(i): x for i, x in enumerate(transformed())}), "cells")
    near = _distances(rows, staged(estimates(rows, few), "estimates"), few)
    middle = staged(near.groupBy("cell").agg(F.percentile_approx("d2", 0.5).alias("_median")), "middle")
    scaled = F.col("d2") * CHI_MEDIAN / F.greatest("_median", F.lit(1e-9))
    judged = near.join(_small(middle, few), "cell").select(*own, scaled.alias("distance2"))
    return judged.unionByName(stats.where(base_failed()).withColumn("distance2", F.lit(None).cast("double")))


def quality_rules(docs: DataFrame, cut: float = CUT, least_cell: int = LEAST_CELL) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2 and kept for every row of ``docs``."""
    stats = staged(statistics(docs, "doc_id", "lang", "source"), "statistics")
    kept = ~base_failed() & (F.col("distance2") <= cut)
    return outliers(stats, least_cell).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.coalesce(kept, F.lit(False)).alias("kept"), "distance2"
    )
