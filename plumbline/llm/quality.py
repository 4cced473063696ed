"""Quality rules: fixed limits, and robust multivariate outliers by minimum covariance determinant for each language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_tables, hash_spans, join_small, materialize, mix, steps, table, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Transformed statistics, and the least standard deviation of each, whose square is added to the variance: where over half of a
#: group's documents have the same value (no symbol, no repeat), the estimated one is near zero.
FEATURES = ("f_length", "f_word", "f_symbols", "f_lines", "f_repeats")
FLOOR = (0.3, 0.03, 0.1, 0.25, 0.2)
#: Squared distances above this are outliers: the 1 - 1e-7 quantile of chi-square with five degrees of freedom.
CUTOFF = 41.0
#: A (lang, source) with fewer rows is judged by its language; a language with fewer rows, by all rows.
LEAST_ROWS = 200
GROUP = ("lang", "source")


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of keys found twice or more in their row, and of those equal to an earlier one of their row."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        salted = mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(salted, kind="stable")
        same = salted[order][1:] == salted[order][:-1]
        later[order[1:]] = same
        again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return again, later


def count_step(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a flat text buffer."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    per_row = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64)
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    hashes = hash_spans(data, start, end)
    third = hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + mix(hashes[2:] * np.uint64(7)) if len(row) > 2 else hashes[:0]
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    found = at[_repeated(third[at], row[at])[0]]
    covered = np.zeros(len(start), bool)
    for k in range(3):
        covered[found + k] = True
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((breaks + 1, offsets[:-1])))
    line_start = line_start[line_start < len(data)]
    line_row = row_of(line_start)
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(next_break, offsets[line_row + 1])
    real = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    dup = _repeated(hash_spans(data, line_start[real], line_end[real]), line_row[real])[1]
    return {
        "n_words": per_row(row),
        "word_chars": per_row(row, end - start) - per_row(row_of(np.flatnonzero((data & 0xC0) == 0x80))),  # bytes in words that begin a code point
        "n_symbols": per_row(row_of(np.flatnonzero(SYMBOL[data]))),
        "n_dup_lines": per_row(line_row[real][dup]),
        "n_repeat_words": per_row(row[covered]),
    }


def count_text(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (row, counts) of docs: a struct of the columns keep, and the counts of each whole text; a null text has none."""
    inside = "text" in keep
    taken = docs.select(F.struct(*keep).alias("row"), *([] if inside else ["text"]))
    schema = taken.select("row").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, b.column(0).field("text") if inside else "text"):
                found = count_step(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["row", *COUNTS])

    return taken.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed(counts: DataFrame) -> DataFrame:
    """Log and ratio transforms of the counts that are near to elliptical on prose. The mean word length of short texts, which varies more, is drawn to five."""
    words_ = F.greatest("n_words", F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word": F.log((F.col("word_chars") + 250) / (words_ + 50)),
            "f_symbols": F.asinh(10 * F.col("n_symbols") / words_),
            "f_lines": F.asinh(F.col("n_dup_lines").cast("double")) / 2,
            "f_repeats": F.asinh(5 * F.col("n_repeat_words") / words_),
        }
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from mu under the inverse covariance inv, which is kept row by row."""
    p = len(FEATURES)
    off = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        total = total + off[i] * off[i] * F.col("inv")[i * p + i]
        for j in range(i):
            total = total + 2 * off[i] * off[j] * F.col("inv")[i * p + j]
    return F.greatest(total, F.lit(0.0))


def _moments(columns: list[Column]) -> list[Column]:
    """The number of rows, sums and sums of products."""
    out = [F.count("*").alias("n")]
    for i, x in enumerate(columns):
        out.append(F.sum(x).alias(f"s{i}"))
        out += [F.sum(x * columns[j]).alias(f"s{i}_{j}") for j in range(i + 1)]
    return out


def consistency(share: float, p: int = len(FEATURES)) -> float:
    """What the covariance of the share of rows nearest to the centre is multiplied by, for normal rows of p dimensions."""
    x = np.linspace(0, 60, 600_001)[1:]
    density = x ** (p / 2 - 1) * np.exp(-x / 2)
    upto = np.cumsum(density) / density.sum()
    inside = upto <= share
    return float(share * p / (np.sum((x * density)[inside]) / density.sum()))


def _covariance(r: dict) -> tuple[np.ndarray, np.ndarray]:
    p, n = len(FEATURES), r["n"]
    mu, cov = np.array([r[f"s{i}"] for i in range(p)]) / n, np.empty((p, p))
    for i in range(p):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / n - mu[i] * mu[j]
    return mu, cov


ESTIMATE = "grp string, start int, n long, mu array<double>, inv array<double>, det double"


def _estimate(grp: str, start: int, n: int, mu: np.ndarray, cov: np.ndarray) -> list:
    """An estimate's row. The floor is added, so that rows on a line or plane, of whatever direction, have no determinant near zero."""
    cov = cov + np.diag(np.square(FLOOR))
    return [grp, start, n, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])]


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Rows of ESTIMATE from the moments of the nearest rows of each (grp, start)."""
    def run(frames):
        for m in frames:
            rows = [_estimate(r["grp"], r["start"], r["n"], mu, factor * cov) for r in m.to_dict("records") for mu, cov in [_covariance(r)]]
            yield pd.DataFrame(rows, columns=["grp", "start", "n", "mu", "inv", "det"])

    return moments.mapInPandas(run, ESTIMATE)


def _starts(features: DataFrame) -> DataFrame:
    """Three first estimates of each grp: 0, medians and median deviations; 1, the median and the covariance of the rows' directions
    from it, which no row far out can bend; 2, the mean and covariance of all rows."""
    p = len(FEATURES)
    middle = features.groupBy("grp").agg(F.array(*(F.percentile_approx(f, 0.5, 1000) for f in FEATURES)).alias("mid"))
    middle = materialize(_few(middle), "medians")
    off = [F.abs(F.col(f) - F.col("mid")[i]) for i, f in enumerate(FEATURES)]
    spread = join_small(features, middle, "grp").groupBy("grp").agg(F.first("mid").alias("mid"), F.array(*(F.percentile_approx(x, 0.5, 1000) for x in off)).alias("mad"))
    spread = materialize(_few(spread).withColumn("scale", F.transform("mad", lambda x, i: F.greatest(1.4826 * x, F.element_at(F.array(*map(F.lit, FLOOR)), i + 1)))), "deviations")
    z = [(F.col(f) - F.col("mid")[i]) / F.col("scale")[i] for i, f in enumerate(FEATURES)]
    length = F.sqrt(sum((x * x for x in z), F.lit(1e-12)))
    turned = join_small(features, spread, "grp").select("grp", *FEATURES, *((x / length).alias(f"u{i}") for i, x in enumerate(z)))
    both = turned.groupBy("grp").agg(*_moments([F.col(f) for f in FEATURES]), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"t{i}_{j}") for i in range(p) for j in range(i + 1)))
    joined = join_small(_few(both), spread, "grp")

    def run(frames):
        for m in frames:
            rows = []
            for r in m.to_dict("records"):
                mid, scale = np.array(r["mid"]), np.array(r["scale"])
                turns = np.empty((p, p))
                for i in range(p):
                    for j in range(i + 1):
                        turns[i, j] = turns[j, i] = r[f"t{i}_{j}"] / r["n"]
                rows += [_estimate(r["grp"], 0, r["n"], mid, np.diag(scale**2)), _estimate(r["grp"], 1, r["n"], mid, p * turns * np.outer(scale, scale)), _estimate(r["grp"], 2, r["n"], *_covariance(r))]
            yield pd.DataFrame(rows, columns=["grp", "start", "n", "mu", "inv", "det"])

    out = materialize(joined.mapInPandas(run, ESTIMATE), "mcd")
    drop_tables(middle, spread)
    return out


def _concentrated(features: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """The estimates from the share of rows nearest under each estimate, whose limit is a quantile of the distances to a thousandth of the rows."""
    now = now.withColumn("key", F.struct("grp", "start"))
    away = join_small(features, now.select("grp", "start", "mu", "inv"), "grp").select("grp", "start", *FEATURES, _distance().alias("away"))
    limits = materialize(_few(away.groupBy("grp", "start").agg(F.percentile_approx("away", share, 1000).alias("limit"))), "limits")
    bounded = join_small(now, limits.withColumn("key", F.struct("grp", "start")).select("key", "limit"), "key")
    near = join_small(features, bounded.select("grp", "start", "limit", "mu", "inv"), "grp").where(_distance() <= F.col("limit"))
    out = materialize(_estimates(_few(near.groupBy("grp", "start").agg(*_moments([F.col(f) for f in FEATURES]))), consistency(share)), "mcd")
    drop_tables(limits)
    return out


def _few(groups: DataFrame) -> DataFrame:
    """A table of one row for each group in one partition for each core, however many the session sets for shuffles."""
    return groups.coalesce(groups.sparkSession.sparkContext.defaultParallelism)


def fit_mcd(features: DataFrame, share: float = 0.75, tried: int = 2, rounds: int = 12) -> DataFrame:
    """Minimum covariance determinant of each grp of features by concentration steps: rows of ESTIMATE.

    Each of three starts takes tried steps; the one with the least determinant goes on until no group's determinant falls by more
    than a thousandth (the quantiles are no finer), for rounds at most. Everything but the group table stays distributed; groups
    combine before shuffles. The covariance is made consistent for normal rows, and FLOOR squared is added to its variances.
    """
    now = _starts(features)
    for _ in range(tried):
        now, before = _concentrated(features, now, share), now
        drop_tables(before)
    best = materialize(_few(now.groupBy("grp").agg(F.min_by(F.struct(*now.columns), F.struct("det", "start")).alias("e"))).select("e.*"), "mcd")
    drop_tables(now)
    for _ in range(rounds):
        now = _concentrated(features, best, share)
        pairs = join_small(now.select("grp", "det"), best.select("grp", F.col("det").alias("was")), "grp")
        falls = pairs.agg(F.count_if(F.col("det") < F.col("was") - 0.001)).first()[0]
        drop_tables(best)
        best = now
        if not falls:
            break
    return best


def judge_quality(docs: DataFrame, *keep: str, share: float = 0.75, cutoff: float = CUTOFF) -> DataFrame:
    """The columns keep of docs(lang, source, text), the counts, base_failed, distance and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. Other rows are compared with the
    minimum covariance determinant estimate of their language and source and kept up to a squared distance of cutoff. A language and
    source with fewer than LEAST_ROWS such rows is compared with the estimate of all its language's rows, large sources too; a
    language with fewer, with the estimate of all rows. Null values form groups of their own. Null and empty texts fail; repeated
    rows are judged one by one; an empty table gives none. Columns of docs with the names of added ones are not kept.
    """
    added = (*COUNTS, "base_failed", "distance", "kept")
    keep = tuple(c for c in keep if c not in added)
    out = _judged(docs, keep, share, cutoff)
    return out.select(*(F.col("row")[c].alias(c) for c in keep), *added)


def _judged(docs: DataFrame, keep: tuple[str, ...], share: float = 0.75, cutoff: float = CUTOFF) -> DataFrame:
    """Rows (row, counts, base_failed, distance, kept); row is a struct of the columns keep, so that no name of docs can clash."""
    named = [*dict.fromkeys((*keep, *GROUP))]
    groups = {"_lang": F.to_json(F.struct(F.col("row.lang").alias("lang"))), "_both": F.to_json(F.struct(*(F.col(f"row.{c}").alias(c) for c in GROUP)))}
    counts = materialize(count_text(docs, *named).withColumn("base_failed", base_failed()).withColumns(groups), "quality")
    sizes = counts.groupBy("_both", "_lang").agg(F.count_if(~F.col("base_failed")).alias("n_both"))
    sizes = sizes.selectExpr("*", "sum(n_both) OVER (PARTITION BY _lang) AS n_lang")  # one row per language and source
    large, mid = F.col("n_both") >= LEAST_ROWS, F.col("n_lang") >= LEAST_ROWS
    placed = materialize(_few(sizes).select("_both", "_lang", F.when(large, F.col("_both")).when(mid, F.col("_lang")).otherwise("").alias("grp")), "groups")
    used = placed.select("grp").distinct()
    fits = placed.select("_both", F.explode(F.array("_both", "_lang", F.lit(""))).alias("grp")).join(used, "grp")
    fits = materialize(_few(fits.groupBy("_both").agg(F.collect_list("grp").alias("grps"))), "fits")  # three at most
    rows = transformed(join_small(counts.where("NOT base_failed").drop("row"), fits, "_both"))
    features = materialize(rows.select(F.explode("grps").alias("grp"), *FEATURES), "features", 3 * counts.count())
    fitted = fit_mcd(features, share)
    estimates = materialize(join_small(placed.select("_both", "grp"), fitted, "grp", "left").select("_both", "mu", "inv"), "estimates")
    drop_tables(features, fitted, placed, fits)
    judged = transformed(join_small(counts, estimates, "_both", "left")).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_quality keeps, all columns as they are."""
    return _judged(docs, tuple(docs.columns)).where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", *COUNTS, "base_failed", "kept")
