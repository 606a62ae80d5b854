"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of four statistics, transformed so that their spread
does not hang on their size: log of the mean word length, and the arcsine root
of three shares (symbols by characters, repeated lines by lines, words in
repeated 3-word windows by words).  For each language and source the centre
and covariance are those of the three quarters of its documents that lie
closest together (C-steps from two deterministic starts, the smaller
determinant wins; steps go on until no determinant falls; then one reweighting
step).  A document whose Mahalanobis
distance passes ``CUTOFF`` is rejected, like one that fails the base rules.

A variance floor (``FLOOR``, squared, added to the diagonal) says what spread
always counts as ordinary; without it a statistic that is 0 in most documents
would make every other value infinitely far.  Language and source pairs with
fewer than ``MIN_GROUP`` documents that pass the base rules are judged by the
estimate of their whole language, languages with fewer by that of the whole
table, however small it is.

Scale.  Texts are read once.  A C-step is one aggregation: moments are summed
by (group, start, bin of the distance) on the map side, and the cumulated bins
give both the three-quarter threshold and the moments below it.  So no group
is ever collected, however large, and every document takes part.

Defined cases: a null or wordless text fails the base rules; null languages
and sources are values of their own; repeated rows count as often as they come
(and get the same verdict); where no document passes the base rules nothing can
be estimated and distances are null; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import ASCII_SPACE, fresh, sized, stored, with_uid, written

SYMBOLS = "#*$%&|<>"
STATS = ("word_length", "symbols", "repeated_lines", "repeated_words")
FLOOR = (0.06, 0.03, 0.15, 0.15)
CUTOFF = 8.0
CORE = 0.75
MIN_GROUP = 50
STILL = 1e-6  # a smaller fall of a log determinant ends a group's steps
BINS = 32  # bins for each doubling of the squared distance
P = len(STATS)


def _cdf(x: float, dof: int) -> float:
    """Chi-square distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def _quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cdf(mid, dof) < q else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Factor that makes the covariance of the innermost ``share`` of normal
    vectors that of all of them."""
    return share / _cdf(_quantile(share, P), P + 2)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, two = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)
    _, at, count = np.unique(two[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = count[at] > 1
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j:j + n - 2] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (len(words), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeat_words(words))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _count(batches):
    names = ["uid", "doc_id", "lang", "source", *COUNTS]
    for b in batches:
        text = b.column("text")
        for i in range(0, b.num_rows, 256):
            got = list(zip(*(statistics(t) for t in text[i:i + 256].to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c)[i:i + 256] for c in names[:4]), *(pa.array(c, pa.int64()) for c in got)], names=names)


def measured(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The base counts, ``base_failed`` and x0..x3 of every row (written)."""
    src = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                               F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")))
    raw = src.mapInArrow(_count, "uid long, doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return written(
        raw.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
        .withColumn("x0", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))))
        .withColumn("x1", share("n_symbols", "word_chars")).withColumn("x2", share("n_dup_lines", "n_lines"))
        .withColumn("x3", share("n_repeat_words", "n_words")), "stats")


def _grouped(stats: DataFrame, min_group: int) -> DataFrame:
    """stats plus ``grp``, the group whose estimate judges a document, and
    ``fits``, the groups whose estimates it takes part in."""
    fit = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    seen = stats.select("lang", "source").distinct().alias("a").join(
        fit.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left"
    ).select("a.lang", "a.source", F.coalesce("n", F.lit(0)).alias("n"))
    of_lang = Window.partitionBy("lang")
    own, wide = F.col("n") >= min_group, F.col("n_lang") >= min_group
    some = written(seen.withColumn("n_lang", F.sum("n").over(of_lang))
                   .withColumn("rare", F.max(F.when(own, 0).otherwise(1)).over(of_lang) == 1), "pairs")
    table = not some.where(~own & ~wide).isEmpty()  # some are judged by the whole table
    pair, lang = (F.concat(F.lit(k), F.to_json(F.struct(*c))) for k, c in (("pair", ("lang", "source")), ("lang", ("lang",))))
    grp = F.when(own, pair).when(wide, lang).otherwise(F.lit("table"))
    fits = F.array_compact(F.array(F.when(own, pair), F.when(F.col("rare") & wide, lang), F.lit("table") if table else F.lit(None).cast("string")))
    named = written(some.select(F.col("lang").alias("l2"), F.col("source").alias("s2"), grp.alias("grp"), fits.alias("fits")), "groups")
    return stats.join(sized(named, 400), F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2"))).drop("l2", "s2")


def _middle(values: DataFrame, out: str) -> DataFrame:
    """Median of v by (grp, i) from counts of values rounded to 1/1000."""
    per = values.groupBy("grp", "i", F.round(F.col("v") * 1000).cast("long").alias("b")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp", "i")
    cum = per.withColumn("cum", F.sum("c").over(w.orderBy("b"))).withColumn("n", F.sum("c").over(w))
    return cum.where("2 * cum >= n").groupBy("grp", "i").agg((F.min("b") / 1000).alias(out))


def _solve(factor: float, floor: tuple):
    """mapInPandas: summed moments -> centre, precision matrix, determinant."""
    def fn(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                m = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.k
                c = np.array([[getattr(r, f"q{min(i, j)}{max(i, j)}") for j in range(P)] for i in range(P)]) / r.k - np.outer(m, m)
                rows.append(_params(r.grp, r.start, m, c * factor, floor))
            yield pd.DataFrame(rows, columns=["grp", "start", "m", "w", "logdet"])
    return fn


def _params(grp, start, m, cov, floor):
    cov = cov + np.diag(np.square(floor))
    return grp, start, m.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


PARAMS = "grp string, start int, m array<double>, w array<double>, logdet double"


def _starts(fit: DataFrame, floor: tuple) -> DataFrame:
    """Two starts at the medians: scaled by median deviations, or by the floor alone."""
    long = fit.select("grp", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("i", "v"))
    med = written(_middle(long, "med"), "median")
    dev = long.join(sized(med, 200), ["grp", "i"]).select("grp", "i", F.abs(F.col("v") - F.col("med")).alias("v"))
    both = med.join(_middle(dev, "mad"), ["grp", "i"]).groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("i", "med", "mad"))).alias("s"))  # four entries a group

    def fn(frames):
        for f in frames:
            rows = []
            for g, s in zip(f["grp"], f["s"]):
                m, mad = np.array([x["med"] for x in s]), np.array([x["mad"] for x in s])
                rows.append(_params(g, 0, m, np.diag(np.square(1.4826 * mad)), floor))
                rows.append(_params(g, 1, m, np.zeros((P, P)), floor))
            yield pd.DataFrame(rows, columns=["grp", "start", "m", "w", "logdet"])

    return written(both.mapInPandas(fn, PARAMS), "starts")


def _distance():
    terms = None
    for i in range(P):
        for j in range(P):
            t = (F.col(f"x{i}") - F.col("m")[i]) * (F.col(f"x{j}") - F.col("m")[j]) * F.col("w")[i * P + j]
            terms = t if terms is None else terms + t
    return F.when(terms.isNotNull(), F.greatest(terms, F.lit(0.0)))


def _moments():
    return [F.count("*").alias("k"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i, P))]


def _c_step(fit: DataFrame, params: DataFrame, core: float, floor: tuple) -> DataFrame:
    near = fit.join(sized(params, 400), "grp").withColumn("d2", _distance())
    bins = near.groupBy("grp", "start", F.floor(F.log2(F.col("d2") + 1e-9) * BINS).alias("b")).agg(*_moments())
    w = Window.partitionBy("grp", "start")
    names = [c for c in bins.columns if c not in ("grp", "start", "b")]
    cum = bins.withColumn("n", F.sum("k").over(w)).select(
        "grp", "start", "b", "n", *(F.sum(c).over(w.orderBy("b")).alias(c) for c in names))
    inner = cum.where(F.col("k") >= F.lit(core) * F.col("n")).groupBy("grp", "start").agg(
        F.min_by(F.struct(*names), "b").alias("x")).select("grp", "start", "x.*")
    return written(inner.mapInPandas(_solve(consistency(core), floor), PARAMS), "params")


def estimates(stats: DataFrame, min_group: int = MIN_GROUP, core: float = CORE, floor: tuple = FLOOR):
    """(rows with ``grp``, grp, m, w): robust centre and precision by group."""
    rows = written(_grouped(stats, min_group), "grouped")
    fit = rows.where("not base_failed").select(F.explode("fits").alias("grp"), *[f"x{i}" for i in range(P)])
    params = _starts(fit, floor)
    for k in range(3):
        params = _c_step(fit, params, core, floor)
    # the better start of each group goes on alone
    moving = written(params.groupBy("grp").agg(F.min_by(F.struct("start", "m", "w", "logdet"), F.struct("logdet", "start")).alias("x"))
                     .select("grp", "x.*"), "best")
    done = None
    while not moving.isEmpty():
        new = _c_step(fit, moving, core, floor)
        both = written(moving.join(new.select("grp", F.struct("m", "w", "logdet").alias("new")), "grp"), "steps")
        falls = F.col("logdet") - F.col("new.logdet") > STILL
        rest = both.where(~falls).select("grp", "start", "m", "w", "logdet")
        done = rest if done is None else done.unionByName(rest)
        moving = both.where(falls).select("grp", "start", "new.m", "new.w", "new.logdet")
    if done is None:
        return rows, params.select("grp", "m", "w")
    inside = fit.join(sized(written(done, "settled"), 400), "grp").withColumn("d2", _distance()).where(F.col("d2") <= _quantile(0.975, P))
    final = inside.groupBy("grp", "start").agg(*_moments()).where("k > 0")
    return rows, written(final.mapInPandas(_solve(consistency(0.975), floor), PARAMS), "final").select("grp", "m", "w")


def quality(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, core: float = CORE,
            floor: tuple = FLOOR, **columns) -> DataFrame:
    """One row per document: uid, doc_id, the base counts, base_failed,
    distance (null where nothing can be estimated) and kept."""
    stats = measured(docs, **columns)
    rows, params = estimates(stats, min_group, core, floor)
    far = rows.join(sized(params, 400), "grp", "left").withColumn("distance", F.sqrt(_distance()))
    ok = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return far.withColumn("kept", ~F.col("base_failed") & ok).select(
        "uid", "doc_id", *COUNTS, "base_failed", "distance", "kept")


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` that pass."""
    docs, uid = stored(docs), fresh(docs, "q_uid")
    out = written(quality(docs, **options).where("not kept").select(F.col("uid").alias(uid)), "rejected")
    return with_uid(docs, uid).join(sized(out, 16), uid, "left_anti").select(*docs.columns)
