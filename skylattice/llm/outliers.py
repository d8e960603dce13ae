"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Each text gives a vector of transformed statistics.  For every language and source a location and scatter are estimated
from the densest part of its texts: from several robust starts, concentration steps keep the share of texts nearest to
the current estimate and estimate again; the start that ends with the smallest determinant counts.  Texts far from that
estimate in Mahalanobis distance are rejected, and so are those that fail fixed base rules.

Everything is DataFrame operations.  Groups are never gathered: each step is a joined row-wise distance, an approximate
quantile and sums that are combined on the map side, so a source with a third of all texts costs no more than its share.
Groups with too few texts for an estimate are pooled by language, and languages with too few over the whole corpus.

Defined results: a null text counts as empty; null languages and sources are groups of their own; texts failing a base
rule have no distance; where even the whole corpus gives too few texts, only base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bound, row_key, settled, text_or_empty, without_rows, word_array

SYMBOLS = "#*$%&|<>"
FEATURES = ("x_words", "x_word_length", "x_symbols", "x_marks", "x_upper", "x_repeats", "x_lines")
#: Smallest variance of each feature: differences below its root mean nothing, even in groups where a feature is constant.
LEAST_VARIANCE = (0.25, 0.04, 0.25, 0.09, 0.16, 1.0, 2.0)


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeated: int = 50  #: per cent of the words that may lie in repeated windows
    core: float = 0.75  #: share of a group's texts that the estimate rests on
    steps: int = 3  #: concentration steps
    least_texts: int = 100  #: texts that a group needs for an estimate of its own
    cutoff: float = 90.0  #: squared distance, in units of a normal sample's


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""
    def count(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(3), F.size(w) - 2), lambda x, i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), x).alias("g"), i.alias("i")))
        twice = bound(F.sort_array(hashes), lambda s: F.transform(F.filter(
            s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"])), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound(words, count)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features' counts, all of the whole text."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    df = docs.withColumns({"__t": t, "__w": word_array(t), "__l": lines})
    return df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": _without(F.col("__t"), SPACE_CHARS).cast("long"),
        "n_symbols": (F.length("__t") - _without(F.col("__t"), SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("__w")),
        "n_lines": F.size("__l").cast("long"),
        "n_marks": F.length(F.regexp_replace("__t", r"[\p{L}\p{N}\s]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace("__t", r"\P{Lu}+", "")).cast("long"),
    }).drop("__t", "__w", "__l")


def features() -> dict[str, Column]:
    def share(count: str, of: str) -> Column:
        return F.log1p(100.0 * F.col(count) / F.greatest(F.col(of), F.lit(1)))

    return dict(zip(FEATURES, (
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        share("n_symbols", "word_chars"), share("n_marks", "word_chars"), share("n_upper", "word_chars"),
        share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"))))


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))


# ---- small matrices as columns ------------------------------------------------------------------------------------

def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _with_precision(df: DataFrame, d: int) -> DataFrame:
    """From the covariance c_i_j (j <= i): its inverse p_i_j and log determinant, by Cholesky factors, one row a matrix."""
    for j in range(d):  # column j of the factor
        head = F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(head, F.lit(1e-12))))
        below = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0)))
                 / F.col(f"l_{j}_{j}") for i in range(j + 1, d)}
        df = df.withColumns(below) if below else df
    for i in range(d):  # row i of the factor's inverse
        df = df.withColumns({f"v_{i}_{j}": (F.lit(1.0) if i == j else -sum(
            (F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l_{i}_{i}")
            for j in range(i + 1)})
    inverse = {f"p_{i}_{j}": sum((F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}") for k in range(i, d)), F.lit(0.0)) for i, j in _pairs(d)}
    logdet = 2 * sum((F.log(f"l_{i}_{i}") for i in range(d)), F.lit(0.0))
    kept = [c for c in df.columns if c[:2] not in ("l_", "v_", "c_")]
    return df.select(*kept, *(c.alias(n) for n, c in inverse.items()), logdet.alias("logdet"))


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of a row's features from the joined m_i, p_i_j."""
    z = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    return sum(((1.0 if i == j else 2.0) * F.col(f"p_{i}_{j}") * z[i] * z[j] for i, j in _pairs(d)), F.lit(0.0))


def _sums(groups, values: list[Column]) -> DataFrame:
    """Per group: n, the sums a_i of the values and the sums b_i_j of their products."""
    return groups.agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"a_{i}") for i, v in enumerate(values)),
                      *(F.sum(values[i] * values[j]).alias(f"b_{i}_{j}") for i, j in _pairs(len(values))))


def _covariance(i: int, j: int) -> Column:
    return F.col(f"b_{i}_{j}") / F.col("n") - F.col(f"a_{i}") / F.col("n") * F.col(f"a_{j}") / F.col("n")


def _cells(vectors: DataFrame, rules: Rules) -> DataFrame:
    """For each language and source: the level of the cell whose estimate it uses (0 its own, 1 its language, 2 the rest)."""
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("own", F.col("n") >= rules.least_texts)
    langs = sizes.filter("NOT own").groupBy("lang").agg(F.sum("n").alias("n_lang"))
    sizes = sizes.alias("s").join(langs.alias("l"), F.expr("s.lang <=> l.lang"), "left").select("s.*", "n_lang")
    level = F.when(F.col("own"), 0).when(F.col("n_lang") >= rules.least_texts, 1).otherwise(2)
    return sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), level.alias("level"))


def estimates(vectors: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per cell: m_i, p_i_j, the scale of its distances and its cell's key.

    ``vectors`` has cell and the features, one row per text that passes the base rules.
    """
    d = len(FEATURES)
    xs = [F.col(f) for f in FEATURES]
    centre = vectors.groupBy("cell").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(FEATURES)),
                                         F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rules.least_texts)
    spread = vectors.join(centre, "cell").groupBy("cell").agg(
        *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, f in enumerate(FEATURES)))
    scaled = centre.join(spread, "cell").select("cell", *(f"m_{i}" for i in range(d)), *(
        F.sqrt((1.4826 * F.col(f"s_{i}")) ** 2 + v).alias(f"s_{i}") for i, v in enumerate(LEAST_VARIANCE)))
    scaled = settled(scaled, "centres")
    # starts: distances by the median absolute deviations, by bounded scores, by directions
    z = [(F.col(f) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, f in enumerate(FEATURES)]
    norm = F.sqrt(sum((x * x for x in z), F.lit(1e-9)))
    joined = vectors.join(scaled, "cell")
    scores = joined.select("cell", F.explode(F.array(*(F.struct(F.lit(s).alias("start"), *(
        v.alias(f"y_{i}") for i, v in enumerate(values))) for s, values in enumerate(
            (z, [F.tanh(x) for x in z], [x / norm for x in z]))))).alias("y")).select("cell", "y.*")
    shape = _sums(scores.groupBy("cell", "start"), [F.col(f"y_{i}") for i in range(d)]).join(scaled, "cell")

    def scatter(i: int, j: int) -> Column:
        if i == j:
            return F.col(f"s_{i}") ** 2
        both = _covariance(i, i) * _covariance(j, j)
        corr = F.when((F.col("start") > 0) & (both > 1e-12), _covariance(i, j) / F.sqrt(both)).otherwise(0.0)
        return 0.95 * corr * F.col(f"s_{i}") * F.col(f"s_{j}")

    shape = shape.select("cell", "start", *(f"m_{i}" for i in range(d)), *(scatter(i, j).alias(f"c_{i}_{j}") for i, j in _pairs(d)))
    current = settled(_with_precision(shape, d), "starts")
    for _ in range(rules.steps):  # concentration: nearest texts, their moments about the last centre, again
        near = vectors.join(current, "cell").select("cell", "start", *(
            (x - F.col(f"m_{i}")).alias(f"z_{i}") for i, x in enumerate(xs)), _distance(d).alias("d2"))
        limits = near.groupBy("cell", "start").agg(F.percentile_approx("d2", rules.core, 1000).alias("limit"))
        core = near.join(limits, ["cell", "start"]).filter("d2 <= limit")
        moved = _sums(core.groupBy("cell", "start"), [F.col(f"z_{i}") for i in range(d)]).join(
            current.select("cell", "start", *(f"m_{i}" for i in range(d))), ["cell", "start"])
        moved = moved.select("cell", "start", *((F.col(f"m_{i}") + F.col(f"a_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)), *(
            (_covariance(i, j) + F.lit(LEAST_VARIANCE[i] if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _pairs(d)))
        current = settled(_with_precision(moved, d), "steps")
    best = current.groupBy("cell").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    best = current.join(best, ["cell", "start"]).drop("start", "logdet")
    # the median distance of a normal sample in d dimensions is about d (1 - 2 / 9d) ** 3
    scale = vectors.join(best, "cell").groupBy("cell").agg(
        (F.percentile_approx(_distance(d), 0.5, 1000) / (d * (1 - 2 / (9 * d)) ** 3)).alias("scale"))
    return settled(best.join(scale, "cell").withColumn("scale", F.greatest("scale", F.lit(0.05))), "estimates")


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, source (and a row key where there is one), the statistics, base_failed, distance (squared, scaled; null without) and kept."""
    own = [c for c in ("doc_id", "lang", "source", "__k1", "__k2") if c in docs.columns]
    stats = with_statistics(docs.select(*own, "text")).drop("text").withColumns(features())
    stats = settled(stats.withColumn("base_failed", base_failed(rules)), "statistics")
    passed = stats.filter("NOT base_failed")
    placed = settled(_cells(passed, rules), "cells")

    def with_cell(df: DataFrame) -> DataFrame:
        df = df.alias("d").join(placed.alias("g"), F.expr("d.lang <=> g.g_lang AND d.source <=> g.g_source"), "left")
        key = F.to_json(F.struct(F.col("level").alias("v"), F.when(F.col("level") < 2, F.col("d.lang")).alias("l"),
                                 F.when(F.col("level") == 0, F.col("d.source")).alias("s")))
        return df.select("d.*", F.when(F.col("level").isNotNull(), key).alias("cell"))

    found = estimates(with_cell(passed).select("cell", *FEATURES), rules)
    judged = with_cell(stats).join(found, "cell", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance(len(FEATURES)) / F.col("scale")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= rules.cutoff)
    return judged.withColumn("kept", kept).select(*stats.columns, "distance", "kept")


def keep_ordinary(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are no outliers, all columns unchanged."""
    k1, k2 = row_key("doc_id", "text", "lang", "source")
    rejected = verdicts(docs.select("doc_id", "text", "lang", "source", k1.alias("__k1"), k2.alias("__k2")), rules).filter("NOT kept")
    return without_rows(docs, rejected, ("doc_id", "text", "lang", "source"))
