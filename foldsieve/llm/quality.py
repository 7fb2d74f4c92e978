"""Quality rules: minimum-covariance-determinant outliers per language and source, in SQL functions only.

Each text gives a vector of transformed statistics: mean word length, symbols
per word, repeated lines, repeated word windows. Documents of one language and
source share a robust centre and scatter: the mean and covariance of the share
COVERED of them that lie closest, found by concentration steps (Rousseeuw and
Van Driessen 1999) from two deterministic starts (as Hubert, Rousseeuw and
Verdonck 2012: no random subsets, so reruns agree); the start whose covariance
has the smaller determinant counts.

Estimates are made for a tree of groups at once: all documents, those of a
language, those of a language and source. A group of n documents counts its own
moments n times and its parent's PRIOR times, at every size alike, so a source
of a few documents is judged nearly as its language, and one of thousands by
itself. Distances are scaled down where their median exceeds that of the
chi-squared law (the covered share's covariance is too small by nature); the
logarithm of that scale is shrunk in the same way. A document whose squared
Mahalanobis distance exceeds CUT, the 0.999 quantile of that law, is rejected.

Most texts have no symbols and no repeated lines at all, so every feature has a
floor to its scatter: the smallest standard deviation that says something about
quality. With these floors one feature alone rejects a text of about 30 % longer
or shorter words, of a symbol in each sixth word, and of repeated lines or
windows that make up more than a quarter of it.

Every step is one grouped sum over narrow rows: counts and moments by fine bins
of the distance, whose running sums give the covered set (whole bins, so at
least the share asked for) and its moments. The rows of a group are summed where
they lie, so no group is gathered or sorted in one task.

Defined cases: a null text has no words and fails the base rule; null language
or source is a group of its own; repeated rows are judged alike; a vocabulary of
statistics without spread gets the floor scatter; a group of one document is
judged by its language; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsieve.llm.common import WORD, bounded, n_words
from foldsieve.session import work_table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COVERED = 0.75
STEPS = 3
#: Documents that a parent's estimate counts for in a group's.
PRIOR = 100.0
#: Bins per unit of the logarithm of a squared distance, and per unit of a statistic.
DISTANCE_BINS, VALUE_BINS = 32, 512
#: Median and 0.999 quantile of the chi-squared law with 4 degrees of freedom.
CHI_MEDIAN, CUT = 3.3567, 18.4668
FEATURES = ("x_length", "x_symbols", "x_lines", "x_windows")
#: Smallest standard deviation of each feature: differences below it say nothing about quality.
FLOORS = (0.04, 0.04, 0.12, 0.12)
P = range(len(FEATURES))
LOWER = [(j, k) for j in P for k in range(j + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """Words that 3-word windows at the sorted positions cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        positions,
        start,
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n")),
        lambda s: s["n"],
    )


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, by 64-bit hashes of the windows."""

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def few(h: Column, doubled: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(doubled, x), i)), lambda i: i.isNotNull())

    def many(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                near = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
                return F.when(near, x["i"])

            return F.sort_array(F.filter(F.transform(s, same), lambda i: i.isNotNull()))

        return let(placed, marked)

    def doubled(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x))

    def count(h: Column) -> Column:
        found = let(F.sort_array(h), doubled)
        positions = let(found, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= 256, few(h, d)).otherwise(many(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(positions))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count)))


def base_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, source and the five base statistics, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    out = docs.select(
        key,
        "lang",
        "source",
        n_words(F.col("text")).alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(words).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("n_breaks"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _vector(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
            "x_symbols": F.log1p(F.col("n_symbols") / words),
            "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_breaks") + 1)),
            "x_windows": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _nodes() -> Column:
    """The row's groups: all documents, its language, its language and source, each with its parent."""
    lang, source = (F.coalesce(F.col(c), F.lit("\0")) for c in ("lang", "source"))
    by_lang, own = F.concat(F.lit("l"), lang), F.concat_ws("\x01", F.concat(F.lit("s"), lang), source)
    chain = [F.lit("a"), by_lang, own]
    return F.array(*[F.struct(F.lit(i).alias("level"), chain[i].alias("node"), chain[max(i - 1, 0)].alias("parent")) for i in range(3)])


def _own_node() -> Column:
    return F.get(_nodes(), 2)["node"]


def _upto(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """counts (by, bin, n, ...) up to the first bin at which the running count reaches the share. Groups have a bounded number of bins."""
    earlier = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(*by))
    marked = counts.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)) < total * share)
    return marked.where("inside").drop("inside")


def _centres(rows: DataFrame) -> DataFrame:
    """node, and the median m and scaled median deviation s of every feature."""
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(x).alias("x")) for j, x in enumerate(FEATURES)])
    long = rows.select("node", F.explode(pairs).alias("p")).select("node", "p.j", "p.x")

    def median(frame: DataFrame, value: Column, name: str) -> DataFrame:
        bins = frame.select("node", "j", F.floor(value * VALUE_BINS).alias("bin")).groupBy("node", "j", "bin").agg(F.count("*").alias("n"))
        found = _upto(bins, ["node", "j"], 0.5).groupBy("node", "j").agg(((F.max("bin") + 0.5) / VALUE_BINS).alias(name))
        return work_table(found, f"mcd-{name}")

    middle = median(long, F.col("x"), "middle")
    spread = median(long.join(bounded(middle), ["node", "j"]), F.abs(F.col("x") - F.col("middle")), "spread")
    columns = []
    for j, floor in enumerate(FLOORS):
        columns.append(F.max(F.when(F.col("j") == j, F.col("middle"))).alias(f"m{j}"))
        columns.append(F.greatest(F.max(F.when(F.col("j") == j, F.col("spread"))) * 1.4826, F.lit(floor)).alias(f"s{j}"))
    return middle.join(spread, ["node", "j"]).groupBy("node").agg(*columns)


def _binned(rows: DataFrame) -> DataFrame:
    """rows (level, node, parent, start, features, m, bin) -> per bin the count and the sums of deviations from m and of their products."""
    off = [F.col(x) - F.col(f"m{j}") for j, x in enumerate(FEATURES)]
    sums = [F.sum(off[j]).alias(f"t{j}") for j in P] + [F.sum(off[j] * off[k]).alias(f"q{j}{k}") for j, k in LOWER]
    return rows.groupBy("level", "node", "parent", "start", "bin").agg(F.count("*").alias("n"), *sums, *[F.min(f"m{j}").alias(f"m{j}") for j in P])


def _moments(binned: DataFrame) -> DataFrame:
    """level, node, parent, start, n (of the covered rows), rows (all), their mean m and covariance v."""
    by = ["level", "node", "parent", "start"]
    everything = binned.groupBy(*by).agg(F.sum("n").alias("rows"))
    names = [f"t{j}" for j in P] + [f"q{j}{k}" for j, k in LOWER]
    sums = _upto(binned, by, COVERED).groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names], *[F.min(f"m{j}").alias(f"c{j}") for j in P])
    mean = {j: F.col(f"t{j}") / F.col("n") for j in P}
    cov = [(F.col(f"q{j}{k}") / F.col("n") - mean[j] * mean[k]).alias(f"v{j}{k}") for j, k in LOWER]
    return sums.join(everything, by).select(*by, "n", "rows", *[(F.col(f"c{j}") + mean[j]).alias(f"m{j}") for j in P], *cov)


def _shrunk(own: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """own (level, node, parent, rows, names): from the root down, each value drawn to the parent's as if that had PRIOR rows."""
    out = now = own.where("level = 0")
    for level in (1, 2):
        above = now.select(F.col("node").alias("__up"), *[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in names])
        mine = own.where(F.col("level") == level)
        same = F.col("parent") == F.col("__up")
        for k in keys:
            same &= F.col(k) == F.col(f"__{k}")
        value = {c: (F.col("rows") * F.col(c) + F.lit(PRIOR) * F.col(f"__{c}")) / (F.col("rows") + F.lit(PRIOR)) for c in names}
        now = mine.join(above, same).select(*[value[c].alias(c) if c in value else c for c in own.columns])
        out = out.unionByName(now)
    return out


def _factors(moments: DataFrame) -> DataFrame:
    """With the Cholesky factor l of the covariance v (floors added), a column after the other, and log_det."""
    out = moments
    for j, k in LOWER:
        rest = F.col(f"v{j}{k}") + F.lit(FLOORS[j] ** 2 if j == k else 0.0)
        for i in range(k):
            rest = rest - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
        out = out.withColumn(f"l{j}{k}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if j == k else rest / F.col(f"l{k}{k}"))
    log_det = F.lit(0.0)
    for j in P:
        log_det = log_det + 2 * F.log(F.col(f"l{j}{j}"))
    return out.withColumn("log_det", log_det)


def _distance() -> Column:
    """Squared distance of a row's features to mean m under factor l, by forward substitution."""
    solved: list[Column] = []
    total = F.lit(0.0)
    for j, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * solved[k]
        solved.append(rest / F.col(f"l{j}{j}"))
        total = total + solved[j] * solved[j]
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-9) * DISTANCE_BINS).cast("int")


def estimates(rows: DataFrame) -> DataFrame:
    """One row per node of rows (lang, source, features): level, node, rows, mean m, factor l, log_det, log_scale of the squared distance."""
    spread = rows.select(F.explode(_nodes()).alias("g"), *FEATURES).select("g.level", "g.node", "g.parent", *FEATURES)
    centres = work_table(_centres(spread), "mcd-centres")
    scaled = [F.abs(F.col(x) - F.col(f"m{j}")) / F.col(f"s{j}") for j, x in enumerate(FEATURES)]
    sum_of_squares, largest = F.lit(0.0), F.greatest(*scaled)
    for s in scaled:
        sum_of_squares = sum_of_squares + s * s
    starts = F.array(F.struct(F.lit(0).alias("start"), sum_of_squares.alias("d")), F.struct(F.lit(1).alias("start"), (largest * largest).alias("d")))
    now = spread.join(bounded(centres), "node").withColumn("s", F.explode(starts)).withColumns({"start": F.col("s.start"), "bin": _bin(F.col("s.d"))})
    names = [f"m{j}" for j in P] + [f"v{j}{k}" for j, k in LOWER]
    factor = [f"l{j}{k}" for j, k in LOWER]
    for step in range(STEPS):
        # tables of a row per node and start
        own = work_table(_moments(_binned(now)), f"mcd-moments{step}")
        params = work_table(_factors(_shrunk(own, names, ["start"])).select("level", "node", "parent", "start", "rows", "log_det", *[f"m{j}" for j in P], *factor), f"mcd-step{step}")
        now = spread.join(bounded(params).drop("level", "parent", "rows", "log_det"), "node").withColumn("bin", _bin(_distance()))
    best = params.groupBy("node").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    params = work_table(params.join(best, ["node", "start"]), "mcd-best")
    now = spread.join(bounded(params).select("node", *[f"m{j}" for j in P], *factor), "node").withColumn("bin", _bin(_distance()))
    middle = _upto(now.groupBy("node", "bin").agg(F.count("*").alias("n")), ["node"], 0.5).groupBy("node").agg(F.max("bin").alias("middle"))
    # half a bin beyond the median's lower edge
    scale = ((F.col("middle") + 0.5) / DISTANCE_BINS - F.log(F.lit(CHI_MEDIAN))).alias("log_scale")
    own = work_table(params.join(middle, "node").select(*params.columns, scale), "mcd-scales")
    return _shrunk(own, ["log_scale"], []).select("level", "node", "rows", *[f"m{j}" for j in P], *factor, "log_det", "log_scale")


def judged(stats: DataFrame) -> DataFrame:
    """Base statistics with distance (scaled, squared; null in a group all of which fails the base rule) and kept."""
    rows = work_table(_vector(stats), "quality")
    found = work_table(estimates(rows.where(~F.col("base_failed"))).where("level = 2").drop("level", "rows", "log_det"), "mcd-estimates")
    distance = _distance() / F.exp(F.greatest(F.col("log_scale"), F.lit(0.0)))
    out = rows.join(bounded(found), _own_node() == F.col("node"), "left").withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def quality_verdicts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, the base statistics, base_failed, kept, distance."""
    out = judged(base_statistics(docs, key))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs' rows that are kept, columns as in docs. A verdict depends on language, source and text only; texts are known by 128 bits."""
    keys = ["lang", "source", "content"]
    content = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    verdicts = judged(base_statistics(docs.withColumn("__content", content), "__content").withColumnRenamed("__content", "content"))
    good = work_table(verdicts.where("kept").select(*keys).distinct(), "good")
    rows = docs.withColumn("__content", content)
    same = (rows["__content"] == good["content"]) & rows["lang"].eqNullSafe(good["lang"]) & rows["source"].eqNullSafe(good["source"])
    return rows.join(good, same, "left_semi").select(*docs.columns)
