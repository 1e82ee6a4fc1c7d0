"""Count matrices in long form (id, sample, n): totals, shares, selections, groups, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: 97.5 % point of the normal distribution.


def sample_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample").agg(F.sum("n").cast("long").alias("total"))


def lookup_totals(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts beside the total of their sample; a sample without one gets null. Totals have a row for each sample."""
    return counts.join(totals, "sample", "left")


def tpm(counts: DataFrame) -> DataFrame:
    return lookup_totals(counts, sample_totals(counts)).select("id", "sample", "n", (F.col("n") * 1e6 / F.col("total")).alias("tpm"))


def filter_any_sample_over(counts: DataFrame, t: int) -> DataFrame:
    """All rows of ids that exceed ``t`` in any sample."""
    own = counts.groupBy("id").agg(F.max("n").alias("_m")).filter(F.col("_m") > t)
    return counts.join(own, "id", "left_semi")


def filter_row_total(counts: DataFrame, mean: float, least: int) -> DataFrame:
    """All rows of ids whose sum is above ``mean`` times the number of samples, and at least ``least``."""
    n = counts.select("sample").distinct().agg(F.count("*").alias("_samples"))  # one row
    own = counts.groupBy("id").agg(F.sum("n").alias("_s")).join(F.broadcast(n)).filter((F.col("_s") > mean * F.col("_samples")) & (F.col("_s") >= least))
    return counts.join(own, "id", "left_semi")


def top_ids(counts: DataFrame, n: int) -> DataFrame:
    """All rows of the ``n`` ids with the largest sums; ties go to the smaller id."""
    own = counts.groupBy("id").agg(F.sum("n").alias("_s")).orderBy(F.desc("_s"), "id").limit(n)
    return counts.join(own, "id", "left_semi")


def widen(counts: DataFrame, samples: list[str]) -> DataFrame:
    """A row for each id, a column for each named sample, 0 where there is none."""
    return counts.groupBy("id").pivot("sample", samples).agg(F.sum("n")).fillna(0, samples)


def melt(wide: DataFrame, samples: list[str]) -> DataFrame:
    return wide.unpivot("id", samples, "sample", "n")


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_outer(frames: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Full outer merge on keys by one shuffle: a column for each frame, its largest value for the key, 0 where it has none."""
    tagged = stack_frames([f.select(*keys, F.col(value).alias("_v"), F.lit(k).alias("_k")) for k, f in frames.items()])
    return tagged.groupBy(*keys).pivot("_k", list(frames)).agg(F.max("_v")).fillna(0, list(frames))


def ids_like(ids: DataFrame, pattern: str) -> DataFrame:
    return ids.filter(F.col("id").rlike(pattern)).select("id").distinct()


def select_or(ids: DataFrame, patterns: list[str]) -> DataFrame:
    """Ids that match any pattern."""
    return ids_like(ids, "|".join(f"(?:{p})" for p in patterns))


def select_and(ids: DataFrame, patterns: list[str]) -> DataFrame:
    """Ids that match all patterns."""
    out = ids
    for p in patterns:
        out = out.filter(F.col("id").rlike(p))
    return out.select("id").distinct()


def select_and_not(ids: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """Ids that match the first pattern and none of the rest."""
    out = ids_like(ids, first)
    for p in rest:
        out = out.filter(~F.col("id").rlike(p))
    return out


def junctions(key: Column) -> Column:
    """Number of junctions of a key: its commas."""
    return F.size(F.split(key, ",")) - 1


def term(key: Column, kind: Column, word: str) -> Column:
    """Whether a row is selected by one term: all, an end type, non5 or non3 (no such end), juncts=n, juncts<n, juncts>n, or a
    pattern on the key."""
    if word == "all":
        return F.lit(True)
    if word in ("non5", "non3"):
        return kind.startswith("no5") if word == "non5" else kind.endswith("no3")
    if word in ("5_3", "5_no3", "no5_3", "no5_no3"):
        return kind == word
    if word.startswith("juncts"):
        n, against = junctions(key), int(word[7:])
        return {"=": n == against, "<": n < against, ">": n > against}[word[6]]
    return key.rlike(word)


def group_by_regex(counts: DataFrame, pattern: str) -> DataFrame:
    """Sums by sample of ids that match a pattern and of those that don't (``! pattern``)."""
    label = F.when(F.col("id").rlike(pattern), F.lit(pattern)).otherwise(F.lit(f"! {pattern}"))
    return counts.groupBy(label.alias("grp"), "sample").agg(F.sum("n").cast("long").alias("n"))


def merge_by_patterns(counts: DataFrame, patterns: list[str], most: int) -> DataFrame:
    """Sums by sample of the first pattern that matches an id; of the other ids the ``most`` largest stay single."""
    label = F.coalesce(*[F.when(F.col("id").rlike(p), F.lit(p)) for p in patterns])
    labelled = counts.withColumn("grp", label)
    merged = labelled.filter("grp IS NOT NULL").groupBy("grp", "sample").agg(F.sum("n").cast("long").alias("n"))
    single = top_ids(labelled.filter("grp IS NULL"), most).select(F.col("id").alias("grp"), "sample", F.col("n").cast("long").alias("n"))
    return merged.unionByName(single)


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios to the geometric mean by sample, over ids that every sample has."""
    w = W.partitionBy("id")
    n = counts.select("sample").distinct().agg(F.count("*").alias("_samples"))
    logs = counts.filter("n > 0").select("id", "sample", F.ln("n").alias("l"), F.count("*").over(w).alias("_k"), F.avg(F.ln("n")).over(w).alias("m"))
    whole = logs.join(F.broadcast(n)).filter(F.col("_k") == F.col("_samples"))
    return whole.groupBy("sample").agg(F.exp(F.median(F.col("l") - F.col("m"))).alias("factor"))


def size_factor_normalise(counts: DataFrame) -> DataFrame:
    return counts.join(size_factors(counts), "sample", "left").select("id", "sample", (F.col("n") / F.col("factor")).alias("norm"))


def group_zero_counts(counts: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """By id: mean and zeros in two groups of samples, and the difference of means. Missing cells are zeros."""
    out = counts.groupBy("id")
    aggs = []
    for name, own in (("a", a), ("b", b)):
        inside = F.col("sample").isin(*own)
        aggs.append((F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)) / len(own)).alias(f"mean_{name}"))
        aggs.append((F.lit(len(own)) - F.count_if(inside & (F.col("n") > 0))).alias(f"zeros_{name}"))
    return out.agg(*aggs).withColumn("difference", F.col("mean_b") - F.col("mean_a"))


def with_padj(results: DataFrame, p: str = "p") -> DataFrame:
    """Results of a comparison (id, p and whatever else) with their adjusted p, for inputs that bring p alone."""
    from .depth import bh_adjust

    return results.join(bh_adjust(results.select("id", p), p, "id").select("id", "padj"), "id", "left")


def classify(results: DataFrame, most: float = 0.05, least: float = 1.0, by: str = "padj", spurious: str | None = None, exclude: str | None = None) -> DataFrame:
    """Results of a comparison (id, log2fc and p or padj as they came) with ``class``: up, down or none.

    A row is up or down if ``by`` is at most ``most`` and log2fc reaches ``least`` in size; a null in either gives none. Rows
    for which the condition ``spurious`` holds are of that class, and those for which ``exclude`` holds are left out.
    """
    out = results if exclude is None else results.filter(~F.coalesce(F.expr(exclude), F.lit(False)))
    sure = F.coalesce((F.col(by) <= most) & (F.abs("log2fc") >= least), F.lit(False))
    found = F.when(F.coalesce(F.expr(spurious), F.lit(False)), "spurious") if spurious else F.when(F.lit(False), "")
    return out.withColumn("class", found.when(sure & (F.col("log2fc") > 0), "up").when(sure, "down").otherwise("none"))


def reversed_flags(groups: DataFrame) -> DataFrame:
    """Rows of `group_zero_counts` with ``log2fc`` (may bring its own), ``spurious`` (a zero in each group) and ``reversed`` (the
    difference of means goes against the fold change)."""
    both = (F.col("zeros_a") > 0) & (F.col("zeros_b") > 0)
    return groups.withColumn("spurious", both).withColumn("reversed", F.coalesce(F.signum("difference") * F.signum("log2fc") < 0, F.lit(False)))


def log_ratio(share: Column) -> Column:
    """-log2 of a share; null for 0."""
    return F.when(share > 0, -F.log2(share))


def comparison_pairs(samples: DataFrame, base: str) -> DataFrame:
    """The base sample against each other one."""
    return samples.select("sample").distinct().filter(F.col("sample") != base).select(F.lit(base).alias("base"), F.col("sample").alias("other"))


def paired_abundance(counts: DataFrame, x: str, y: str, pseudo: float, least: int, most: int) -> DataFrame:
    """id with counts in two samples plus a pseudo-count, of the ``most`` largest totals that reach ``least``."""
    both = widen(counts.filter(F.col("sample").isin(x, y)), [x, y])
    total = F.col(x) + F.col(y)
    kept = both.withColumn("_t", total).filter(F.col("_t") >= least).orderBy(F.desc("_t"), "id").limit(most)
    return kept.select("id", (F.col(x) + pseudo).alias("x"), (F.col(y) + pseudo).alias("y"))


def expand_sample_name(sample: Column) -> dict[str, Column]:
    """Parts of molecule_cell_time, and their combined factors."""
    part = F.split(sample, "_")
    one = {k: F.get(part, i) for i, k in enumerate(("molecule", "cell", "time"))}
    one["hours"] = F.regexp_extract(one["time"], r"[0-9]+", 0).try_cast("int")
    return one | {"molecule_cell": F.concat_ws("_", one["molecule"], one["cell"]), "cell_time": F.concat_ws("_", one["cell"], one["time"])}


def sample_rank(name: Column, sample: Column, by: str = "time", reverse: bool = False) -> Column:
    """Place of a sample (from 1) by the parts of its name molecule_cell_time: by time (a number), cell or molecule first, the
    other parts and the sample behind it; over a row for each sample."""
    part = expand_sample_name(name)
    order = {"time": ("hours", "cell", "molecule"), "cell": ("cell", "hours", "molecule"), "molecule": ("molecule", "cell", "hours")}[by]
    keys = [*[part[k] for k in order], sample]
    return F.row_number().over(W.orderBy(*[k.desc_nulls_last() if reverse else k.asc_nulls_last() for k in keys]))


def decoded(sample: Column, alias: Column) -> Column:
    """The alias of a sample; else its own name, or a standard one where it has fewer than three parts."""
    return F.coalesce(alias, F.when(F.size(F.split(sample, "_")) < 3, F.concat(F.lit("cDNA_"), sample, F.lit("_24hpi"))).otherwise(sample))


def rename_ids(key: Column, patterns: dict[str, str]) -> Column:
    """Patterns replaced in turn, then repeated tokens removed inside each part of the key."""
    for p, r in patterns.items():
        key = F.regexp_replace(key, p, r)
    return F.array_join(F.transform(F.split(key, ","), lambda x: F.array_join(F.array_distinct(F.split(x, "_")), "_")), ",")


def frequency_table(rows: DataFrame, c: str, order: list[str] | None = None) -> DataFrame:
    """Counts of values; with an order, of the named ones only, 0 for those that don't occur."""
    found = rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    if order is None:
        return found
    named = rows.sparkSession.createDataFrame([(v,) for v in order], "value string")
    return named.join(found, "value", "left").fillna(0, ["n"])
