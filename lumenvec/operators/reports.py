"""Reports over token and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.functions.vectors import cosine, max_abs_diff
from lumenvec.operators.frequent import COUNTERS, most_frequent
from lumenvec.operators.subword import segment_table
from lumenvec.operators.tokens import explode_tokens, kept_name, lookup_ids, raw_tokens
from lumenvec.plans.strategy import materialize
from lumenvec.profiles import Profile
from lumenvec.sources.vocab import Vocabulary

# The frame markers of both profiles (never produced by the
# tokenisers themselves: words are lowercased, pre-tokens split "<").
MARKERS = ("[CLS]", "[SEP]", "<s>", "</s>")
# The size of a KLL sketch: about 1 % in rank, and exact for fewer values.
SKETCH_K = 400


def token_counts(texts: DataFrame, vocab: Vocabulary, profile: Profile, by: list[str], text_col: str = "text") -> DataFrame:
    """(*by, token, n, in_vocab, stands_for): how often each group has each token.

    Raw tokens are counted by group first, so what is looked up, and in the
    subword profile cut into pieces, is one row for each group and token and
    not one for each occurrence. Frame markers are not counted."""
    inner = [f"_by_{i}" for i in range(len(by))]
    lean = texts.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(by, inner)])
    raw = explode_tokens(raw_tokens(lean, profile, keep=inner), keep=inner)
    counts = raw.groupBy(*inner, "token").agg(F.count(F.lit(1)).alias("n"))
    stands_for = F.lit(None).cast("string")
    if profile.tokens != "words":
        counts = materialize(counts, "pre-token-counts")
        cut = segment_table(counts.select("token").distinct(), vocab, profile).withColumnRenamed("token", "_t")
        cut = materialize(cut, "segments")
        j = counts.join(cut, F.col("token") == F.col("_t")).select(*inner, "n", F.explode(F.arrays_zip("pieces", "sources")).alias("x"))
        counts = j.groupBy(*inner, F.col("x.pieces").alias("token"), F.col("x.sources").alias("stands_for")).agg(F.sum("n").alias("n"))
        stands_for = F.col("stands_for")
    counts = counts.select(*inner, "token", "n", stands_for.alias("stands_for"))
    found = lookup_ids(counts, vocab, profile, stands_for="stands_for")
    return found.select(*[F.col(n).alias(kept_name(c)) for c, n in zip(by, inner)], "token", "n", "in_vocab", "stands_for")


def vocabulary_report(texts: DataFrame, vocab: Vocabulary, profile: Profile, by: list[str], text_col: str = "text") -> DataFrame:
    """(*by, n_docs, n_tokens, n_unknown, unknown_rate) for each group of texts.

    A group column that is null is a group; texts without tokens count as
    texts; a group without tokens has no rate; an empty table has no groups. A
    group column named like one of the report's own comes as ``keep_<name>``."""
    names = [kept_name(c) for c in by]
    counts = token_counts(texts, vocab, profile, by, text_col)
    zero = F.lit(0).cast("bigint")
    unknown = F.when(F.col("in_vocab"), zero).otherwise(F.col("n"))
    tokens = counts.select(*names, zero.alias("n_docs"), F.col("n").alias("n_tokens"), unknown.alias("n_unknown"))
    docs = texts.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.lit(1).cast("bigint").alias("n_docs"), zero.alias("n_tokens"), zero.alias("n_unknown"))
    g = docs.unionByName(tokens).groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_unknown")])
    return _with_rate(g)


def top_unknown(texts: DataFrame, vocab: Vocabulary, profile: Profile, by: list[str], n: int = 5, text_col: str = "text") -> DataFrame:
    """(*by, rank, token, n): the ``n`` most frequent unknown tokens of each group
    (count desc, token asc); an unknown piece is named by the character it stands for."""
    names = [kept_name(c) for c in by]
    counts = token_counts(texts, vocab, profile, by, text_col).where(~F.col("in_vocab"))
    c = counts.groupBy(*names, F.coalesce("stands_for", "token").alias("token")).agg(F.sum("n").alias("n"))
    return _ranked(c, names, n)


def top_unknown_summarised(
    texts: DataFrame, vocab: Vocabulary, profile: Profile, by: list[str], n: int = 5, text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The rows of ``top_unknown`` where distinct unknown tokens are too many to shuffle.

    Words: unknown ones are told row by row, summarised in each task, and only
    those that can be among the first are counted. In the subword profile what
    unknown pieces stand for are single characters, so they are counted as there."""
    if profile.tokens != "words":
        return top_unknown(texts, vocab, profile, by, n, text_col)
    inner = [f"_by_{i}" for i in range(len(by))]
    lean = texts.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(c2) for c, c2 in zip(by, inner)])
    words = explode_tokens(raw_tokens(lean, profile, keep=inner), keep=inner).select(*inner, "token")
    unknown = lookup_ids(words, vocab, profile).where(~F.col("in_vocab")).select(*inner, "token")
    top = most_frequent(unknown, inner, "token", n, counters)
    return top.withColumnsRenamed({i: kept_name(c) for i, c in zip(inner, by)})


def _with_rate(g: DataFrame) -> DataFrame:
    rate = F.when(F.col("n_tokens") > 0, F.col("n_unknown") / F.col("n_tokens"))
    return g.withColumn("unknown_rate", F.round(rate, 6))


def _ranked(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("token"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)  # WindowGroupLimit
    return top.select(*by, F.col("rank").cast("bigint").alias("rank"), "token", "n")


def unknown_token_report(ids: DataFrame, by: list[str]) -> DataFrame:
    """O19 over long-form ids that are there already (``token_ids(..., keep=by)``, ``by`` by
    its ``kept_name``): the figures of ``vocabulary_report``.

    Every text has a first marker, at ``pos`` 0; markers are not counted as
    tokens. One partial aggregate, no join."""
    word = ~F.col("token").isin(*MARKERS)
    g = ids.groupBy(*by).agg(
        F.sum((F.col("pos") == 0).cast("bigint")).alias("n_docs"),
        F.sum(word.cast("bigint")).alias("n_tokens"),
        F.sum((word & ~F.col("in_vocab")).cast("bigint")).alias("n_unknown"),
    )
    return _with_rate(g)


def top_unknown_tokens(ids: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """O19 over long-form ids that are there already: the rows of ``top_unknown``."""
    name = F.coalesce("stands_for", "token") if "stands_for" in ids.columns else F.col("token")
    unk = ids.where(~F.col("in_vocab") & ~F.col("token").isin(*MARKERS))
    return _ranked(unk.groupBy(*by, name.alias("token")).agg(F.count(F.lit(1)).alias("n")), by, n)


def latency_report(
    results: DataFrame, runtime_col: str = "runtime", order_col: str = "call_time", call_col: str = "call_id", sketch: bool = False
) -> DataFrame:
    """O20 over result rows of the embedding jobs with a column for the runtime: per
    runtime rows and calls, the first call by time against the mean of the later
    rows, mean, median and 95th percentile, set-up time and rows per second of
    inference time. Rows without ``inference_time`` (errors) are left out; a
    null runtime is a runtime; no such row gives an empty report.

    One pass: counts, sums, the earliest row and the quantiles combine before
    the shuffle. The quantiles are exact, in memory that grows with the
    different times, or with ``sketch`` from a KLL sketch of fixed size."""
    r = results.where(F.col("inference_time").isNotNull())
    t = F.col("inference_time").cast("double")
    first = F.min(F.struct(order_col, call_col, t.alias("t")))
    if sketch:
        quantiles = [F.kll_sketch_agg_double(t, F.lit(SKETCH_K)).alias("sketch")]
    else:
        quantiles = [F.percentile(t, F.lit(p)).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))]
    g = r.groupBy(runtime_col).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(call_col).alias("calls"), F.sum(t).alias("total"),
        F.sum("setup_time").alias("setup_time"), first.alias("f"), *quantiles,
    )
    if sketch:
        g = g.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for name, p in (("p50", 0.5), ("p95", 0.95))})
    later = F.when(F.col("rows") > 1, (F.col("total") - F.col("f.t")) / (F.col("rows") - 1))
    return g.select(
        runtime_col,
        "rows",
        "calls",
        F.col("f.t").alias("first_call"),
        F.round(later, 6).alias("later_mean"),
        F.round(F.col("total") / F.col("rows"), 6).alias("mean"),
        "p50",
        F.round("p95", 6).alias("p95"),
        "setup_time",
        F.round(F.when(F.col("total") > 0, F.col("rows") / F.col("total")), 6).alias("rows_per_sec"),
    )


def parity(
    left: DataFrame, right: DataFrame, key: str = "doc_id", vec: str = "embedding", tol: float = 1e-5
) -> DataFrame:
    """O21 per row: full outer join of two runtimes' embeddings.

    (key, status, cosine, max_abs_diff, within_tol). ``status`` is left_only or
    right_only where the other side has no row with that key; of keys on both
    sides it is both, left_failed, right_failed or both_failed by which vectors
    are null. A null key meets a null key; keys that repeat meet each other
    in every pairing; vectors of different lengths are not within tolerance and
    have neither cosine nor difference."""
    a = left.select(F.col(key).alias("_ka"), F.col(vec).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(F.col(key).alias("_kb"), F.col(vec).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer")
    status = (
        F.when(F.col("_in_b").isNull(), "left_only")
        .when(F.col("_in_a").isNull(), "right_only")
        .when(F.col("_a").isNull() & F.col("_b").isNull(), "both_failed")
        .when(F.col("_a").isNull(), "left_failed")
        .when(F.col("_b").isNull(), "right_failed")
        .otherwise("both")
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = both & (F.size("_a") == F.size("_b"))
    mad = F.when(same, max_abs_diff("_a", "_b"))
    return j.select(
        F.coalesce("_ka", "_kb").alias(key),
        status.alias("status"),
        F.round(F.when(same, cosine("_a", "_b")), 6).alias("cosine"),
        F.round(mad, 6).alias("max_abs_diff"),
        F.when(both, F.coalesce(mad <= tol, F.lit(False))).alias("within_tol"),
    )


def parity_summary(rows: DataFrame) -> DataFrame:
    """O21 summary: counts per side, cosine range, worst difference, share within tolerance."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0).cast("bigint"))
    return rows.agg(
        *[count(s).alias(f"n_{s}") for s in ("both", "left_only", "right_only", "left_failed", "right_failed", "both_failed")],
        F.min("cosine").alias("min_cosine"),
        F.max("max_abs_diff").alias("max_abs_diff"),
        F.round(F.avg(F.col("within_tol").cast("double")), 6).alias("share_within_tol"),
    )
