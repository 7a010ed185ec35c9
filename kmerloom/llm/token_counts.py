"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .common import documents, prepare, written


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and docs: how many documents have each encoded length. Null texts have length 0."""
    return count_tokens(docs, path).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def answers(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length that occurs, taken as a context limit, what suffix sums answer.

    context_limit, docs (of that very length), docs_over (longer ones), docs_in (as long or shorter),
    total_tokens (of all documents), tokens_kept (if each is cut at the limit), tokens_lost, share_docs_in (the
    quantile whose value the limit is). Between two lengths that occur, tokens_kept is linear in the limit with slope
    docs_over, so the rows answer every limit. The sums run inside blocks of ``block`` lengths and
    then over the blocks, so no task sees more than one block or one row for each block.
    No rows give no rows.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("b", F.expr(f"n_tokens div {block}"))
    inside = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_block = h.groupBy("b").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    per_block = per_block.select("b", *[F.coalesce(F.sum(x).over(over), F.lit(0)).alias(f"{x}_after") for x in "dt"], *[F.sum(x).over(whole).alias(f"{x}_all") for x in "dt"])
    zero = F.lit(0)
    return (
        h.withColumn("docs_over", F.coalesce(F.sum("docs").over(inside), zero)).withColumn("tokens_over", F.coalesce(F.sum("tokens").over(inside), zero))
        .join(per_block, "b")
        .withColumn("docs_over", F.col("docs_over") + F.col("d_after"))
        .withColumn("kept", F.col("t_all") - F.col("tokens_over") - F.col("t_after") + F.col("docs_over") * F.col("n_tokens"))
        .select(F.col("n_tokens").alias("context_limit"), "docs", "docs_over", (F.col("d_all") - F.col("docs_over")).alias("docs_in"), F.col("t_all").alias("total_tokens"), F.col("kept").alias("tokens_kept"), (F.col("t_all") - F.col("kept")).alias("tokens_lost"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_docs_in"))
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents doesn't exceed, as one row; null if the table is empty."""
    return table.where(F.col("share_docs_in") >= q - 1e-12).agg(F.min("context_limit").alias("quantile"))


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row for any limit: docs_over, total_tokens, tokens_kept; from the next longer length that occurs. Of an empty table total_tokens and tokens_kept are null."""
    longer = table.where(F.col("context_limit") > limit).agg(F.min(F.struct("context_limit", "docs", "docs_over", "tokens_kept")).alias("n"), F.max("total_tokens").alias("t0"))
    whole = table.agg(F.max("total_tokens").alias("total_tokens"))
    over = F.coalesce(F.col("n.docs_over") + F.col("n.docs"), F.lit(0))
    kept = F.coalesce(F.col("n.tokens_kept") - over * (F.col("n.context_limit") - limit), F.col("total_tokens"))
    return whole.crossJoin(longer).select(F.lit(limit).cast("long").alias("context_limit"), over.alias("docs_over"), "total_tokens", kept.alias("tokens_kept"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """answers() of the documents' histogram; the histogram is written once, for it is read twice."""
    prepare(docs.sparkSession)
    return answers(written(length_histogram(docs, path)))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts() of the whole table documents."""
    return token_counts(documents(spark, sf_dir))
