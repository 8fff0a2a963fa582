"""Context for a model: hits rendered as numbered documents, up to a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C


def render(number: Column, title: Column, uri: Column, page_start: Column, page_end: Column, breadcrumb: Column, text: Column) -> Column:
    pages = F.when(page_end.isNull() | (page_end == page_start), page_start.cast("string")).otherwise(F.concat(page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    page = F.when(page_start.isNotNull(), F.concat(F.lit(' page="'), pages, F.lit('"'))).otherwise(F.lit(""))
    body = F.when(F.coalesce(breadcrumb, F.lit("")) != "", F.concat(breadcrumb, F.lit("\n\n"), text)).otherwise(text)
    return F.concat(F.lit('<document id="'), number.cast("string"), F.lit('" title='), C.quoted_attribute(title), F.lit(" uri="), C.quoted_attribute(uri), page, F.lit(">\n"), body, F.lit("\n</document>"))


def rendered(hits: DataFrame) -> DataFrame:
    """Add ``block``: the hit as the document numbered by its rank."""
    return hits.withColumn("block", render(*[F.col(c) for c in ("rank", "title", "uri", "page_start", "page_end", "breadcrumb", "text")]))


def within_budget(hits: DataFrame, most: int, *, cost: str = "tokens", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """The longest prefix whose running cost is within ``most``, and the first hit in any case. Running costs never fall, so a test of each finds the prefix."""
    so_far = F.sum(cost).over(Window.partitionBy(qid).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("so_far", so_far).where((F.col("so_far") <= most) | (F.col(rank) == 1))


def assembled(hits: DataFrame, most_tokens: int, *, qid: str = "qid") -> DataFrame:
    """One row per question: context, chunks (in order), tokens and how many were dropped. Hits number some tens a question."""
    blocks = rendered(hits).withColumn("tokens", C.token_count("block"))
    kept = within_budget(blocks, most_tokens, qid=qid).groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct("rank", "block", "chunk_id", "doc_id", "title", "uri", "page_start", "text", "score"))).alias("chunks"), F.sum("tokens").cast("long").alias("tokens")
    )
    all_ = hits.groupBy(qid).agg(F.count("*").alias("n"))
    return kept.join(all_, qid).select(qid, F.array_join(F.transform("chunks", lambda c: c["block"]), "\n\n").alias("context"), F.transform("chunks", lambda c: c.dropFields("block")).alias("chunks"), "tokens", (F.col("n") - F.size("chunks")).cast("long").alias("dropped"))
