"""Page documents from several sources: reader texts, rendered variants, images worth reading, merged fragments and the context for a model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of fragments in the order in which a model is shown them, how many fragments and characters of each it gets, and characters in all.
RANKS = {"image_ocr": 9, "table": 8, "rendered_visible_text": 7, "reader_markdown": 6, "static_visible_text": 5, "image_text": 4, "metadata": 3, "script_json": 2, "script_text": 1}
BLOCKS, BLOCK_CHARS, CONTEXT_CHARS = 70, 5_000, 110_000
#: Kinds that count as having two hints more, and kinds that are shown without any.
LIKELY, ALWAYS = ("image_ocr", "table", "image_text"), ("metadata", "reader_markdown")
#: Words that hint at results of evaluations.
HINTS = r"(?i)\b(?:benchmarks?|evals?|evaluations?|leaderboards?|accuracy|pass@\d+)\b"
#: Image texts that are worth reading, and addresses of images that are not.
IMAGE_HINTS, NO_CHART = r"(?i)chart|table|score|performance", ("%.svg%", "%newsletter%", "%logo%")


def reader_documents(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """(page_id, title, final_url, source_kind, label, text) of pages in Markdown with lines `Title:` and `URL Source:`; missing lines give empty texts, null and empty
    pages no row."""
    line = lambda name: F.trim(F.regexp_replace(F.regexp_extract(F.col(text), rf"(?m)^{name}:[^\S\n]*(\S.*)$", 1), r"(?U)\s+", " "))
    rows = pages.where(F.length(F.trim(text)) > 0)
    return rows.select(F.col(page_id).alias("page_id"), line("Title").alias("title"), line("URL Source").alias("final_url"), F.lit("reader_markdown").alias("source_kind"), F.lit("reader").alias("label"), F.col(text).alias("text"))


def best_variants(variants: DataFrame, page_id: str, score: str, number: str) -> DataFrame:
    """The variant of each page with the greatest score; of equal ones that of the least number. Null scores come last; null pages are kept as one page."""
    order = F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), (-F.col(number)).alias("n"))
    best = variants.groupBy(F.col(page_id).alias("_page")).agg(F.max_by(F.struct(*variants.columns), order).alias("_best"))
    return best.select("_best.*")


def image_candidates(fragments: DataFrame, page_id: str, kind: str, text: str) -> DataFrame:
    """(page_id, urls): the distinct addresses in image texts that hint at results, in the order of the texts' places (fragment) and in them."""
    rows = fragments.where((F.col(kind) == "image_text") & (F.col(text).rlike(HINTS) | F.col(text).rlike(IMAGE_HINTS)))
    found = rows.select(F.col(page_id).alias("page_id"), "fragment", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"""https?://[^\s<>"')\]]+"""), 0)).alias("at", "url"))
    url = F.regexp_replace("url", "[.,;]+$", "")
    good = found.select("page_id", F.struct("fragment", "at").alias("place"), url.alias("url"))
    for pattern in NO_CHART:
        good = good.where(~F.lower("url").like(pattern))
    firsts = good.groupBy("page_id", "url").agg(F.min("place").alias("place"))
    return firsts.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))


def merged_documents(fragments: DataFrame, page_id: str, document: str, compared: int | None = None) -> DataFrame:
    """fragments (page_id, document, fragment, source_kind, label, text) of several documents of a page as one: those of later documents first, and of fragments with the
    same kind, label and text the first. compared: characters by which texts are told apart, if not by all. `place` counts them anew."""
    key = F.col("text") if compared is None else F.substring("text", 1, compared)
    order = [F.desc(document), "fragment"]
    one = Window.partitionBy(page_id, "source_kind", "label", key).orderBy(*order)
    kept = fragments.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(page_id).orderBy(*order)))


def model_context(fragments: DataFrame, page_id: str, ranks: Mapping[str, int] = RANKS, blocks: int = BLOCKS, block_chars: int = BLOCK_CHARS, chars: int = CONTEXT_CHARS) -> DataFrame:
    """(page_id, context, blocks): what a model is shown of a page, the most telling fragments first, up to the first that would not fit any more; the limits are the feature.

    Fragments (page_id, fragment, source_kind, label, text) rank by kind, then by hints in the text, then by place. Those without a hint count only if their kind always does.
    """
    hints = F.regexp_count("text", F.lit(HINTS)) + F.col("source_kind").isin(*LIKELY).cast("int") * 2
    rank: Column = F.lit(0)
    for kind, value in ranks.items():
        rank = F.when(F.col("source_kind") == kind, value).otherwise(rank)
    rows = fragments.where(F.length("text") > 0).withColumn("_hints", hints).where((F.col("_hints") > 0) | F.col("source_kind").isin(*ALWAYS))
    rows = rows.withColumn("_score", rank * 1000 + F.col("_hints"))
    w = Window.partitionBy(page_id).orderBy(F.desc("_score"), "fragment")
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= blocks)
    head = F.format_string("[F%03d original:%d source:%s:%s]\n", "_n", F.col("fragment"), "source_kind", "label")
    rows = rows.withColumn("_block", F.concat(head, F.substring("text", 1, block_chars)))
    upto = F.sum(F.length("_block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).where(F.col("_upto") <= chars)  # running sums grow, so nothing after the first that does not fit is left
    return rows.groupBy(F.col(page_id).alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_block"))), lambda x: x["_block"]), "\n\n").alias("context"), F.count("*").alias("blocks"))
