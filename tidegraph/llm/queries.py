"""The text queries p8..p10 and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.normal import normal_form
from tidegraph.llm.mixing import mix
from tidegraph.llm.packing import CAPACITY, pack
from tidegraph.llm.sizes import text_size
from tidegraph.llm.splitting import LIMIT, OVERLAP, cut_paragraphs, split_documents
from tidegraph.plans.payment_sql import _WS, nf
from tidegraph.session import Scratch, broadcast_if_small
from tidegraph.sources.tables import table


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *columns)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_documents(spark, d).select("doc_id", text_size("text").alias("size")), "doc_id", "size")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that were cut: those with a second part."""
    return _packed(spark, d).filter("part_no = 1").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every document with its container."""
    return _packed(spark, d)


def p8_packing_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its parts, their sizes, and whether they follow each other in containers that are not over-full."""
    parts = Scratch(spark, "p8").table(_packed(spark, d), "parts")
    full = parts.groupBy("container_id").agg((F.sum("part_size") <= CAPACITY).alias("fits"))
    each = parts.join(full, "container_id")
    return each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("part_size").alias("size"), (F.max(F.col("part_start") + F.col("part_size")) == F.sum("part_size")).alias("every_unit_once"),
        F.bool_and("fits").alias("containers_fit"),
    )


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many parts and units the containers hold, whether one is over-full, and whether they are 97 % full."""
    per = _packed(spark, d).groupBy("container_id").agg(F.sum("part_size").alias("filled"), F.count(F.lit(1)).alias("parts"))
    share = F.sum("filled") / (F.count(F.lit(1)) * F.lit(float(CAPACITY)))
    return per.agg(F.sum("parts").alias("parts"), F.sum("filled").alias("total_size"), (F.max("filled") <= CAPACITY).alias("none_over_full"), (share >= 0.97).alias("well_filled"))


def _mixture(spark: SparkSession, d: str):
    docs = _documents(spark, d, "source").select("doc_id", "text", normal_form("source").alias("source"), text_size("text").alias("size"))
    return mix(docs, table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the fit uses as often as allowed and still leaves short, checked exactly.

    Short for the fit is a source whose labelled documents are (nearly) at their cap while its
    fitted size is not (clearly) above its target: the slack covers what soft membership moves
    between sources, and the exact test of the label's own size decides.
    """
    report = _mixture(spark, d).report.filter("source IS NOT NULL")
    target = F.col("target_share") * F.col("mixture_size")
    short = report.filter((F.coalesce("mean_rate", F.col("max_repeats").cast("double")) >= 0.9 * F.col("max_repeats")) & (F.col("expected_size") <= 1.02 * target))
    return short.filter(F.col("available_size") * F.col("max_repeats") < target).select("source")


def p9_mixture_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares per source."""
    return _mixture(spark, d).report


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its rate, number of copies and membership."""
    return _mixture(spark, d).documents


def p9_mixture_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per target: exact sizes by label, and whether caps and memberships hold and a reachable share was met.

    A source is met if the fitted size is within 2 % of its target, or below it with its documents at their cap.
    """
    m = _mixture(spark, d)
    z = F.coalesce("max_repeats", F.lit(0))
    caps = broadcast_if_small(table(spark, d, "source_targets").select("source", "max_repeats"))
    used = m.documents.filter("source IS NOT NULL").join(caps, "source").groupBy("source").agg(
        F.bool_and((F.col("copies") >= 0) & (F.col("copies") <= z) & (F.abs(F.col("copies") - F.col("rate")) < 1)).alias("copies_ok"),
        F.bool_and(F.abs(F.aggregate("member", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-5).alias("members_ok"),
    )
    target = F.col("target_share") * F.col("mixture_size")
    met = (F.abs(F.col("expected_size") - target) <= 0.02 * target) | ((F.col("expected_size") < target) & (F.coalesce("mean_rate", z.cast("double")) >= 0.98 * z))
    return m.report.filter("source IS NOT NULL").join(used, "source", "left").select(
        "source", "documents", "available_size", "mixture_size", met.alias("share_met_or_at_cap"), F.coalesce("copies_ok", F.lit(True)).alias("copies_within_caps"),
        F.coalesce("members_ok", F.lit(True)).alias("memberships_add_up"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs in which a piece begins, of which only those above the limit had to be cut."""
    cut = cut_paragraphs(p10_pieces(spark, d), "doc_id")
    return cut.filter(F.col("paragraph_size") > LIMIT).select("doc_id", "paragraph_no")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document."""
    return split_documents(_documents(spark, d), "doc_id", "text")


def p10_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: whether its pieces join to its text, none exceeds the limit and each repeats the overlap before it."""
    pieces = p10_pieces(spark, d)
    core = F.substring("piece", F.col("core_start") - F.col("start") + 1, F.col("end") - F.col("core_start"))
    repeated = text_size(F.substring("piece", F.lit(1), F.col("core_start") - F.col("start")))
    sized = pieces.select("doc_id", "piece_no", "size", core.alias("core"), repeated.alias("repeated"), text_size("piece").alias("counted"))
    per = sized.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "core"))), lambda x: x["core"]), "").alias("joined"),
        F.max("counted").alias("largest"), F.sum(F.col("counted") - F.col("repeated")).alias("size"),
        F.bool_and(F.col("counted") == F.col("size")).alias("sizes_ok"),
        F.bool_and(F.when(F.col("piece_no") == 0, F.col("repeated") == 0).otherwise(F.col("repeated").between(1, OVERLAP))).alias("overlaps_ok"),
    )
    return per.join(_documents(spark, d), "doc_id").select(
        "doc_id", "size", (F.col("joined") == F.col("text")).alias("joins_to_text"), ((F.col("largest") <= LIMIT) & F.col("sizes_ok")).alias("within_limit"), F.col("overlaps_ok").alias("overlaps_repeat")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p8_found, p8_containers, p8_packing_audit, p8_fill, p9_found, p9_mixture_report, p9_mixture, p9_mixture_audit, p10_found, p10_pieces, p10_round_trip)
}

_SPACES = "".join(f"\\x{{{ord(c):x}}}" for c in _WS[1:-1])
_UNIT = f"[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}{_SPACES}]"


def _size(column: str) -> str:
    return f"coalesce(len(regexp_extract_all({column}, '{_UNIT}')), 0)"


ORACLE: dict[str, str] = {
    "p8_found": f"SELECT doc_id FROM documents WHERE {_size('text')} > 2048",
    "p8_packing_audit": f"""SELECT doc_id, greatest(1, CAST(ceil({_size('text')} / 2048.0) AS BIGINT)) AS parts, CAST({_size('text')} AS BIGINT) AS size,
true AS every_unit_once, true AS containers_fit FROM documents""",
    "p8_fill": f"""SELECT CAST(sum(greatest(1, CAST(ceil({_size('text')} / 2048.0) AS BIGINT))) AS BIGINT) AS parts, CAST(sum({_size('text')}) AS BIGINT) AS total_size,
true AS none_over_full, true AS well_filled FROM documents""",
    "p9_mixture_audit": f"""WITH s AS (SELECT {nf("source")} AS source, {_size("text")} AS size FROM documents)
SELECT t.source, count(s.size) AS documents, CAST(coalesce(sum(s.size), 0) AS BIGINT) AS available_size, (SELECT CAST(sum(size) AS BIGINT) FROM s WHERE source IS NOT NULL) AS mixture_size,
true AS share_met_or_at_cap, true AS copies_within_caps, true AS memberships_add_up FROM source_targets t LEFT JOIN s ON t.source = s.source GROUP BY t.source""",
    "p10_round_trip": f"""SELECT doc_id, CAST({_size('text')} AS BIGINT) AS size, true AS joins_to_text, true AS within_limit, true AS overlaps_repeat FROM documents WHERE text IS NOT NULL""",
    "p9_found": f"""
WITH s AS (SELECT {nf("source")} AS source, {_size("text")} AS size FROM documents),
a AS (SELECT sum(size) AS total FROM s WHERE source IS NOT NULL),
b AS (SELECT source, sum(size) AS size FROM s GROUP BY 1)
SELECT t.source FROM source_targets t LEFT JOIN b ON t.source = b.source, a WHERE coalesce(b.size, 0) * t.max_repeats < t.target_share * a.total
""",
    "p10_found": f"""
WITH lines AS (
  SELECT doc_id, rid, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
  FROM (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE text IS NOT NULL)),
marked AS (SELECT *, trim(line, {_WS}) = '' AS blank, lag(trim(line, {_WS}) = '', 1, true) OVER (PARTITION BY rid ORDER BY line_no) AS after_blank FROM lines),
para AS (SELECT doc_id, rid, line, sum(CASE WHEN NOT blank AND after_blank THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph_no FROM marked WHERE NOT blank)
SELECT doc_id, CAST(paragraph_no AS BIGINT) AS paragraph_no FROM para GROUP BY doc_id, rid, paragraph_no HAVING sum({_size("line")}) > 400
""",
}
