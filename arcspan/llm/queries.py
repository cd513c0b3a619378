"""Queries p2, p5, p6, p7 and p8 over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.canonical import map_values
from arcspan.llm.matching import match, site_profiles, site_spans
from arcspan.llm.mixing import mix
from arcspan.llm.packing import pack
from arcspan.llm.residue import candidates, messages, residue
from arcspan.llm.thesaurus import names_table
from arcspan.llm.tokens import with_tokens
from arcspan.operators.units import BP, CALENDAR, calendar_years, stated_units
from arcspan.plans.runtime import not_blank, table


def _mapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_values(table(spark, sf_dir, "xronos_sites"), "xronos_id", ["site_type", "feature_type"], table(spark, sf_dir, "type_list"), names=names_table(spark))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the type list that each freely typed type means, 0 for none."""
    return _mapped_types(spark, sf_dir).select("xronos_id", "field_name", "ref_id")


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that mean no entry, with their number of uses."""
    return _mapped_types(spark, sf_dir).where("ref_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("uses"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    gazetteer, dates = table(spark, sf_dir, "pleiades_places_latest"), table(spark, sf_dir, "p3k14c_data")
    first = calendar_years(gazetteer, "id", "minDate", "description", None, CALENDAR).groupBy(F.col("rec_key").alias("id")).agg(F.min("year").alias("low"))
    places = gazetteer.select("id", F.col("title").alias("name"), F.col("reprLat").alias("lat"), F.col("reprLong").alias("lon"), F.col("maxDate").alias("high")).join(first, "id", "left")
    sources = stated_units(table(spark, sf_dir, "date_sources"), "source_code", "remark")
    spans = site_spans(calendar_years(dates.where(not_blank("SiteID")), "SiteID", "Age", "Notes", "Source", BP, sources))
    sites = site_profiles(dates, "SiteID", "SiteName", "Lat", "Long").join(spans, "id", "left")
    return match(places, sites)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a gazetteer place and a site that are rather the same place than not."""
    return _matched(spark, sf_dir).where("confidence >= 0.5").select(F.col("place").alias("place_id"), F.col("site").alias("site_id"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that are the same place with a posterior of at least a thousandth; 0 for those that contradict a better pair."""
    return _matched(spark, sf_dir).select(F.col("place").alias("place_id"), F.col("site").alias("site_id"), F.round("confidence", 6).alias("confidence"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "pack_spec").select("capacity_tokens").first()[0]
    return pack(with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id"]), "doc_id", "tokens", capacity)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut, as their text alone is longer than a container."""
    return _packed(spark, sf_dir).where("pieces > 1 and piece = 0").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which piece of which document lies in which container, the tier it was routed to, and the container's step group."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest that any packing could need, and the share of room that is filled."""
    capacity = table(spark, sf_dir, "pack_spec").select("capacity_tokens").first()[0]
    packed = _packed(spark, sf_dir).where("container_id is not null")
    by_container = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return by_container.agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.ceil(F.sum("tokens") / F.lit(capacity)).alias("fewest_possible"), F.round(F.sum("tokens") / (F.count("*") * F.lit(capacity)), 6).alias("filled")
    )


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(with_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, one row a copy."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of the listed sources."""
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, error messages or notices about scripts."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of messages themselves, each with one of its messages, its kind, documents and sources."""
    return messages(candidates(table(spark, sf_dir, "documents"), "doc_id", "text", "source", with_text=True)).select("message", "kind", "docs", "sources")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_messages": p8_messages, "p2_found": p2_found, "p2_misses": p2_misses}
ORACLE: dict[str, str] = {}
