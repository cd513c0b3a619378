"""Records of several sources combined so that each source makes up its share of the total size."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspan.operators.ranking import rank_within

SEED = 20_240_611
MAX_SOURCES = 100_000


def wanted_tokens(sizes: dict[str, int], shares: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Tokens to take from each source: its share of the total, at most what its repeats allow.

    What capped and absent sources cannot give is shared out among the others in proportion, so that the total stays that
    of all listed documents as long as the caps allow it at all.
    """
    total = float(sum(sizes.get(s, 0) for s in shares))
    out: dict[str, float] = {}
    open_ = {s for s in shares if shares[s] > 0 and sizes.get(s, 0) > 0}
    while open_:
        rest, weight = total - sum(out.values()), sum(shares[s] for s in open_)
        full = {s for s in open_ if rest * shares[s] / weight >= most[s]}
        if not full:
            return out | {s: rest * shares[s] / weight for s in open_}
        out |= {s: most[s] for s in full}
        open_ -= full
    return out


def mix(sized: DataFrame, targets: DataFrame, item: str = "doc_id", source: str = "source", size: str = "tokens", share: str = "target_share", repeats: str = "max_repeats", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix (item, source, copy from 1, tokens: one row a copy) and the report, one row for each listed source.

    Systematic sampling: within a source, documents are ordered by size and hash, expected copies are summed up, one offset
    drawn from the seed is added, and a document comes out once for each whole number passed. As size is the first order,
    every stretch of sizes is thinned or repeated alike and the shares come out nearly exact; no document comes out more
    than its source's max_repeats times.

    Unlisted and null sources and documents without length are left out; a null share counts as 0, null repeats as 1;
    of a source listed twice the larger share counts; a null id is kept; repeated ids are documents of their own; an empty
    table gives an empty mix and a report of zeros; other columns are not read.
    """
    listed = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.max(F.coalesce(F.col(share), F.lit(0.0))).alias("target_share"), F.max(F.coalesce(F.col(repeats), F.lit(1))).alias("max_repeats"))
    rows = listed.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    shares, limits = {r["source"]: r["target_share"] for r in rows}, {r["source"]: max(r["max_repeats"], 0) for r in rows}
    docs = sized.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("tokens")).where("tokens > 0").join(F.broadcast(listed.select("source")), "source").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    wanted = wanted_tokens(sizes, shares, {s: float(limits[s]) * sizes.get(s, 0) for s in shares})
    rates = [(s, min(wanted.get(s, 0.0) / sizes[s], float(limits[s]))) for s in shares if sizes.get(s)]
    spark = sized.sparkSession
    rate = spark.createDataFrame(rates, "source string, rate double")
    ranked = rank_within(docs, ["source"], ["tokens"], ["item"]).join(F.broadcast(rate), "source")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 32)) / float(1 << 32)
    copies = F.floor((F.col("rank") + 1) * F.col("rate") + offset) - F.floor(F.col("rank") * F.col("rate") + offset)
    chosen = ranked.withColumn("copies", F.least(copies, F.ceil("rate")).cast("int")).where("copies > 0")
    mixed = chosen.select("item", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens").withColumnRenamed("item", item)
    taken = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    goal = spark.createDataFrame([(s, float(wanted.get(s, 0.0))) for s in shares], "source string, wanted_tokens double")
    report = listed.join(F.broadcast(goal), "source").join(taken, "source", "left").na.fill(0, ["documents", "copies", "tokens", "most_repeats"])
    # as many rows as sources are listed, MAX_SOURCES at most
    report = report.withColumn("total_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("total_tokens")), F.lit(0.0)))
    return mixed, report
