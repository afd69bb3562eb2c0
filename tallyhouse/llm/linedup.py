"""Cross-site boilerplate lines: distinct-site sketches for each line, exact counts near the threshold.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import kept, row_key

#: Registers of a sketch are 2**LG_K; its relative standard error is about 1.04 / sqrt(2**LG_K).
LG_K, MIN_SITES = 10, 5


def band(min_sites: int, lg_k: int = LG_K) -> tuple[int, int]:
    """Estimates up to the first are below the threshold and those from the second on reach it; between them exact counts decide."""
    slack = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    return int(min_sites - slack) - 1, int(min_sites + slack) + 1


def boilerplate_hits(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """key (the document's row_key) and cut (positions of the lines to remove, sorted) of each document that loses lines."""
    low, high = band(min_sites, lg_k)
    line = F.trim(F.col("line"))
    lines = (
        docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length(line) > 0)
        .select("key", "doc_id", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))
    )
    # sketches merge by aggregation: a map-side partial sketch for each line, then one for each line hash
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    # written first: then the join below reads both sides by exchanges of its own, and a line that is everywhere can be split
    spread = kept(spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") > low))
    hits = kept(lines.join(spread, ["h1", "h2"]))
    near = hits.where(F.col("sites") < high).groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    sure = hits.where(F.col("sites") >= high)
    cut = sure.unionByName(hits.where(F.col("sites") < high).join(near, ["h1", "h2"], "left_semi"))
    return cut.where(~((F.col("first.key") == F.col("key")) & (F.col("first.pos") == F.col("pos")))).groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("cut"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with kept_text, n_lines (lines that hold more than spaces) and n_removed added.

    A line, without spaces at its ends, is boilerplate if it stands on min_sites or more distinct sites
    (column source; null is no site). All its places go but the first, that with the smallest doc_id and
    position, so that copied documents stay once. Sites are counted by HyperLogLog sketches for each line
    hash (128 bits); lines whose estimate is near the threshold are counted exactly. Lines of spaces only
    stay. Null text: null kept_text and no lines. Repeated rows (same doc_id and text) count as one
    document and get the same result; an empty table gives no rows; other columns pass through, whatever
    their names, unless named like the three that are added.
    """
    columns = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed")]
    cut = boilerplate_hits(docs, min_sites, lg_k)
    of = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"), row_key().alias("key")).join(cut, "key", "left")
    parts = F.split("d.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "cut")
    held = F.when(F.col("cut").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    filled = F.size(F.filter(parts, lambda x: F.length(F.trim(x)) > 0))
    return of.select(*[F.col(f"d.`{c}`") for c in columns], held.alias("kept_text"), F.coalesce(F.when(F.col("d.text").isNotNull(), filled), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("cut"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
