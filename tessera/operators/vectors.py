"""Vector lookup (embedding gather), RMS normalization, token append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scores import draw_rows
from tessera.operators.sizes import broadcast_if_small, byte_size
from tessera.session import materialize

#: Bytes of the vectors that a row may carry while its pieces are gathered.
ROW_TABLE_BYTES = 1 << 20


def rms_normalize(df: DataFrame, col: str = "embedding", out: str | None = None, eps: float = 1e-6) -> DataFrame:
    """X / sqrt(mean(x^2) + eps) per vector (weight 1), as doubles."""
    # The scale is its own column: referenced inside the lambda as an
    # expression it would be recomputed for every element.
    ms = F.aggregate(col, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(col)
    scaled = df.withColumn("_inv", F.lit(1.0) / F.sqrt(ms + F.lit(eps)))
    return (scaled.withColumn(out or col, F.transform(col, lambda v: v.cast("double") * F.col("_inv")))
            .drop("_inv"))


def lookup_vectors(df: DataFrame, key: Sequence[str], vectors: DataFrame, ids: str = "ids",
                   vec_id: str = "vec_id", vec: str = "embedding", out: str = "vectors") -> DataFrame:
    """Gather ``vectors[id]`` for every id of an array, keeping positions.

    Returns ``(key..., out)``, one row per input row, with ``out`` an array of vectors
    (NULL where an id has no vector). The vector table is broadcast if its bytes are
    measured to be few. A gathered row holds all its vectors: trim long arrays first
    (``batching.last_tokens``), or use ``pooled_vectors``, which gathers none.
    """
    # rows are numbered before they are exploded: in one projection the number would count exploded rows
    ex = (df.select(*key, F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
          .select(*key, "_row", F.posexplode_outer("_ids").alias("pos", "_id")))
    v = broadcast_if_small(vectors.select(F.col(vec_id).alias("_id"), F.col(vec).alias("_v")))
    joined = ex.join(v, "_id", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "_v"))
    return (joined.groupBy(*key, "_row").agg(F.array_sort(F.collect_list(item)).alias("_p"))
            .select(*key, F.transform("_p", lambda s: s["_v"]).alias(out)))


def lookup_vector_pieces(df: DataFrame, key: Sequence[str], vectors: DataFrame, size: int, ids: str = "ids",
                         vec_id: str = "vec_id", vec: str = "embedding", out: str = "vectors") -> DataFrame:
    """J2 for rows of any length: ``(key..., row, piece, out)`` with ``size`` ids to a piece, so no group or row holds more vectors than that.

    ``row`` tells input rows apart, ``piece`` counts from 0; a row without ids has no piece. If the vectors of the ids that occur
    are measured to be few (``ROW_TABLE_BYTES``; ids nearly without gaps), they travel as one broadcast array and each piece
    takes its own from that, without an exchange; else they are joined as in ``lookup_vectors``.
    """
    if size < 1:
        raise ValueError("size must be positive")
    rows = df.select(*key, F.monotonically_increasing_id().alias("row"), F.col(ids).alias("_ids"))
    v = vectors.select(F.col(vec_id).alias("_id"), F.col(vec).alias("_v"))
    table = _dense_table(df.select(F.explode(F.array_distinct(ids)).alias("_id")).distinct(), v)
    if table is not None:
        last = F.floor((F.size("_ids") - 1) / size).cast("int")
        at = F.when(F.size("_ids") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        # places of a piece, not a slice: that would read the whole array once a piece
        pieces = F.transform(at, lambda p: F.struct(p.cast("long").alias("piece"), F.transform(
            F.sequence(p * size, F.least((p + 1) * size, F.size("_ids")) - 1), lambda i: F.get("_table", F.get("_ids", i))).alias(out)))
        return rows.crossJoin(F.broadcast(table)).select(*key, "row", F.inline(pieces))
    ex = rows.select(*key, "row", F.posexplode("_ids").alias("_pos", "_id"))
    joined = ex.join(broadcast_if_small(v), "_id", "left").withColumn("piece", F.floor(F.col("_pos") / size))
    return (joined.groupBy(*key, "row", "piece").agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_p"))
            .select(*key, "row", "piece", F.transform("_p", lambda s: s["_v"]).alias(out)))


def _dense_table(wanted: DataFrame, vectors: DataFrame) -> DataFrame | None:
    """One row ``_table``: the vectors of the ``wanted`` ids, each at its id's place; None if they are many, far apart or not unique."""
    if vectors.schema["_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return None
    held = vectors.join(broadcast_if_small(wanted), "_id", "left_semi").filter("_id >= 0")
    few = held.limit(ROW_TABLE_BYTES // 64 + 1)  # a look at the ids before their vectors are written
    seen = few.agg(F.count("_id").alias("n"), F.countDistinct("_id").alias("ids"), F.max("_id").alias("last")).first()
    if seen["n"] > ROW_TABLE_BYTES // 64 or seen["n"] != seen["ids"] or (seen["last"] or 0) > 2 * seen["n"] + 1000:
        return None
    held = materialize(held, "vectors")
    if byte_size(held) > ROW_TABLE_BYTES:
        return None
    places = held.sparkSession.range((seen["last"] or 0) + 1).withColumnRenamed("id", "_id").join(F.broadcast(held), "_id", "left")
    return places.agg(F.array_sort(F.collect_list(F.struct("_id", "_v"))).alias("_t")).select(F.transform("_t", lambda x: x["_v"]).alias("_table"))


def pooled_vectors(df: DataFrame, key: Sequence[str], vectors: DataFrame, ids: str = "ids",
                   vec_id: str = "vec_id", vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Mean of the gathered vectors per row without materializing the gather.

    Counts ids per row first (partial aggregate), joins each distinct id once,
    and sums ``count * vector`` element-wise. One row per input row: ``tokens`` are
    its ids with a vector, ``missing`` those without, and ``pooled`` is the mean over
    ``tokens`` (NULL if there is none). ``dim`` is read from the vectors if not given;
    vectors of several lengths are an error.
    """
    if dim is None:
        size = vectors.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
        if size["lo"] is None or size["lo"] != size["hi"] or size["lo"] < 1:
            raise ValueError(f"vectors need one length; found {size['lo']} to {size['hi']}")
        dim = int(size["lo"])
    counts = (df.select(*key, F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
              .select(*key, "_row", F.explode_outer("_ids").alias("_id")).groupBy(*key, "_row", "_id").agg(F.count("_id").alias("_c")))
    v = broadcast_if_small(vectors.select(F.col(vec_id).alias("_id"), F.col(vec).alias("_v")))
    joined = counts.join(v, "_id", "left")
    weighted = joined.select(*key, "_row", "_c", F.col("_v").isNotNull().alias("_has"),
                             F.transform("_v", lambda x: x.cast("double") * F.col("_c")).alias("_w"))
    n = F.sum(F.when(F.col("_has"), F.col("_c")).otherwise(0))
    sums = weighted.groupBy(*key, "_row").agg(
        n.alias("tokens"), (F.sum("_c") - n).alias("missing"),
        *[F.sum(F.col("_w")[i]).alias(f"_s{i}") for i in range(dim)])
    mean = F.array(*[F.col(f"_s{i}") / F.col("tokens") for i in range(dim)])
    return sums.select(*key, "tokens", "missing", F.when(F.col("tokens") > 0, mean).alias("pooled"))


def append_token(df: DataFrame, drawn: DataFrame, ids: str = "ids", key: str = "prev",
                 token: str = "drawn") -> DataFrame:
    """Append the token drawn for each row's last id (join on that id).

    ``drawn`` has one row per context token (at most the vocabulary); it is
    broadcast if its bytes are measured to be few.
    """
    last = F.try_element_at(ids, F.lit(-1))
    d = broadcast_if_small(drawn.select(F.col(key).alias("_last"), F.col(token).alias("_next")))
    joined = df.withColumn("_last", last).join(d, "_last", "left")
    return (joined.withColumn(ids, F.when(F.col("_next").isNotNull(), F.concat(ids, F.array("_next")))
                              .otherwise(F.col(ids)))
            .drop("_last", "_next"))


def append_drawn(df: DataFrame, table: DataFrame, row: Sequence[str], seed: int, ids: str = "ids", by: str = "prev") -> DataFrame:
    """Append to each row a token of its own, drawn from the distribution of its last id.

    ``table`` is a ``scores.cumulative_table``; rows without ids, or whose last id it lacks, stay as they are.
    """
    last = df.withColumn("_last", F.try_element_at(ids, F.lit(-1)))
    drawn = draw_rows(last, table, "_last", row, seed, by, "_next")
    longer = F.when(F.col("_next").isNotNull(), F.concat(ids, F.array("_next"))).otherwise(F.col(ids))
    return drawn.withColumn(ids, longer).drop("_last", "_next")
