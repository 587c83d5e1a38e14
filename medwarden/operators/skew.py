"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of its side. At most 1/HOT_SHARE keys can be
# hot, so the hot-key table is bounded whatever the size of the data.
HOT_SHARE = 0.01
SALTS = 32
_TRACKED_KEYS = 10_000


def _key_text(keys: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows, as one text column ``_hot``.

    A frequent-items sketch per partition is merged into one row: one pass over the key columns
    and no shuffle of them. Which keys it names decides only where rows are placed, never which
    rows come out.
    """
    most = int(1 / share)
    sketch = df.select(_key_text(keys).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {most}, {_TRACKED_KEYS})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    return (
        sketch.select(F.explode("top").alias("t"), "total")
        .filter(F.col("t.count") >= F.col("total") * share)
        .select(F.col("t.item").alias("_hot"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    hot_side: str = "left",
    spread_by: list[str] | None = None,
    salts: int = SALTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on same-named columns that splits hot keys of ``hot_side`` over ``salts`` tasks.

    Rows of a hot key get a salt from a hash of ``spread_by`` (default: all columns of that side),
    which a recomputed task reproduces; the matching rows of the other side are repeated once per
    salt. Cold keys have one salt and no copies. Gives the rows of a plain join.

    ``hot`` is the result of ``hot_keys`` where the keys are known from a cheaper frame than the
    hot side itself, for example one that was joined already.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if hot_side not in ("left", "right"):
        raise ValueError("hot_side must be left or right")
    big, other = (left, right) if hot_side == "left" else (right, left)
    # Bounded by 1/share rows, see above.
    hot = F.broadcast(hot_keys(big, on) if hot is None else hot)
    spread = spread_by or big.columns

    # On the repeated side a NULL key must stay single: its copies would all be without a match.
    text = _key_text(on)
    if hot_side == "right":
        text = F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]), text)

    def mark(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", text).join(
            hot, F.col("_key") == F.col("_hot"), "left"
        )

    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    big = mark(big).withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(F.lit(0))
    )
    copies = F.when(
        F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))
    ).otherwise(F.array(F.lit(0)))
    other = mark(other).withColumn("_salt", F.explode(copies))

    if hot_side == "left":
        joined = big.drop("_key", "_hot").join(
            other.drop("_key", "_hot"), [*on, "_salt"], how
        )
        return joined.drop("_salt")

    marked_big = big.drop("_key", "_hot").withColumn("_matched", F.lit(True))
    joined = other.drop("_key").join(marked_big, [*on, "_salt"], how)
    if how == "left":
        # A hot key has matches, so an unmatched copy of its row is an artefact of salting.
        joined = joined.filter(F.col("_hot").isNull() | F.col("_matched").isNotNull())
    return joined.drop("_salt", "_hot", "_matched")
