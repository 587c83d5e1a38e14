"""Line dedup by a log-template tree.

A line is parsed at fixed depth: its number of tokens, then its leading tokens, name its leaf. The
tokens of a line fall into up to ``FIELDS`` runs; runs that differ from the leaf's most common line
are variable fields, and a line with few of them belongs to the leaf's template. Any other line is
a template of its own. Templates that recur across documents are dropped wherever they stand,
except at their first place, so nothing is lost altogether. Only DataFrame functions run here, and
no line's text is shuffled before the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import SPACE, stage, text_of, trimmed

# Leading tokens that, with their number, name a leaf.
DEPTH = 3
FIELDS = 8
# Share of a line's fields that have to agree with the leaf's most common line, in percent.
AGREE = 75
# A template is dropped when its documents times its tokens reach this, in two documents or more:
# a passage of 50 words in two, a line of five words in twenty.
WEIGHT = 100


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, pos, n, leaf, fields) of every line with a token; digits make a token variable.

    ``_h``, the hash of the text, tells texts of equal id apart.
    """
    rows = text_of(docs, id_col, text_col).select(
        "_id", F.xxhash64("_text").alias("_h"), F.posexplode(F.split("_text", "\n")).alias("pos", "_l")
    )
    line = trimmed(F.col("_l"))
    line = F.when(line.rlike(f"[{SPACE}]{{2}}|[\\x09-\\x0D]"), F.regexp_replace(line, f"[{SPACE}]+", " ")).otherwise(line)
    line = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)
    rows = rows.select("_id", "_h", "pos", F.explode(F.array(F.split(line, " "))).alias("_t")).filter(
        F.get("_t", F.lit(0)) != ""
    )
    n = F.size("_t")
    runs = F.least(n, F.lit(FIELDS))

    def field(k: int) -> Column:
        start, end = (F.floor(F.lit(i) * n / runs).cast("int") for i in (k, k + 1))
        part = F.slice("_t", start + 1, end - start)
        return F.when(k < runs, F.hash(F.array_join(part, " ")))

    return rows.select(
        "_id",
        "_h",
        "pos",
        n.alias("n"),
        F.xxhash64(n, F.array_join(F.slice("_t", 1, DEPTH), " ")).alias("leaf"),
        F.array(*[field(k) for k in range(FIELDS)]).alias("fields"),
    )


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, drop): the positions of the lines to drop, for documents that have any."""
    lines = stage(_lines(docs, id_col, text_col), "lines")
    # A line counts once a document, so a hot line is one row a document from here on.
    each = lines.groupBy("leaf", "fields", "_id", "_h").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))
    kinds = each.groupBy("leaf", "fields").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("_id", "_h", "pos")).alias("first"), F.first("n").alias("n")
    )
    usual = kinds.groupBy("leaf").agg(
        F.min(F.struct((-F.col("docs")).alias("docs"), "first", "fields"))["fields"].alias("usual"),
        F.sum("docs").alias("leaf_docs"),
    )
    agree = F.size(F.filter(F.zip_with("fields", "usual", lambda a, b: a == b), lambda x: x))
    of_leaf = 100 * agree >= AGREE * F.least(F.col("n"), F.lit(FIELDS))
    # Leaves too light to recur need no further look. Where two lines of a document are of one
    # template, the bound counts both, so it never rules out too much.
    template = stage(
        kinds.join(usual, "leaf")
        .filter((F.col("leaf_docs") > 1) & (F.col("leaf_docs") * F.col("n") >= WEIGHT))
        .select(
            "leaf", "fields", "n",
            F.when(of_leaf, F.col("leaf")).otherwise(F.xxhash64("leaf", "fields")).alias("template"),
        ),
        "templates",
    )
    placed = stage(
        lines.drop("n").join(template, ["leaf", "fields"])
        .groupBy("template", "n", "_id", "_h")
        # Lines of one document, once where its row is repeated.
        .agg(F.sort_array(F.array_distinct(F.collect_list("pos"))).alias("at")),
        "placed",
    )
    # Written down, so that the join below deals both sides anew and can split a hot template.
    recurring = stage(
        placed.groupBy("template", "n")
        .agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("_id", "_h", F.col("at")[0])).alias("first"))
        .filter((F.col("docs") > 1) & (F.col("docs") * F.col("n") >= WEIGHT))
        .select("template", "n", F.col("first._id").alias("keeper"), F.col("first._h").alias("keeper_h")),
        "recurring",
    )
    here = F.col("_id").eqNullSafe(F.col("keeper")) & (F.col("_h") == F.col("keeper_h"))
    late = F.when(here, F.expr("slice(at, 2, size(at))")).otherwise(F.col("at"))
    return (
        placed.join(recurring, ["template", "n"])
        .select("_id", "_h", F.explode(late).alias("pos"))
        .groupBy("_id", "_h")
        .agg(F.collect_list("pos").alias("drop"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines gone from the text, and ``n_lines`` and ``n_dropped``.

    Rows of equal id, NULL included, and equal text are one document. Lines without a token stay. NULL texts stay
    NULL and empty ones empty, with no lines dropped. The first place of a template is that of the
    smallest id, and of its texts that of the smallest hash; every repeated row of it keeps it. An empty
    table gives no rows. Other columns may be called anything; those called like the two counts are
    replaced.
    """
    drop = dropped_lines(docs, id_col, text_col).select(F.col("_id").alias("drop_id"), F.col("_h").alias("drop_h"), "drop")
    # All columns of ``docs`` are one here, so that none can clash with those of this function.
    rows = docs.drop("n_lines", "n_dropped").select(F.struct("*").alias("doc"))
    text = F.col("doc").getField(text_col)
    rows = rows.join(
        drop,
        F.col("doc").getField(id_col).eqNullSafe(F.col("drop_id")) & (F.xxhash64(text) == F.col("drop_h")),
        "left",
    ).withColumn("lines", F.explode(F.array(F.split(text, "\n"))))
    stay = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")),
        lambda i: F.get(F.col("lines"), i),
    )
    kept = F.when(F.col("drop").isNull() | text.isNull(), text).otherwise(F.array_join(stay, "\n"))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    n_dropped = F.size(F.array_intersect("drop", F.sequence(F.lit(0), n_lines - 1)))
    return rows.select(
        *[
            (kept if c == text_col else F.col("doc").getField(c)).alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256): the outcome of ``line_dedup`` without the texts."""
    kept = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return line_dedup(docs.select(id_col, text_col), id_col, text_col).select(
        id_col, "n_lines", "n_dropped", kept.alias("kept_sha256")
    )


def sql_dropped(source: str) -> str:
    """SQL for (doc_id, pos) of the dropped lines of ``source``, as common table expressions."""
    return f"""
line0 AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source})
), toks AS (
  SELECT doc_id, pos, list_transform(
      list_filter(string_split_regex(l, '[{SPACE}]+'), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM line0
), lines AS (
  SELECT doc_id, pos, len(t) AS n, array_to_string(t[1:{DEPTH}], ' ') AS lead,
    list_transform(range(0, least(len(t), {FIELDS})), lambda k: array_to_string(
      t[k * len(t) // least(len(t), {FIELDS}) + 1 : (k + 1) * len(t) // least(len(t), {FIELDS})],
      ' ')) AS f
  FROM toks WHERE len(t) > 0
), kinds AS (
  SELECT n, lead, f, count(DISTINCT doc_id) AS docs, min((doc_id, pos)) AS first
  FROM lines GROUP BY n, lead, f
), usual AS (
  SELECT n, lead, arg_min(f, (-docs, first)) AS u FROM kinds GROUP BY n, lead
), placed AS (
  SELECT l.doc_id, l.pos, l.n, l.lead,
    CASE WHEN 100 * len(list_filter(range(1, len(f) + 1), lambda i: f[i] = u[i]))
              >= {AGREE} * len(f) THEN NULL ELSE f END AS own
  FROM lines l JOIN usual u ON u.n = l.n AND u.lead = l.lead
), recurring AS (
  SELECT n, lead, own, min((doc_id, pos)) AS first FROM placed GROUP BY n, lead, own
  HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT doc_id) * n >= {WEIGHT}
), gone AS (
  SELECT p.doc_id, p.pos FROM placed p JOIN recurring r
  ON r.n = p.n AND r.lead = p.lead AND r.own IS NOT DISTINCT FROM p.own
  WHERE (p.doc_id, p.pos) <> r.first
)"""


ORACLE = f"""
WITH {sql_dropped("documents")}, kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS text
  FROM line0 ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), drops AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(drops.n, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN drops ON drops.doc_id = d.doc_id
"""
