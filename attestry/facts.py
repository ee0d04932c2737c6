"""Facts: statements as rows, with scope, usability and opposition as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import terms

SCOPE = ["attribution", "time", "modality", "polarity", "world"]
#: What a dimension is when a record doesn't say.
DEFAULTS = {"modality": "asserted", "polarity": "positive"}
# States that keep a record out, or let it in.
DEAD = ["stale", "retracted", "superseded", "staged"]
TRUSTED = ["valid", "trusted", "structurally-valid", "source-checked", "rule-replayed", "semantically-reviewed", "model-reviewed", "human-approved"]
UNTRUSTED_ORIGINS = ["hypothesis", "candidate-extraction", "unreviewed"]
MODALITIES = ["asserted", "possible", "necessary", "believed", "reported", "conditional", "counterfactual", "uncertain", "ordered", "order", "permitted", "obligatory", "prohibited"]
POLARITIES = ["positive", "negative", "unknown"]

SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("pred", T.StringType()), T.StructField("arity", T.IntegerType()),
     T.StructField("args", T.ArrayType(T.StringType())), T.StructField("expr_key", T.StringType())]
    + [T.StructField(d, T.StringType()) for d in SCOPE]
    + [T.StructField(c, T.StringType()) for c in ("source_version_id", "source_id", "region_id", "quote", "lifecycle", "support_state", "validation", "origin", "rule_id", "rule_version")]
    + [T.StructField("dependencies", T.ArrayType(T.StringType())), T.StructField("premise_ids", T.ArrayType(T.StringType()))]
)
#: A call whose arguments are plain words: read without leaving the JVM.
_FLAT = r'^\(\s*([^\s()";?]+)((?:\s+[^\s()";?]+)*)\s*\)$'


def _tag(word: Column) -> Column:
    return F.when(word.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), F.concat(F.lit("n:"), word)).otherwise(F.concat(F.lit("a:"), word))


_READ = T.StructType([T.StructField("pred", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("expr_key", T.StringType())])


@F.pandas_udf(_READ)
def _read(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        c = terms.call_of(t)
        rows.append((c.value, [terms.tagged(a) for a in c.args], terms.show(c)) if c is not None and c.ground else (None, None, None))
    return pd.DataFrame(rows, columns=["pred", "args", "expr_key"])


def parsed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with pred, arity, args and expr_key of the call in ``text``; null where it isn't a ground call.

    Calls of plain words are read by expressions; only the rest (strings, nesting, numbers, comments)
    goes through Python.  Printing is canonical: numbers as numbers, one space between arguments.
    """
    flat = F.col(text).rlike(_FLAT) & ~F.col(text).rlike(r"(^|\s|\()-?\.?[0-9]") & ~F.col(text).rlike(r"^\(\s*(and|find)(\s|\))")
    head, rest = F.regexp_extract(text, _FLAT, 1), F.trim(F.regexp_extract(text, _FLAT, 2))
    words = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"\s+"))
    out = df.withColumn("_flat", F.coalesce(flat, F.lit(False)))
    easy = out.where("_flat").select(*df.columns, head.alias("pred"), F.transform(words, _tag).alias("args"), F.concat(F.lit("("), F.concat_ws(" ", F.array(head), words), F.lit(")")).alias("expr_key"))
    hard = out.where("not _flat").withColumn("_r", _read(F.col(text))).select(*df.columns, "_r.pred", "_r.args", "_r.expr_key")
    return easy.unionByName(hard).withColumn("arity", F.size("args")).withColumn("arity", F.when(F.col("pred").isNotNull(), F.col("arity")))


def facts(df: DataFrame) -> DataFrame:
    """Rows of any table as facts: missing columns null, blank scope values null, defaults filled in.

    Rows without a ground call (``pred`` null) are kept out.  ``ord`` is the order in which "the
    first" of several is meant; where the table has none, ids give it.
    """
    have = set(df.columns)
    out = []
    for f in SCHEMA.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
        elif f.name == "ord":
            c = F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name in SCOPE:
            c = F.when(F.trim(c) != "", c)
            c = F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c
        elif f.name in ("dependencies", "premise_ids"):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out).where("pred is not null and id is not null")


def usable(alias: str = "") -> Column:
    """Whether a record may support an answer: by lifecycle, support, validation and origin."""
    c = lambda n: F.col(f"{alias}.{n}" if alias else n)
    return (~F.coalesce(c("lifecycle").isin(DEAD), F.lit(False)) & (c("support_state").isNull() | (c("support_state") == "supported"))
            & (c("validation").isNull() | c("validation").isin(TRUSTED)) & ~F.coalesce(c("origin").isin(UNTRUSTED_ORIGINS), F.lit(False)))


def in_sources(scope: list[str] | DataFrame | None, df: DataFrame) -> DataFrame:
    """Rows whose version, source or id is in ``scope``: a short list is a filter, a table (column ``id``) a semi-join."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        s = scope.select(F.col("id").alias("_s")).where("_s is not null").distinct()
        keys = df.select("id", F.explode(F.array_distinct(F.array_compact(F.array("source_version_id", "source_id", "id")))).alias("_s"))
        return df.join(keys.join(s, "_s", "left_semi").select("id").distinct(), "id", "left_semi")
    return df.where(F.col("source_version_id").isin(scope) | F.coalesce(F.col("source_id").isin(scope), F.lit(False)) | F.col("id").isin(scope))


def aligned(want: dict[str, str | None] | None) -> Column:
    """Whether every dimension asked for is the record's."""
    ok = F.lit(True)
    for d, v in (want or {}).items():
        if d in SCOPE and v is not None:
            ok = ok & F.coalesce(F.col(d) == v, F.lit(False))
    return ok


def qualified(want: dict[str, str | None] | None) -> Column:
    """Whether the record says more than a plain statement in a dimension that wasn't asked for as it is."""
    want = want or {}
    q = (F.col("modality") != "asserted") & ~F.col("modality").eqNullSafe(F.lit(want.get("modality")))
    for d in ("attribution", "time", "world"):
        q = q | (F.col(d).isNotNull() & ~F.col(d).eqNullSafe(F.lit(want.get(d))))
    return q | ((F.col("polarity") == "negative") & F.lit(want.get("polarity") != "negative"))


def key_of(dims: list[str]) -> Column:
    """One string for several nullable dimensions, so that joins on them are plain equality."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(d)), F.lit("")) for d in dims])


def scope_key() -> Column:
    return key_of(SCOPE)


def claim_key() -> Column:
    """Scope without polarity: what an opposing statement must share."""
    return key_of([d for d in SCOPE if d != "polarity"])


def opponents(df: DataFrame) -> DataFrame:
    """(expr_key, claim, polarity, opponent_id): the first statement of the same call and scope with another polarity.

    Counts are combined per call, scope and polarity before anything is compared, so a call stated by
    very many records costs no more than its few polarities.
    """
    per = df.groupBy("expr_key", claim_key().alias("claim"), "polarity").agg(F.min(F.struct("ord", "id")).alias("first"))
    groups = per.groupBy("expr_key", "claim").agg(F.collect_list(F.struct("polarity", "first")).alias("sides")).where("size(sides) > 1")
    each = groups.select("expr_key", "claim", F.explode("sides.polarity").alias("polarity"), "sides")
    other = F.array_min(F.transform(F.filter("sides", lambda s: s["polarity"] != F.col("polarity")), lambda s: s["first"]))
    return each.select("expr_key", "claim", "polarity", other["id"].alias("opponent_id"))


def scope_from(text: str | None) -> dict[str, str | None]:
    """A requested scope from JSON text."""
    return {d: v for d, v in (json.loads(text) if text else {}).items() if d in SCOPE}
