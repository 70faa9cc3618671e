"""Cleaning, projections, filters and row lookups."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from retentio.functions.expr import coerce_numeric
from retentio.operators.regex_index import search, with_trigrams
from retentio.operators.scalars import scalar_struct

# Columns that are not model features (ids, target, RFM internals).
DROP_COLS = ["customerID", "Churn", "tenure_group", "RFM_Segment", "recency",
             "frequency", "monetary", "R_Score", "F_Score", "M_Score"]

_REGEX_META = r"[\\^$.|?*+()\[\]{}]"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def coerce_numeric_col(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """String -> double, unparsable values become NULL."""
    return df.withColumn(col, coerce_numeric(col))


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows over all columns (map-side partial dedup)."""
    return df.dropDuplicates()


def impute_zero(df: DataFrame, cols: list[str] | None = None, value=0) -> DataFrame:
    """Fill NULL in ``cols`` (default TotalCharges) with a constant."""
    return df.fillna(value, subset=cols or ["TotalCharges"])


def encode_target(df: DataFrame, col: str = "Churn", positive: str = "Yes",
                  negative: str = "No") -> DataFrame:
    """Yes -> 1, No -> 0, anything else (including 'Yes ') -> NULL."""
    c = F.col(col)
    return df.withColumn(col, F.when(c == positive, 1).when(c == negative, 0)
                         .otherwise(F.lit(None)).cast("int"))


def decode_target(df: DataFrame, col: str = "Churn", out: str = "ChurnLabel") -> DataFrame:
    """P4 inverse: 1 -> Churned, 0 -> Retained."""
    c = F.col(col)
    return df.withColumn(out, F.when(c == 1, "Churned").when(c == 0, "Retained"))


def trim_strings(df: DataFrame) -> DataFrame:
    """P5: trim every string column, keep order and names."""
    strs = set(string_columns(df))
    return df.select(*[F.trim(F.col(c)).alias(c) if c in strs else F.col(c)
                       for c in df.columns])


def clean_subscribers(df: DataFrame, numeric_col: str = "TotalCharges",
                      target: str = "Churn", trim_first: bool = False) -> DataFrame:
    """Coerce -> dedup -> fill 0 -> encode target -> trim (reference order).

    The target is mapped before trimming, so 'Yes ' becomes NULL; duplicates are
    dropped before trimming.  ``trim_first=True`` trims first instead.
    """
    out = coerce_numeric_col(df, numeric_col)
    if trim_first:
        out = trim_strings(out)
    out = dedup_rows(out)
    out = impute_zero(out, [numeric_col])
    out = encode_target(out, target)
    if not trim_first:
        out = trim_strings(out)
    return out


def feature_columns(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Project away ids, target and leaky columns (those that exist)."""
    drop = DROP_COLS if drop is None else drop
    return df.drop(*[c for c in drop if c in df.columns])


def at_risk(df: DataFrame, prob: str = "churn_prob", thresh: float = 0.5) -> DataFrame:
    """P10: rows with ``prob >= thresh``."""
    return df.filter(F.col(prob) >= F.lit(float(thresh)))


def sample_ids(df: DataFrame, k: int = 6, seed: int = 42, id_col: str = "customerID") -> DataFrame:
    """K ids in a deterministic pseudo-random order (a sampling operator: the
    limit is the feature).  ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject,
    a per-partition top-k, not a full sort."""
    return (df.select(id_col)
            .orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col))
            .limit(k))


def customer_profile_long(df: DataFrame, columns: list[str] | None = None,
                          id_col: str = "customerID") -> DataFrame:
    """Transpose each row into (id, pos, Feature, Value) strings.

    Floats are formatted with two decimals, integers plainly, others as text.
    """
    from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType
    cols = columns or ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
                       "Contract", "InternetService", "MonthlyCharges", "TotalCharges",
                       "PaymentMethod"]
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in cols if c in types]

    def fmt(c):
        t = types[c]
        if isinstance(t, (DoubleType, FloatType)):
            # format_number rounds the exact binary value (as Python's f"{x:.2f}");
            # format_string("%.2f") rounds the shortest decimal form instead
            return F.regexp_replace(F.format_number(F.col(c), 2), ",", "")
        if isinstance(t, (IntegerType, LongType)):
            return F.col(c).cast("string")
        return F.col(c).cast("string")

    pairs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("Feature"),
                               fmt(c).alias("Value")) for i, c in enumerate(cols)])
    return (df.select(F.col(id_col), F.inline(pairs)))


#: Regex patterns without a literal run that are tested together.
REGEX_BLOCK = 256


def lookup_customer(subs: DataFrame, queries: DataFrame, q_col: str = "query",
                    id_col: str = "customerID") -> DataFrame:
    """Resolve search strings to customers.

    1. case-insensitive equality (equi-join);
    2. otherwise case-insensitive *contains*; the first match (smallest id) wins.
       Literal strings (no regex metacharacters) are matched with an equi-join
       on the id's substrings of the query's length, which scales like a hash
       join; regex patterns find their ids through trigram postings
       (``regex_index``). Only patterns without a literal run of three characters
       are tested against all ids, in blocks of patterns.

    Returns (query, customerID, match_type) for queries with a match.
    """
    q = (queries.select(F.col(q_col).alias("query")).dropDuplicates()
         .withColumn("_q", F.lower(F.trim("query"))))
    ids = subs.select(F.col(id_col).alias("_id")).withColumn("_lid", F.lower("_id"))
    exact = (q.join(ids, q._q == ids._lid)
             .groupBy("query").agg(F.min("_id").alias(id_col))
             .withColumn("match_type", F.lit("exact")))
    rest = q.join(exact.select("query"), "query", "left_anti")
    is_regex = F.col("_q").rlike(_REGEX_META)
    literal = rest.filter(~is_regex).withColumn("_len", F.length("_q"))
    # the distinct query lengths: a bounded int array bound as a scalar subquery,
    # exploded per id (only lengths that fit the id), so no theta join
    lens = scalar_struct(literal.agg(F.sort_array(F.collect_set("_len")).alias("lens")))["lens"]
    subs_ids = (ids.withColumn("_lens", lens)
                .select("_id", "_lid", F.explode(F.filter(
                    "_lens", lambda n: n <= F.length("_lid"))).alias("_len"))
                .select("_id", "_len",
                        F.explode(F.sequence(F.lit(1), F.length("_lid") - F.col("_len") + 1))
                        .alias("_start"), "_lid")
                .select("_id", "_len", F.substring(F.col("_lid"), F.col("_start"), F.col("_len"))
                        .alias("_sub"))
                # the first id per substring, aggregated map-side first: a substring
                # shared by a large share of ids becomes one row before the join
                .groupBy("_len", "_sub").agg(F.min("_id").alias("_id")))
    lit_hits = (literal.join(subs_ids, (literal._len == subs_ids._len)
                             & (literal._q == subs_ids._sub))
                .groupBy("query").agg(F.min("_id").alias(id_col)))
    regexes = with_trigrams(rest.filter(is_regex).withColumn("_pat", F.concat(F.lit("(?i)"), F.trim("query"))))
    regexes = regexes.persist(StorageLevel.MEMORY_AND_DISK)
    indexed = regexes.filter(F.size("_tris") > 0)
    pats = regexes.filter(F.size("_tris") == 0).drop("_tris")
    # Patterns are dealt into blocks of about REGEX_BLOCK; every id meets every block once
    # (an equi-join on the block) and keeps the patterns it matches. The same at every size.
    n_blocks = scalar_struct(pats.agg(F.greatest(F.ceil(F.count("query") / F.lit(REGEX_BLOCK)), F.lit(1)).alias("n")))["n"]
    blocks = (pats.withColumn("_block", F.pmod(F.xxhash64("query"), n_blocks))
              .groupBy("_block").agg(F.collect_list(F.struct("query", "_pat")).alias("_pats")))
    rx_hits = (ids.select("_id", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("_block"))
               .join(blocks, "_block")
               .select("_id", F.explode(F.filter(
                   "_pats", lambda p: F.regexp_like(F.col("_id"), p["_pat"]))).alias("_m"))
               .groupBy(F.col("_m.query").alias("query")).agg(F.min("_id").alias(id_col)))
    if not indexed.isEmpty():
        rx_hits = rx_hits.unionByName(search(ids, indexed, id_col))
    contains = lit_hits.unionByName(rx_hits).withColumn("match_type", F.lit("contains"))
    return exact.unionByName(contains)
