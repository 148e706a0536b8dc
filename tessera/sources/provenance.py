"""What a result was made from: digests of inputs, settings and code as a tree, and what differs between two runs.

Entries are ``(part, name, digest)``: a part is a kind of thing (inputs,
settings, code), a name is unique in it. Names are dealt to buckets by hash; a
bucket's digest covers its entries, a part's its buckets, and the run's all
parts. Two runs are compared from the buckets down, so entries meet only where
their buckets differ.
"""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a name's digest that say its bucket: 4096 buckets a part.
BUCKET_DIGITS = 3


def inputs(manifest: DataFrame) -> DataFrame:
    """Entries of files, as ``file_manifest`` lists them."""
    return manifest.select(F.lit("input").alias("part"), F.col("path").alias("name"), F.col("md5").alias("digest"))


def settings_and_code(spark: SparkSession, settings: dict, code: list) -> DataFrame:
    """Entries of settings by name, and of functions, classes or modules by their source."""
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    rows = [("setting", str(k), digest(json.dumps(v, sort_keys=True, default=str))) for k, v in settings.items()]
    named = lambda c: c.__name__ if inspect.ismodule(c) else f"{c.__module__}.{c.__qualname__}"
    rows += [("code", named(c), digest(inspect.getsource(c))) for c in code]
    return spark.createDataFrame(rows, "part string, name string, digest string")


def _digest(*of: str) -> Column:
    """The digest of a group's rows, in the order of their columns."""
    line = lambda x: F.concat(*[F.concat(F.length(x[c]).cast("string"), F.lit(":"), x[c]) for c in of])
    return F.md5(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(*of))), line)))


def buckets(entries: DataFrame) -> DataFrame:
    """``(part, bucket, digest)``."""
    dealt = entries.select("part", F.substring(F.md5("name"), 1, BUCKET_DIGITS).alias("bucket"), "name", "digest")
    return dealt.groupBy("part", "bucket").agg(_digest("name", "digest").alias("digest"))


def parts(entries: DataFrame) -> DataFrame:
    """``(part, digest)``: of all entries of a part, whatever their order."""
    return buckets(entries).groupBy("part").agg(_digest("bucket", "digest").alias("digest"))


def signature(entries: DataFrame) -> str:
    """The digest of a run."""
    return parts(entries).agg(_digest("part", "digest")).first()[0]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(part, name, change)`` of the entries that are ``added``, ``removed`` or ``changed``; none if the runs agree."""
    old, new = (buckets(e).select("part", "bucket", F.col("digest").alias(c)) for e, c in ((before, "_o"), (after, "_n")))
    touched = old.join(new, ["part", "bucket"], "full").where(~F.col("_o").eqNullSafe(F.col("_n"))).select("part", "bucket")
    within = lambda e, c: e.select("part", F.substring(F.md5("name"), 1, BUCKET_DIGITS).alias("bucket"), "name", F.col("digest").alias(c)).join(touched, ["part", "bucket"], "left_semi")
    both = within(before, "_o").join(within(after, "_n"), ["part", "bucket", "name"], "full").where(~F.col("_o").eqNullSafe(F.col("_n")))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return both.select("part", "name", change.alias("change"))
