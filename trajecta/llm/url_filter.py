"""URL filters: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

Every url is cut into candidate keys (each host suffix with each listed path length). The keys are tested against a
blocked Bloom filter of the listed canonical URLs; only possible hits reach the exact join, which removes the false
positives. The filter's size is bounded by a parameter, whatever the length of the list, so it can be broadcast: a
longer list only lets more false positives through to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.bloom import HIT, MAX_BYTES, block_and_masks, blocks_for, bloom_table
from trajecta.llm.common import lower_ascii, shielded, with_outputs

#: (verdict, host and path) of the production list.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``. Both empty if url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")


@shielded
def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits_per_key: int = 16, max_filter_bytes: int = MAX_BYTES) -> DataFrame:
    """df with host, path, rule and verdict.

    rules: verdict and rule (host and path in one string, host up to the first ``/``; hosts are lower-cased A-Z, null
    rules are ignored, of equal rules ``block`` wins over ``allow``). A rule fits its host and all subdomains if the path
    starts with the rule's path; the longest fitting rule wins (ties: the smaller string). Without one, rule is null and
    verdict is ``default``. Null, empty or odd urls have an empty host and path and fit no rule; an empty list gives every
    row the default. Repeated rows stay repeated; input columns named host, path, rule or verdict are replaced.
    max_filter_bytes bounds the broadcast filter.
    """
    slash = F.instr("rule", "/")
    split = F.when(slash > 0, slash).otherwise(F.length("rule") + 1)
    listed = (
        rules.where("rule is not null")
        .select("verdict", lower_ascii(F.substring("rule", F.lit(1), split - 1)).alias("__h"), F.substring("rule", split, F.length("rule")).alias("__p"))
        .groupBy(F.concat("__h", "__p").alias("rule"), F.length("__p").alias("__len"))
        .agg(F.max("verdict").alias("verdict"))
    )
    head = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("__len")).alias("lens")).first()
    n_blocks = blocks_for(head["n"], bits_per_key, max_filter_bytes)
    host, path = host_and_path(F.col(url))
    judged = with_outputs(df.withColumns({"__host": host, "__path": path}), ["host", "path", "rule", "verdict"])

    pairs = judged.select("__host", "__path").where("__host <> ''").distinct()
    lens = F.array(*[F.lit(n) for n in head["lens"]]).cast("array<int>")
    labels = F.split("__host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lens, lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probes = pairs.select("__host", "__path", F.explode(keys).alias("__key")).select("*", *block_and_masks([F.col("__key")], n_blocks))
    bits = bloom_table(listed, ["rule"], n_blocks)  # at most n_blocks rows of 40 bytes: max_filter_bytes bounds it
    possible = probes.join(F.broadcast(bits), "__block").where(HIT).select("__host", "__path", "__key")
    exact = possible.join(listed.select(F.col("rule").alias("__key"), "verdict"), "__key")
    best = exact.groupBy("__host", "__path").agg(F.min(F.struct((-F.length("__key")).alias("o"), F.col("__key").alias("rule"), F.col("verdict"))).alias("__best"))
    hostless = judged.where("__host = ''").withColumn("__best", F.lit(None).cast(best.schema["__best"].dataType))  # these fit no rule: they stay out of the join
    out = judged.where("__host <> ''").join(best, ["__host", "__path"], "left").unionByName(hostless)
    kept = [F.col(c) for c in judged.columns if c not in ("__host", "__path")]
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
with r(verdict, rule) as (values ('allow','com/'),('block','example.com/en/'),('allow','www.example.com/en/'),('block','net/es/'),('block','net/fr/')),
rules as (select verdict, rule, substr(rule, 1, instr(rule,'/')-1) as rh, substr(rule, instr(rule,'/')) as rp from r),
rest as (select page_id, case when instr(url,'://') > 0 then substr(url, instr(url,'://')+3) else '' end as s from pages),
hp as (select page_id, regexp_extract(s, '^[^/?#]*') as h0, s from rest),
parts as (select page_id, translate(h0,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(s, length(h0)+1), '^[^?#]*') as path from hp),
pairs as (select distinct host, path from parts),
best as (select host, path, arg_min(rule, (-length(rule), rule)) as rule, arg_min(verdict, (-length(rule), rule)) as verdict
         from pairs join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) where host <> '' group by host, path)
select page_id, parts.host, parts.path, best.rule, coalesce(best.verdict, 'allow') as verdict
from parts left join best on parts.host = best.host and parts.path = best.path
"""
