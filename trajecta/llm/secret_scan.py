"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once. The digests of all candidates are counted over the corpus by distinct owners (sources) and
repositories (documents). A value that many owners hold is a widely copied example; one that stays with few owners looks
live. Base spans always stay; generic tokens of high variety become spans of their own only if they are owner-specific.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import checkpoint, map_batches, shielded, table, with_outputs, written

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # leftmost runs: the same as [0-9a-f]+ of 16 and more
GENERIC = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
KEYWORDS = re.compile(r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR]|[tT][oO][kK][eE]|[aA][pP][iI]_?[kK]")
KINDS = ("assign", "access", "hex", "generic")
SPAN = "struct<start:int,stop:int,kind:int,value:long>"


def _digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base patterns by start, then kind; offsets in code points."""
    out = []
    if KEYWORDS.search(text):
        out += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def generic_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens that mix digits with letters of both cases and touch no base span."""
    out = []
    for m in GENERIC.finditer(text):
        v = m[0]
        if sum(c.isdigit() for c in v) >= 3 and any(c.islower() for c in v) and any(c.isupper() for c in v) and len(set(v)) >= 10:
            if not any(s < m.end() and m.start() < e for s, e, _, _ in base):
                out.append((m.start(), m.end(), 3, v))
    return out


def scan(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with __spans: all candidates (start, stop, kind, digest of the value), and __text_key, the text's digest (null without candidates)."""
    fields = [f for f in df.schema.fields if f.name != text]
    fields += [df.schema[text]] * keep_text
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__text_key binary", f"__spans array<{SPAN}>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, spans = [], []
        for t in b.column(b.num_columns - 1):
            t = t.as_py() or ""
            base = base_spans(t)
            found = base + generic_spans(t, base)
            spans.append([{"start": s, "stop": e, "kind": k, "value": _digest(v)} for s, e, k, v in sorted(found)])
            keys.append(blake2b(t.encode(), digest_size=16).digest() if found else None)
        return pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.array(keys, pa.binary()), pa.array(spans, kind)], [f.name for f in fields] + ["__text_key", "__spans"])

    return map_batches(df.select(*[f"`{f.name}`" for f in df.schema.fields if f.name != text], f"`{text}`"), run, schema)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """For each candidate digest: number of distinct owners and repositories. Both counts add up partial ones, so a value that a third of all rows hold needs no large task."""
    each = found.select(F.explode("__spans.value").alias("value"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    by_repository = each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def judge(hits: DataFrame, repository: str, owner: str, max_owners: int, max_repositories: int | None) -> DataFrame:
    """__text_key and __all: for each text with candidates, its spans (start, kind, stop, live) in order."""
    counts = ownership(hits, repository, owner)
    bounded = F.lit(True) if max_repositories is None else F.col("repositories") <= max_repositories
    live = counts.where((F.col("owners") <= max_owners) & bounded).select("value", F.lit(True).alias("live"))
    per_text = hits.groupBy("__text_key").agg(F.first("__spans").alias("__spans"))  # equal texts have equal spans
    marked = per_text.select("__text_key", F.explode("__spans").alias("s")).select("__text_key", "s", F.col("s.value").alias("value")).join(live, "value", "left")
    return marked.groupBy("__text_key").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.stop", F.coalesce("live", F.lit(False)).alias("live")))).alias("__all"))


@shielded
def find_secrets(df: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int | None = None) -> DataFrame:
    """df without its text, with n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared and live_spans.

    live_spans (array of start, stop) are the spans of values that at most max_owners owners hold, in however many of
    their documents; max_repositories, if given, bounds these too. n_live counts them, and n_shared the others, which are widely copied examples. spans holds the base
    spans and the live generic ones. A null owner or repository counts as one of its own; null and empty texts have no
    spans (empty string, its digest). Rows that repeat get the same result. Input columns with the names of outputs are
    replaced. Texts are scanned whole, however long; an empty table gives an empty result. max_owners is a number, and not a
    share: in a table of max_owners owners or fewer nothing counts as shared.
    """
    outputs = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared", "live_spans"]
    scanned = checkpoint(scan(with_outputs(df, outputs), text))  # a few bytes a document: texts are read once
    hits, rest = scanned.where("__text_key is not null"), scanned.where("__text_key is null")
    judged = hits.join(judge(hits, repository, owner, max_owners, max_repositories), "__text_key", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,live:boolean>>)")
    columns = [F.col(c) for c in scanned.columns if not c.startswith("__")]
    every = judged.select(*columns, "__all").unionByName(rest.select(*columns, none.alias("__all")))  # rows without candidates are not shuffled
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("__all", test)).cast("long")

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == k

    return every.select(
        *columns,
        *[number(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.filter("__all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.filter("__all", lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"),
        number(lambda s: ~s["live"]).alias("n_shared"),
        F.transform(F.filter("__all", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("live_spans"),
    )


@shielded
def redact_live(df: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", mask: str = "[SECRET]", max_owners: int = 2, max_repositories: int | None = None) -> DataFrame:
    """df with the spans of live-looking values in its texts replaced by mask (touching spans by one); every row stays, examples too.

    Nulls stay null; rows without such spans are unchanged. n_chars, if there, follows the new text.
    """
    scanned = written(scan(df, text, keep_text=True))
    hits, rest = scanned.where("__text_key is not null"), scanned.where("__text_key is null")
    narrow = hits.select("__text_key", "__spans", F.col(repository), F.col(owner))
    judged = hits.join(judge(narrow, repository, owner, max_owners, max_repositories), "__text_key", "left")
    spans = F.transform(F.filter("__all", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    others = [f.name for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{n}` {df.schema[n].dataType.simpleString()}" for n in others] + [f"`{text}` string"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, found in zip(b.column(len(others)), b.column(len(others) + 1), strict=True):
            t, parts, at = t.as_py(), [], 0
            for s in found.as_py():
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mask]
                at = max(at, s["stop"])
            out.append("".join([*parts, t[at:]]))
        return pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(out, pa.string())], [*others, text])

    changed = map_batches(judged.select(*others, text, spans.alias("__live")), run, schema)
    out = changed.unionByName(rest.select(*others, text))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared")
