"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram binds the vectors of its letters, each
rolled by its place, by multiplication; a text bundles (sums) the vectors of its n-grams, and a language those of its
training texts. A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, map_batches, table, with_outputs

DIM, GRAM, UND = 1024, 3, "und"
CHUNK_CHARS, CHUNK_DOCS, GRAM_BLOCK = 1 << 18, 64, 2048
ONE = 1 << 20  # prototypes are summed in whole numbers, so that their order does not matter


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, DIM, dtype=np.int8)
    return bits * 2 - 1


def _codes(text: str) -> np.ndarray:
    """Lower-case letters, each run of other characters one 0, with a 0 at either end; empty without letters."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[raw], raw, 0)
    codes = np.concatenate(([0], codes, [0]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return codes.astype(np.int64) if len(codes) > 1 else codes[:0].astype(np.int64)


def _grams(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points), and for each place in the text its document and n-gram number."""
    alphabet, small = np.unique(codes, return_inverse=True)
    n = len(codes) - GRAM + 1
    same = doc[:n] == doc[GRAM - 1 :]
    key = np.zeros(n, np.int64)
    for k in range(GRAM):
        key = key * len(alphabet) + small[k : k + n]
    key, where = key[same], doc[:n][same]
    cells = len(alphabet) ** GRAM
    if cells <= 1 << 22:
        present = np.zeros(cells, bool)
        present[key] = True
        distinct = np.flatnonzero(present)
        number = np.zeros(cells, np.int32)
        number[distinct] = np.arange(len(distinct), dtype=np.int32)
        gram = number[key]
    else:
        distinct, gram = np.unique(key, return_inverse=True)
    parts = []
    for _ in range(GRAM):
        distinct, r = np.divmod(distinct, len(alphabet))
        parts.append(alphabet[r])
    return np.stack(parts[::-1], axis=1), where, gram


def profiles(texts: list[str]) -> np.ndarray:
    """A row for each text: the sum of the vectors of its n-grams (zero without letters)."""
    out = np.zeros((len(texts), DIM), np.float32)
    start = 0
    while start < len(texts):
        stop, size, codes = start, 0, []
        while stop < len(texts) and stop - start < CHUNK_DOCS and (size < CHUNK_CHARS or stop == start):
            codes.append(_codes(texts[stop]))
            size += len(codes[-1])
            stop += 1
        if size:
            grams, where, number = _grams(np.concatenate(codes), np.repeat(np.arange(stop - start), [len(c) for c in codes]))
            letters, spot = np.unique(grams, return_inverse=True)
            spot = spot.reshape(grams.shape)
            base = np.stack([letter_vector(int(c)) for c in letters])
            rolled = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
            counts = np.bincount(where * len(grams) + number, minlength=(stop - start) * len(grams)).reshape(stop - start, len(grams)).astype(np.float32)
            for a in range(0, len(grams), GRAM_BLOCK):
                bound = rolled[0][spot[a : a + GRAM_BLOCK, 0]]
                for k in range(1, GRAM):
                    bound = bound * rolled[k][spot[a : a + GRAM_BLOCK, k]]
                out[start:stop] += counts[:, a : a + GRAM_BLOCK] @ bound.astype(np.float32)
        start = stop
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def chance(n_languages: int, alpha: float = 1e-2) -> float:
    """The cosine that the nearest of so many prototypes exceeds by chance with probability alpha at most (each is about normal, with deviation DIM ** -0.5)."""
    return math.sqrt(2 * math.log(max(1, n_languages) / alpha) / DIM)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_language: int = 2000, max_languages: int = 1024) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes (a row each), from documents with a language that are not held out.

    A bounded sample is enough to fit the prototypes: of each language about docs_per_language documents, picked by the
    hash of their id. More than max_languages languages are an error; without any, the result is empty.
    """
    train = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    counts = train.groupBy(lang).agg(F.count("*").alias("n")).orderBy(lang).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    names = [r[0] for r in counts]
    share = df.sparkSession.createDataFrame([(r[0], min(1_000_000, 1_000_000 * docs_per_language // r["n"] + 1), i) for i, r in enumerate(counts)], "__lang string, __share long, __number int")
    picked = train.select(text, F.col(lang).alias("__lang"), F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)).alias("__at")).join(F.broadcast(share), "__lang").where("__at < __share").select("__number", text)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), DIM), np.int64)
        for b in batches:
            rows = np.rint(_unit(profiles(b.column(1).to_pylist())) * ONE).astype(np.int64)
            np.add.at(sums, b.column(0).to_numpy(), rows)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, DIM).astype(np.int32)), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(used))), pa.array(sums[used].ravel())], ["number", "at", "v"])

    cells = arrow_map(picked, bundle, "number int, at int, v long").groupBy("number", "at").agg(F.sum("v").alias("v")).collect()  # languages x DIM
    prototypes = np.zeros((len(names), DIM))
    for number, at, v in cells:
        prototypes[number, at] = v
    return names, _unit(prototypes).astype(np.float32)


def identify(df: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with lang_pred and score (the cosine, at least 0), and without its text unless keep_text.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if there are no prototypes; of equal
    cosines the first language in order wins. Whole texts count; repeated rows get the same result. Input columns named
    lang_pred or score are replaced.
    """
    df = with_outputs(df, ["lang_pred", "score"])
    fields = [f for f in df.schema.fields if f.name != text]
    kept = [*fields, *[df.schema[text]] * keep_text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = profiles([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
        seen = rows.any(axis=1)
        if len(names):
            cosine = _unit(rows) @ prototypes.T.astype(np.float64)
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
        else:
            seen[:], best, score = False, np.zeros(len(rows), int), np.zeros(len(rows))
        pred = [names[i] if ok else UND for i, ok in zip(best, seen, strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(np.where(seen, score, 0.0), pa.float64())], [f.name for f in kept] + ["lang_pred", "score"])

    return map_batches(df.select(*[f"`{f.name}`" for f in fields], f"`{text}`"), run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), names, prototypes)
