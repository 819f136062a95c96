"""Operator 2: language identification by fusing Bayesian evidence.

log P(l | all) = tempered log-likelihood of the text's byte trigrams under l  (learned from every labelled row by grouped counts)
             + log P(declared language | l)                                  (reliability of the mark-up, measured on the corpus)
             + log prior of l at the host                                    (host counts smoothed by the suffix's, those by all)

Host and suffix priors are sums of the text-only posteriors of the other documents there.

Defined cases: a null or letterless text has no text evidence and is rejected (``lang`` ``und``); a null declaration, host or suffix
adds no evidence of that kind, nor does a declaration that is not one of the ``MAX_LANGUAGES`` labels with most rows (of equal ones those that
sort first): it counts as undeclared and its row gets a result from the rest; ties go to the language that sorts first; without any labelled row everything is ``und``;
ids may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import cut, hot_join

BUCKETS = 1 << 16  #: hashed byte trigrams
MAX_LANGUAGES = 256  #: labels that are languages; the others have too little support and count as undeclared
SMOOTH = 0.5  #: added to each trigram count
TEMPER = 0.05  #: neighbouring trigrams are far from independent
PRIOR_ROWS = 20.0  #: rows that the next wider prior counts as
ACCEPT = 0.5  #: least posterior of an accepted document


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams of a text, ASCII letters in lower case."""
    a = np.frombuffer(b" " + raw.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letters(s: str | None) -> bool:
    return bool(s) and any(c.isalpha() for c in s)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood table, from the trigram counts of all labelled rows.

    Each task adds up its rows, so at most ``BUCKETS`` rows a language leave it and reach the driver.
    """
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    top = [r["label"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES).collect()]
    rows = rows.where(F.col("label").isin(top))
    schema = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if label not in sums:
                    sums[label] = np.zeros(BUCKETS, dtype=np.int64)
                sums[label] += np.bincount(trigrams(value.as_py().encode()), minlength=BUCKETS)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], schema=schema)

    counts = rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.full((BUCKETS, len(languages)), SMOOTH)
    for k, language in enumerate(languages):
        own = counts[counts["label"] == language]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(docs: DataFrame, table: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and with ``text_post``: the posterior from the text alone (null where it has no letters)."""
    width = table.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages at most

    @F.pandas_udf("array<double>")
    def score(texts):  # noqa: ANN001, ANN202
        out = []
        for s in texts:
            if not width or not has_letters(s):
                out.append(None)
                continue
            x = shared.value[trigrams(s.encode())].sum(axis=0, dtype=np.float64) * TEMPER
            x = np.exp(x - x.max())
            out.append(x / x.sum())
        import pandas as pd

        return pd.Series(out, dtype=object)

    return docs.withColumn("text_post", score(F.col(text_col))).drop(text_col)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def summed(post: Column, width: int) -> list[Column]:
    return [F.sum(post[k]).alias(f"_p{k}") for k in range(width)]


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, keys: list[str], declared: str | None = None, host: str | None = None,
             suffix: str | None = None, text_col: str = "text") -> DataFrame:
    """``keys`` and ``lang``, ``posterior``, ``accepted``, ``text_lang`` for every row of ``docs``.

    ``declared``, ``host`` and ``suffix`` name the columns of the declared language, the host and its address suffix.
    """
    width = len(languages)
    if not width:
        none = F.lit(None).cast("string")
        return docs.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"), none.alias("text_lang"))
    column = lambda name: F.col(name).cast("string") if name else F.lit(None).cast("string")
    narrow = docs.select(*keys, column(declared).alias("_declared"), F.coalesce(column(host), F.lit("")).alias("_host"), column(suffix).alias("_suffix"), F.col(text_col).alias("_text"))
    scored = cut(text_scores(narrow, table, "_text"), "language")
    best = lambda post: F.array_position(post, F.array_max(post)).cast("int")
    known = scored.where("text_post is not null")

    names = F.array(*map(F.lit, languages))
    agree = known.where(F.col("_declared").isin(languages)).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.element_at(names, best(F.col("text_post"))) == F.col("_declared")).cast("int")).alias("k")
    )
    seen = agree.first()
    trust = ((seen["k"] or 0) + 1.0) / (seen["n"] + 2.0)
    everywhere = known.agg(F.count(F.lit(1)).alias("n"), *summed(F.col("text_post"), width)).first()
    total = [(everywhere[f"_p{k}"] or 0.0) + 1.0 for k in range(width)]
    base = [x / sum(total) for x in total]

    def prior(post: Column, wider: Column) -> Column:
        n = F.array(F.aggregate(post, F.lit(0.0), lambda s, x: s + x))  # added up once a row, not once an element
        return F.transform(n, lambda n: F.zip_with(post, wider, lambda p, w: (p + PRIOR_ROWS * w) / (n + PRIOR_ROWS)))[0]

    sums = F.array(*[F.sum(F.col("text_post")[k]) for k in range(width)])
    base, zeros = F.array(*map(F.lit, base)), F.array(*[F.lit(0.0)] * width)
    by_suffix = known.groupBy("_suffix").agg(sums.alias("_sums"))
    suffix_prior = by_suffix.select("_suffix", prior(F.col("_sums"), base).alias("_wide"))
    by_host = known.groupBy("_host").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_suffix").alias("_suffix"), sums.alias("_sums")
    )
    hosts = cut(by_host.where("_host <> ''").join(suffix_prior, "_suffix", "left").drop("_suffix"), "hosts")
    joined = hot_join(scored, hosts, "_host", "_rows", "left")
    post = F.col("text_post")
    others = F.zip_with(F.coalesce("_sums", zeros), F.coalesce(post, zeros), lambda s, p: F.greatest(s - p, F.lit(0.0)))
    evidence = F.transform(prior(others, F.coalesce("_wide", base)), lambda x: F.log(x))
    evidence = added(evidence, F.coalesce(F.transform(post, lambda x: F.log(F.greatest(x, F.lit(1e-300)))), zeros))
    miss = math.log(max((1 - trust) / max(1, width - 1), 1e-9))
    marked = F.array(*[F.when(F.col("_declared") == name, math.log(trust)).otherwise(miss) for name in languages])
    evidence = F.when(F.col("_declared").isin(languages), added(evidence, marked)).otherwise(evidence)
    top = F.array_max("_e")
    weight = F.aggregate(F.transform("_e", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    out = joined.withColumn("_e", evidence).withColumn("posterior", F.lit(1.0) / weight)
    out = out.withColumn("accepted", post.isNotNull() & (F.col("posterior") >= ACCEPT))
    return out.select(
        *keys,
        F.when(post.isNull(), "und").otherwise(F.element_at(names, best(F.col("_e")))).alias("lang"),
        F.when(post.isNull(), 0.0).otherwise(F.col("posterior")).alias("posterior"),
        "accepted",
        F.element_at(names, best(post)).alias("text_lang"),
    )


def identify_documents(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents: declared language ``lang``, host ``source`` (its name without digits stands for the suffix)."""
    languages, table = fit(docs, "text", "lang")
    rows = docs.withColumn("_sfx", F.regexp_replace("source", r"\d+$", ""))
    return identify(rows, languages, table, keys, "lang", "source", "_sfx")


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_id``, visible ``text``, ``declared`` (lang attribute of the mark-up), ``host`` and ``suffix`` of the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), bare.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"),
                        blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages: evidence from text, mark-up and address; the declarations also serve as (noisy) labels."""
    rows = page_evidence(pages)
    languages, table = fit(rows, "text", "declared")
    return identify(rows, languages, table, ["page_id"], "declared", "host", "suffix")
