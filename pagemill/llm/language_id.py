"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined for every row: the likelihood of its text under byte trigram models,
the language its markup declares, the suffix of its address, and a prior of its host. The trigram
models are trained on all rows by their declared language. How far a declaration or a suffix can be trusted is
learned from the data: soft counts of the text-only posteriors against each declared value or suffix give
``P(value | language)``. Host priors are smoothed up a hierarchy: a host's counts are drawn towards its parent
domain's, those towards the whole corpus; the row's own share is taken out first. All these counts are
grouped aggregations, so that a host with a third of all rows is no one's task.

A further class, ``und``, explains text as noise over all trigrams. A row is kept if some language explains it
better than noise and than the other languages together.

Text evidence is tempered by ``TEMPER``, as overlapping trigrams say the same thing several times.

Defined results: text that is null or has no letters has no text evidence, gets the most likely language of the
other evidence and is not kept; null or unseen declarations, suffixes and hosts are no evidence; ties go to the first
language by name; repeated rows give repeated results; long texts count whole; other columns, whatever their names, don't matter; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import raw_texts, slices, small, staged, unused

LANGUAGES = ("de", "en", "es", "fr")
BINS_BITS = 14
SMOOTHING = 0.5
TEMPER = 1 / 3
#: Strength, in rows, of a parent's prior for a host; pseudo-count of each declared value or suffix.
KAPPA, PSEUDO = 20.0, 1.0
#: Prior share of text that is in none of the languages.
NOISE = 0.01
LEAST_POSTERIOR = 0.5

#: By rule: ASCII letters in lower case, other ASCII as a space; bytes of other characters as they are.
_PLAIN = np.array([i | 32 if chr(i).isascii() and chr(i).isalpha() else 32 if i < 128 else i for i in range(256)], np.uint32)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, row)`` of every byte trigram that has a letter and lies within one row."""
    plain = _PLAIN[data]
    if len(plain) < 3:
        return np.array([], np.int64), np.array([], np.int64)
    key = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    inside = np.ones(len(key), bool)
    across = np.concatenate((at[1:] - 1, at[1:] - 2))
    inside[across[(across >= 0) & (across < len(key))]] = False
    inside &= key != 0x202020
    places = np.flatnonzero(inside)
    bins = (key[places] * np.uint32(2654435761)) >> np.uint32(32 - BINS_BITS)
    return bins.astype(np.int64), np.searchsorted(at, places, side="right") - 1


def trained(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log-probabilities ``[language, bin]`` from all rows (``text``, ``declared``); the last row is noise, uniform over the bins.

    Each task adds up its own counts; what meets is one count for each language and bin and task.
    """
    code, bins = {x: i for i, x in enumerate(languages)}, 1 << BINS_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(code) * bins, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                which = np.array([code[x] for x in part.column("declared").to_pylist()], np.int64)
                found, row = trigrams(*raw_texts(part.column("text")))
                total += np.bincount(which[row] * bins + found, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    known = rows.filter(F.col("declared").isin(*languages)).select("text", "declared")
    counts = np.full(len(code) * bins, SMOOTHING)
    for at, n in known.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():  # at most languages x bins rows
        counts[at] += n
    counts = counts.reshape(-1, bins)
    return np.concatenate((np.log(counts / counts.sum(1, keepdims=True)), np.full((1, bins), -np.log(bins))))


def with_likelihoods(rows: DataFrame, model: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, ``n_grams``, ``loglik`` (a tempered log-likelihood for each row of the model, relative to the best)
    and ``heard``, the languages' probabilities by text alone (all 0 without trigrams)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, row = trigrams(*raw_texts(part.column("text")))
                n = np.bincount(row, minlength=part.num_rows)
                like = np.stack([np.bincount(row, weights=t[found], minlength=part.num_rows) for t in tables], 1) * TEMPER
                like -= like.max(1, keepdims=True)
                heard = np.exp(like[:, :-1] - like[:, :-1].max(1, keepdims=True)) * (n > 0)[:, None]
                heard /= np.maximum(heard.sum(1, keepdims=True), 1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (like, heard)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n), *lists], names=[*keep, "n_grams", "loglik", "heard"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, n_grams bigint, loglik array<double>, heard array<double>")


def identify(rows: DataFrame, keep: Sequence[str], languages: Sequence[str] = LANGUAGES, kappa: float = KAPPA, noise: float = NOISE) -> DataFrame:
    """``keep`` columns with ``language, posterior, text_language, n_grams, kept``.

    ``rows`` has ``text, declared, suffix, host, parent`` (strings, any may be null) besides ``keep``.
    """
    model = trained(rows, languages)
    wanted = list(dict.fromkeys([*keep, "declared", "suffix", "host", "parent"]))
    k = range(len(languages))
    scored = with_likelihoods(rows, model, wanted)
    scored = staged(scored.select("*", *(F.col("heard")[i].alias(f"p{i}") for i in k), (F.col("n_grams") > 0).cast("double").alias("one")), "languages")
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in k] + [F.sum("one").alias("n")]
    everyone = scored.agg(*sums).first()
    n = everyone["n"] or 0.0
    share = [((everyone[f"s{i}"] or 0.0) + 1) / (n + len(languages)) for i in k]

    def soft_counts(column: str) -> DataFrame:
        """Sums of the text-only posteriors by each value of a column."""
        return staged(scored.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"{column}_key")).agg(*(s for s in sums)).toDF(f"{column}_key", *(f"{column}_{i}" for i in k), f"{column}_n"), column)

    fused = scored
    parts: list[list[Column]] = []
    for column in ("declared", "suffix"):
        table = soft_counts(column)
        values = table.count()
        given = [(F.col(f"{column}_{i}") + PSEUDO * share[i]) / ((everyone[f"s{i}"] or 0.0) + PSEUDO * share[i] * max(values, 1)) for i in k]
        given.append((F.col(f"{column}_n") + PSEUDO) / (n + PSEUDO * max(values, 1)))
        told = table.select(f"{column}_key", *(F.log(g).alias(f"{column}_l{i}") for i, g in enumerate(given)))
        fused = fused.join(small(told), F.col(column) == F.col(f"{column}_key"), "left")
        parts.append([F.coalesce(F.col(f"{column}_l{i}"), F.lit(0.0)) for i in range(len(languages) + 1)])
    for column in ("parent", "host"):
        fused = fused.join(small(soft_counts(column)), F.col(column) == F.col(f"{column}_key"), "left")
    drawn: list[Column] = [F.lit(s) for s in share]
    for column in ("parent", "host"):
        others = F.greatest(F.coalesce(F.col(f"{column}_n"), F.col("one")) - F.col("one"), F.lit(0.0))
        drawn = [(F.greatest(F.coalesce(F.col(f"{column}_{i}"), F.col(f"p{i}")) - F.col(f"p{i}"), F.lit(0.0)) + kappa * drawn[i]) / (others + kappa) for i in k]
    prior = [F.log(d * (1 - noise)) for d in drawn] + [F.log(F.lit(noise))]
    logs = [F.col("loglik")[i] + parts[0][i] + parts[1][i] + prior[i] for i in range(len(languages) + 1)]
    logged = fused.withColumn("logs", F.array(*logs))
    top = F.array_max("logs")
    best = F.array_position("logs", top).cast("int")
    # The best has weight 1 among the weights relative to it.
    posterior = 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    names = F.array(*(F.lit(x) for x in (*languages, "und")))
    return logged.select(
        *keep,
        F.element_at(names, best).alias("language"),
        posterior.alias("posterior"),
        F.when(F.col("n_grams") > 0, F.element_at(names, F.array_position("heard", F.array_max("heard")).cast("int"))).alias("text_language"),
        "n_grams",
        ((F.col("n_grams") > 0) & (best <= len(languages)) & (posterior >= LEAST_POSTERIOR)).alias("kept"),
    )


def content(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes, of one and the same content: doc_id, text, lang and source, nulls told apart from everything else."""
    own = [F.col("doc_id").cast("string"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")]
    own += [F.isnull(c) for c in own]
    return [F.xxhash64(F.lit(i), *own) for i in (1, 2)]


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as evidence: ``lang`` is what they declare, ``source`` their host. If the source is a host name, its last label is the suffix
    and what follows its first label the parent; else the parent is the source without digits at its end. ``key, other_key`` name a row by its content."""
    source = F.col("source").cast("string")
    dotted = source.contains(".")
    key, other = content(docs)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), other.alias("other_key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"),
        F.when(dotted, F.element_at(F.split(source, r"\."), -1)).alias("suffix"), source.alias("host"),
        F.when(dotted, F.regexp_extract(source, r"^[^.]*\.(.*)$", 1)).otherwise(F.regexp_replace(source, r"[0-9]+$", "")).alias("parent"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as evidence: text without markup, the ``lang`` of ``<html>``, the last label of the host, the host and its domain."""
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    named = F.coalesce(host != "", F.lit(False))
    shown = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    told = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), shown.alias("text"), F.when(told != "", told).alias("declared"), F.when(named, F.element_at(labels, -1)).alias("suffix"),
        F.when(named, host).alias("host"), F.when(named, F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")).alias("parent"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, with their own columns. Rejected ones are named by two hashes of their content."""
    one, two = unused(docs.columns, "key", "other_key")
    verdicts = identify(of_documents(docs), ["key", "other_key"])
    rejected = staged(verdicts.filter(~F.col("kept")).select(F.col("key").alias(one), F.col("other_key").alias(two)).distinct(), "rejected")
    key, other = content(docs)
    return docs.join(small(rejected), (key == F.col(one)) & (other == F.col(two)), "left_anti")
