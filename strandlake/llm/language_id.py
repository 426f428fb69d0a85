"""Language identification by fusing evidence: text, declared markup language, address suffix and host.

* Text: the mean log likelihood of hashed letter trigrams under each language, counted as at most ``TEXT_WEIGHT``
  independent observations. The trigram tables are fitted on a bounded sample of labelled rows (``train_rows`` of smallest
  doc_id hash); whole texts are scored.
* Declared language (a code of two or three letters) and address suffix (a host's last label, of any length): P(value |
  language), from grouped sums of the text posteriors over all rows.
* Host: P(language | host), shrunk to its domain's, which is shrunk to that of all rows; each is a grouped sum of text
  posteriors.

All sums are aggregated before they are shuffled, and the tables of up to SENT_VALUES values are sent to all executors; larger
ones are joined with both sides dealt out by value and a salt of SALTS. So a host with a third of all rows is no hot spot.

Text in none of the languages is told by the mean log likelihood of its trigrams under the mixture of all languages, trigram
by trigram, so that documents of several languages have no less than others. The class it is held against, with a prior of
``OTHER``, has the likelihood of a uniform one over the buckets, or of the lowest thousandth of the labelled rows, each under the
tables without itself, if that is less. With fewer than ``LABELLED_ROWS`` of them, trigrams that they lack say nothing, and no
text is told. Only ``accepted`` uses this; it takes no label of the rows that it decides on as evidence.

The posterior is the normalised product; of languages with the same one the first by name is taken. Labels are what the training rows have; a row without a single letter trigram
has no text evidence and is left to the rest.

Cases: null and empty texts, null hosts, suffixes and declarations are missing evidence. Rows are independent; repeated
ones get equal results. Without labelled rows there is no language: it is null with posterior 0. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut

BUCKETS = 1 << 16
TEXT_WEIGHT = 30.0
#: Pseudo-counts: of a domain's host, of all rows' domain, and of each value of a declaration or suffix.
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 10.0, 10.0, 1.0
#: The prior of text in none of the languages, and the labelled rows from which it is told.
OTHER, LABELLED_ROWS = 0.01, 100

#: Values of a table that are sent to all executors at most, and shares of a value's rows beyond that.
SENT_VALUES, SALTS = 200_000, 16

OPENING = re.compile(r"(?i)<(?:(script|style)\b|(!--))")
CLOSING = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), "!--": re.compile("-->")}


def plain(source: str | None) -> str:
    """The text of an HTML page: without tags, comments, scripts and styles; time grows with its length, whatever is left open."""
    source, out, at, lacking = source or "", [], 0, set()
    while (i := source.find("<", at)) >= 0:
        out.append(source[at:i])
        end = None
        if (m := OPENING.match(source, i)) and (kind := (m[1] or m[2]).lower()) not in lacking:
            if not (end := CLOSING[kind].search(source, m.end())):
                lacking.add(kind)  # there is none behind here either
        stop = end.end() if end else source.find(">", i) + 1
        if not stop:
            at = i
            break
        out.append(" ")
        at = stop
    return html.unescape("".join(out) + source[at:])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of lower-cased letters, a space for each run of anything else."""
    letters = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not letters:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


def other_likelihood(rows: list[tuple[int, np.ndarray]], counts: np.ndarray) -> float:
    """The mean log likelihood of text in no language, from the labelled rows (language, trigrams) and the sums of their trigrams."""
    if len(rows) < LABELLED_ROWS:
        return -np.inf
    totals, found = counts.sum(axis=1) + 0.1 * BUCKETS, []
    for k, grams in rows:
        own, n = np.unique(grams, return_counts=True)
        left, total = counts[:, own] + 0.1, totals.copy()
        left[k] -= n
        total[k] -= len(grams)
        found.append((np.log((left / total[:, None]).mean(axis=0)) * n).sum() / len(grams))
    return float(min(-np.log(BUCKETS), np.quantile(found, 0.001)))


def fit(labelled: DataFrame, train_rows: int = 4000) -> tuple[list[str], np.ndarray, float]:
    """(languages, log P(trigram | language), ``other_likelihood``) from a bounded sample of labelled rows (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    chosen = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()]
    languages, counts, used = [], [], []
    if chosen:
        for text, lang in rows.where(F.col("doc_id").isin(chosen)).select("text", "lang").limit(train_rows).toLocalIterator():
            if lang not in languages:
                languages.append(lang)
                counts.append(np.zeros(BUCKETS))
            grams = trigrams(text)
            counts[languages.index(lang)] += np.bincount(grams, minlength=BUCKETS)
            if len(grams):
                used.append((languages.index(lang), grams.astype(np.uint16)))
    order = sorted(range(len(languages)), key=languages.__getitem__)
    table = np.array([counts[i] for i in order]).reshape(len(order), BUCKETS) + 0.1
    return [languages[i] for i in order], np.log(table / table.sum(axis=1, keepdims=True)), other_likelihood(used, np.array(counts))


def code(value):
    """A language or country code column: its first two or three letters before anything else, null if it has none."""
    found = F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2,3})(?![a-z])", 1)
    return F.when(found != "", found)


def last_label(value):
    """An address suffix column: one label in lower case, null if it is none."""
    label = F.lower(F.trim(value))
    return F.when(label.rlike("^[a-z0-9-]{1,63}$"), label)


def domain(host):
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def scored(rows: DataFrame, model: tuple[list[str], np.ndarray, float], markup: bool) -> DataFrame:
    """``rows`` (id, host, suffix, declared, text) with text_ll array<double> and other instead of the text; null without letters.

    other: log likelihood of the text in no language, less that in the mixture of all.
    """
    languages, table, none = model
    mixture = np.log(np.exp(table).mean(axis=0)) if languages else np.zeros(BUCKETS)
    shared = rows.sparkSession.sparkContext.broadcast(np.vstack([table, mixture]).T.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out, others = [], []
            for text in batch.column(4):
                grams = trigrams(plain(text.as_py()) if markup else text.as_py())
                weight = min(len(grams), TEXT_WEIGHT)
                *logs, mixed = (weights[grams].mean(axis=0, dtype=np.float64) * weight).astype(float).tolist() if len(grams) and languages else (None,)
                out.append(logs or None)
                others.append(None if mixed is None else none * weight - mixed)
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.list_(pa.float64())), pa.array(others, pa.float64())], names=["id", "host", "suffix", "declared", "text_ll", "other"])

    return rows.select("id", "host", "suffix", "declared", "text").mapInArrow(run, "id long, host string, suffix string, declared string, text_ll array<double>, other double")


def softmax(logs):
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def sums(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Summed text posteriors by ``keys``, as an array column named mass."""
    grouped = df.groupBy(*keys).agg(*(F.sum(F.element_at("post", k + 1)).alias(f"m{k}") for k in range(n)))
    return grouped.select(*keys, F.array(*(F.coalesce(f"m{k}", F.lit(0.0)) for k in range(n))).alias("mass"))


def shrunk(mass, parent, weight: float):
    """(mass + weight * parent) / their sum, elementwise; a missing mass is the parent."""
    total = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x) + weight
    return F.coalesce(F.zip_with(mass, parent, lambda m, p: (m + p * weight) / total), parent)


def value_table(df: DataFrame, n: int, column: str) -> DataFrame:
    """(``column``, logs): log P(value | language) of each value."""
    found = sums(df.where(F.col(column).isNotNull()), n, column)
    parts = [F.element_at("mass", k + 1) for k in range(n)]
    total = found.agg(F.count("*").alias("values"), *(F.sum(p).alias(f"t{k}") for k, p in enumerate(parts))).first()
    logs = F.array(*(F.log((p + VALUE_WEIGHT) / F.lit((total[f"t{k}"] or 0.0) + VALUE_WEIGHT * max(total["values"], 1))) for k, p in enumerate(parts)))
    return found.select(column, logs.alias(f"{column}_logs"))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` (id, ...) with the columns of ``table`` by ``key``; null where it has no row."""
    table = cut(table)
    if table.count() <= SENT_VALUES:
        return rows.join(F.broadcast(table), key, "left")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray, float], markup: bool = False) -> DataFrame:
    """(id, lang, posterior, text_lang, has_text, other) of rows (id long, host, suffix, declared, text)."""
    languages, n = model[0], len(model[0])
    cleaned = rows.select("id", F.lower("host").alias("host"), last_label(F.col("suffix")).alias("suffix"), code(F.col("declared")).alias("declared"), "text")
    seen = scored(cleaned, model, markup)
    if not n:
        return seen.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("has_text"), F.lit(None).cast("double").alias("other"))
    seen = cut(seen.withColumn("domain", domain(F.col("host"))))
    with_post = seen.withColumn("post", softmax(F.col("text_ll")))
    all_rows = np.array(sums(with_post, n).first()["mass"]) + 1.0
    base = F.array(*map(F.lit, (all_rows / all_rows.sum()).tolist()))
    by_host = sums(with_post.where("host is not null"), n, "host", "domain").withColumnRenamed("mass", "host_mass")
    by_domain = sums(with_post.where("host is not null"), n, "domain").withColumnRenamed("mass", "domain_mass")
    priors = by_host.join(by_domain, "domain").select("host", shrunk(F.col("host_mass"), shrunk(F.col("domain_mass"), base, DOMAIN_WEIGHT), HOST_WEIGHT).alias("prior"))
    joined = looked_up(seen, priors, "host")
    for column in ("declared", "suffix"):
        joined = looked_up(joined, value_table(with_post, n, column), column)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("prior", base), lambda p: F.log(p))
    total = add(add(F.coalesce("text_ll", F.lit([0.0] * n)), prior), add(*(F.coalesce(f"{column}_logs", F.lit([0.0] * n)) for column in ("declared", "suffix"))))
    labels, post = F.array(*map(F.lit, languages)), softmax(total)
    fused = joined.select("id", "text_ll", "other", post.alias("post"))
    best = lambda x: F.element_at(labels, F.array_position(x, F.array_max(x)).cast("int"))
    return fused.select("id", best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"), F.when(F.col("text_ll").isNotNull(), best(F.col("text_ll"))).alias("text_lang"), F.col("text_ll").isNotNull().alias("has_text"), "other")


def of_pages(pages: DataFrame, model: tuple[list[str], np.ndarray, float]) -> DataFrame:
    """Languages of web pages (page_id, url, html)."""
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), F.when(declared != "", declared).alias("declared"), F.col("html").alias("text"))
    return identify(rows, model, markup=True).withColumnRenamed("id", "page_id").drop("other")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray, float], least: float = 0.34) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) with letters, a language of posterior ``least`` or more, and text that isn't in none.

    ``source`` stands for the host. Rejected are the doc_ids of which a row fails; a row with a null doc_id stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("host"), *(F.lit(None).cast("string").alias(c) for c in ("suffix", "declared")), "text")
    out = identify(rows, model).where(~F.col("has_text") | (F.col("posterior") < least) | (F.col("other") > float(np.log(1 / OTHER - 1)))).where("id is not null").select(F.col("id").alias("__rejected")).distinct()
    return docs.join(out, docs["doc_id"] == out["__rejected"], "left_anti")
