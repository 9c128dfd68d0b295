"""Language ID (operator 5): Bayesian fusion of evidence.

Text gives a likelihood for each language, by the letter trigrams of its words. A declared markup language, the suffix of an
address and a host say more. First the texts alone give each row's posterior; grouped sums of these give each host's
prior, drawn towards its suffix's, that towards the corpus', and how often a language is declared as what. Then
all evidence is combined. The trigram model is fitted on a bounded sample of labelled rows; everything else covers all rows.

Trigrams of a text depend on each other, so their product is too sure. It is tempered: a third of the sample, scored by a model of
the other two, gives the temperature by which log-likelihoods are divided. The driver gets trigram counts and scores, no texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartermill.llm._common import Memo, Scratch, columns_of, free_name, importable, map_texts, table

#: Labelled rows a language gives to the model at most, every third of them for the temperature; and the temperatures tried.
SAMPLE_ROWS = 300
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Rows that a suffix's prior weighs in a host's, and the corpus' in a suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
LEAST_CONFIDENCE = 0.5
HTML_LANG = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})"
#: In a document: the language of its first markup that declares one, and the host of its first web or mail address.
TEXT_LANG = r"(?i)<[a-z][^<>]*\blang\s*=\s*[\"']?([a-z]{2,3})"
TEXT_HOST = r"(?i)(?:https?://|@)((?:[a-z0-9-]+\.)+[a-z]{2,})"


def trigrams(word: str) -> list[str]:
    """Of the word's letters in lower case, its ends marked."""
    letters = "".join(c for c in word.lower() if c.isalpha())
    if not letters:
        return []
    own = f"^{letters}$"
    return [own[i : i + 3] for i in range(len(own) - 2)] or [own]


class TextModel:
    """Trigram log-likelihoods by language. floor: the least mean likelihood of a text in any of the languages."""

    def __init__(self, languages: list[str], table: dict[str, list[float]], unseen: list[float], floor: float, temperature: float = 1.0):
        self.languages, self.table, self.unseen, self.floor, self.temperature = languages, table, unseen, floor, temperature

    @classmethod
    def from_counts(cls, counts: dict[str, Counter]) -> TextModel:
        """counts: trigrams by language."""
        languages = sorted(counts)
        every = sorted({t for c in counts.values() for t in c})
        totals = [sum(counts[x].values()) + 0.5 * (len(every) + 1) for x in languages]
        known = {t: [math.log((counts[x][t] + 0.5) / n) for x, n in zip(languages, totals)] for t in every}
        return cls(languages, known, [math.log(0.5 / n) for n in totals], -math.inf)

    def calibrate(self, means: list[float], held_out: list[tuple[int, list[float]]]) -> None:
        """means: best mean likelihoods of texts with 20 trigrams or more; held_out: true language and scores of texts the model doesn't know."""
        self.floor = min(means, default=0.0) - 1.0

        def fit(temperature: float) -> float:
            x = np.array([s for _, s in held_out]) / temperature
            top = x.max(1)
            return float((x[np.arange(len(x)), [i for i, _ in held_out]] - top - np.log(np.exp(x - top[:, None]).sum(1))).sum())

        if held_out:
            self.temperature = max(TEMPERATURES, key=lambda t: (round(fit(t), 9), -t))


class Scorer:
    """Sums of a text's trigram likelihoods; each distinct word is worked out once."""

    def __init__(self, model: TextModel, words: int = 200_000):
        self.model, self.cap, self.width = model, words, len(model.languages) + 1
        self._clear()

    def _clear(self) -> None:
        self.values = np.zeros((self.cap, self.width))
        self.rows = Memo(4 * self.cap, self._row)

    def _row(self, word: str) -> int:
        n = len(self.rows)
        own = trigrams(word)
        if own:
            known = [self.model.table.get(t, self.model.unseen) for t in own]
            self.values[n] = [*map(sum, zip(*known)), len(own)]
        return n

    def score(self, text: str) -> list[float]:
        """A sum for each language, then the number of trigrams."""
        total = np.zeros(self.width)
        words = text.split()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            if len(self.rows) + len(part) > self.cap:
                self._clear()
            total += self.values[np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))].sum(0)
        return total.tolist()


def fit_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """From `sample_rows` rows of each language at most, chosen by a hash of doc_id; labelled: doc_id, lang, text.

    No labelled row: a model without languages.
    """
    scratch = Scratch(labelled.sparkSession, "language-model")
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND lang != ''").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(0)
    for language, n in sizes.items():
        bound = F.when(F.col("lang") == language, min(1 << 30, int((1 << 31) * sample_rows / n))).otherwise(bound)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    own = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    sample = labelled.withColumn("place", place).where(F.col("place") <= bound).withColumn("k", F.row_number().over(own)).where(F.col("k") <= sample_rows)
    sample = scratch.keep(sample.select("lang", (F.col("k") % 3 == 0).alias("held"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for language, held, text in zip(*columns_of(batch, "lang", "held", "text")):
                for word, n in Counter(text.split()).items():
                    for t in trigrams(word):
                        found[language, held, t] += n
            yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array([k[2] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "held", "t", "n"])

    every: dict[str, Counter] = {}
    known: dict[str, Counter] = {}
    for r in map_texts(sample, count, "lang string, held boolean, t string, n long").groupBy("lang", "held", "t").agg(F.sum("n").alias("n")).collect():
        every.setdefault(r["lang"], Counter())[r["t"]] += r["n"]
        if not r["held"]:
            known.setdefault(r["lang"], Counter())[r["t"]] += r["n"]
    model, trial = TextModel.from_counts(every), TextModel.from_counts(known)
    shipped = labelled.sparkSession.sparkContext.broadcast((model, trial))  # trigrams of a bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part = map(Scorer, shipped.value)
        for batch in batches:
            languages, held, texts = columns_of(batch, "lang", "held", "text")
            scores, trials = [whole.score(t) for t in texts], [part.score(t) for t in texts]
            yield pa.record_batch([pa.array(languages, pa.string()), pa.array(held, pa.bool_()), pa.array([max(x[:-1]) / x[-1] if x[-1] >= 20 else None for x in scores], pa.float64()), pa.array(trials, pa.list_(pa.float64()))], names=["lang", "held", "mean", "trial"])

    if model.languages:
        rows = map_texts(sample, score, "lang string, held boolean, mean double, trial array<double>").collect()  # a bounded sample's numbers
        place_of = {x: i for i, x in enumerate(trial.languages)}
        model.calibrate([r["mean"] for r in rows if r["mean"] is not None], [(place_of[r["lang"]], r["trial"][:-1]) for r in rows if r["held"] and r["lang"] in place_of and r["trial"][-1] > 0])
    scratch.drop(sample)
    return model


def log_softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = F.log(sum((F.exp(s - top) for s in scores[1:]), F.exp(scores[0] - top)))
    return [s - top - total for s in scores]


def identify(rows: DataFrame, model: TextModel, *keys: str) -> DataFrame:
    """doc_id (or `keys`), language, confidence, kept of every row of `rows`: these, text, and (nullable) declared, suffix, host.

    kept: the best language has LEAST_CONFIDENCE and the text has letters and looks like it; language is 'und' otherwise. A null
    or empty text, or one without letters, isn't kept. Null hosts, suffixes and declarations say nothing beyond the corpus' prior.
    Rows with the same doc_id, or the same row twice, each give a row and count in the priors. Other columns aren't read. An
    empty table gives no rows. With a model without languages every row is 'und'.
    """
    spark = rows.sparkSession
    keys = keys or ("doc_id",)
    if not model.languages:
        return rows.select(*keys, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    scratch = Scratch(spark, "language")
    shipped = spark.sparkContext.broadcast(model)  # trigrams of a bounded sample
    k = len(model.languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            kept = [batch.schema.get_field_index(c) for c in (*keys, "declared", "suffix", "host")]
            scores = [scorer.score(t or "") for t in columns_of(batch, "text")[0]]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(scores, pa.list_(pa.float64()))], names=[*keys, "declared", "suffix", "host", "scores"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    scored = map_texts(rows.select(*keys, "text", "declared", "suffix", "host"), score, f"{kinds}, declared string, suffix string, host string, scores array<double>")
    n = F.get("scores", F.lit(k))
    likely = n > 0
    text = [F.when(likely, F.get("scores", F.lit(i)) / F.lit(model.temperature)).otherwise(0.0) for i in range(k)]
    alone = [F.exp(x) for x in log_softmax(text)]
    columns = {f"t{i}": text[i] for i in range(k)} | {f"p{i}": alone[i] for i in range(k)}
    best = F.greatest(*(F.get("scores", F.lit(i)) for i in range(k))) if k > 1 else F.get("scores", F.lit(0))
    columns |= {"plausible": F.coalesce(likely & (best / n >= F.lit(model.floor)), F.lit(False))}
    blank = F.lit("")
    columns |= {c: F.coalesce(F.lower(c), blank) for c in ("declared", "suffix", "host")}
    rows = scratch.keep(scored.withColumns(columns).drop("scores"))
    heard = rows.where("plausible")
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]
    hosts = scratch.keep(heard.groupBy("host", "suffix").agg(*sums))
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"p{i}").alias(f"s{i}") for i in range(k)))
    whole = [v or 0.0 for v in hosts.agg(*sums).first()] if k else []
    top = [(v + 1.0) / (sum(whole) + k) for v in whole]
    added = lambda prefix: sum((F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(1, k)), F.coalesce(F.col(f"{prefix}0"), F.lit(0.0)))
    drawn = lambda prefix, parents, pull: [(F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) + pull * parents[i]) / (added(prefix) + pull) for i in range(k)]
    suffix_prior = [F.when(F.col("suffix") == "", F.lit(top[i])).otherwise(x) for i, x in enumerate(drawn("s", [F.lit(t) for t in top], SUFFIX_WEIGHT))]
    priors = hosts.join(suffixes, "suffix", "left")
    host_prior = [F.when(F.col("host") == "", suffix_prior[i]).otherwise(x) for i, x in enumerate(drawn("p", suffix_prior, HOST_WEIGHT))]
    priors = scratch.keep(priors.select("host", "suffix", *(F.log(x).alias(f"h{i}") for i, x in enumerate(host_prior))))
    known = {language: i for i, language in enumerate(model.languages)}
    said = heard.where(F.col("declared").isin(list(known))).groupBy("declared").agg(*sums).collect()  # one row a language
    declared = np.full((k, k), 0.5) + 4.0 * np.eye(k)
    for r in said:
        declared[:, known[r["declared"]]] += [r[f"p{i}"] for i in range(k)]
    declared = np.log(declared / declared.sum(1, keepdims=True))
    met = rows.join(priors, ["host", "suffix"], "left")
    fused = []
    for i in range(k):
        says = F.lit(0.0)
        for language, j in known.items():
            says = F.when(F.col("declared") == language, float(declared[i, j])).otherwise(says)
        fused.append(F.col(f"t{i}") + F.coalesce(F.col(f"h{i}"), F.lit(math.log(top[i]))) + says)
    final = [F.exp(x) for x in log_softmax(fused)]
    met = met.select(*keys, "plausible", *(x.alias(f"f{i}") for i, x in enumerate(final)))
    confidence = F.greatest(*(F.col(f"f{i}") for i in range(k))) if k > 1 else F.col("f0")
    name = F.lit(None).cast("string")
    for i in reversed(range(k)):
        name = F.when(F.col(f"f{i}") == confidence, model.languages[i]).otherwise(name)
    kept = F.col("plausible") & (F.round(confidence, 6) >= LEAST_CONFIDENCE)
    return met.select(*keys, F.when(kept, name).otherwise("und").alias("language"), F.when(F.col("plausible"), F.round(confidence, 6)).otherwise(0.0).alias("confidence"), kept.alias("kept"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """A document's source is its host; markup in its text may declare a language, and an address there has a suffix."""
    declared = F.when(F.contains("text", F.lit("lang")), F.nullif(F.lower(F.regexp_extract("text", TEXT_LANG, 1)), F.lit("")))
    address = F.when(F.contains("text", F.lit("://")) | F.contains("text", F.lit("@")), F.lower(F.regexp_extract("text", TEXT_HOST, 1)))
    suffix = F.nullif(F.regexp_extract(address, r"\.([a-z]{2,})$", 1), F.lit(""))
    return docs.select("doc_id", "text", declared.alias("declared"), suffix.alias("suffix"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id as doc_id, the page's text, its declared language, and its address' suffix and host."""
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    declared = F.nullif(F.lower(F.regexp_extract("html", HTML_LANG, 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), declared.alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def documents_in_language(docs: DataFrame) -> DataFrame:
    """docs less the rows that aren't kept; columns stay, whatever their names.

    Rows alike in doc_id, source and text are judged alike. If no row has a language there is nothing to reject by, and all stay.
    """
    model = fit_model(docs)
    if not model.languages:
        return docs
    scratch = Scratch(docs.sparkSession, "language-kept")
    key, text_hash, source = (free_name(n, docs.columns) for n in ("gone_id", "gone_hash", "gone_source"))
    evidence = document_evidence(docs).withColumns({text_hash: F.xxhash64("text"), source: F.col("host")}).withColumnRenamed("doc_id", key)
    gone = identify(evidence, model, key, text_hash, source).where("NOT kept").select(key, text_hash, source).distinct()
    gone = scratch.keep(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]) & (F.xxhash64(docs["text"]) == gone[text_hash]) & docs["source"].eqNullSafe(gone[source]), "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(document_evidence(docs), fit_model(docs))


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, by text, markup, suffix and host; the text model is the documents'."""
    pages = page_evidence(table(spark, sf_dir, "pages"))
    return identify(pages, fit_model(table(spark, sf_dir, "documents"))).withColumnRenamed("doc_id", "page_id")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents in no language of the corpus go."""
    return documents_in_language(docs)
